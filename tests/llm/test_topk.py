"""Exact search against brute force with unbounded integers."""

import math

import numpy as np
import pytest

from furrow.llm import topk

SCHEMA = "vec_id long, embedding array<double>, rank int, score string"


def brute(rows, k=20, every=20):
    ok = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(64 * c) for c in v)]
    want = []
    for i, q in {(i, tuple(q)) for i, q in ok if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in ok if j != i and len(c) == len(q))[:k]
        want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(found)]
    return sorted(want)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in rows], SCHEMA).repartition(parts)


def got(df, **options):
    return sorted(map(tuple, topk.top_k(df, **options).collect()))


def test_large_components_and_close_scores(spark):
    g = np.random.default_rng(1)
    rows = [(i, g.normal(size=8).tolist()) for i in range(200)]
    rows += [(200, [4e7] + [0.5] * 7), (201, [4e7] + [0.515625] + [0.5] * 6), (202, [4e7 + 1 / 64] + [0.5] * 7), (220, [1e12] * 8), (221, [-1e12] * 8), (222, [3e13, 1 / 64] + [0] * 6), (223, [3e13, 2 / 64] + [0] * 6)]
    rows += [(240, [3e15, 64] + [0.0] * 6), (241, [2.0, 1 / 64] + [0.0] * 6), (242, [2.0, 2 / 64] + [0.0] * 6)]
    want = brute(rows)
    for shard in (4096, 32):
        assert got(frame(spark, rows), shard=shard, part=2) == want


def test_scores_beyond_all_digits_are_an_error(spark):
    from pyspark.errors import PythonException

    with pytest.raises(PythonException, match="38 digits"):
        topk.top_k(frame(spark, [(0, [1e30, 1.0]), (1, [1e30, 1.0])])).collect()


def test_nulls_ties_lengths_and_repeats(spark):
    rows = [(i, [i % 3, 1.0]) for i in range(60)] + [(20, [2.0, 1.0]), (7, [7 % 3, 1.0]), (None, [1.0, 1.0]), (80, None), (100, []), (120, [None, 1.0]), (140, [float("nan"), 1.0]), (160, [float("inf"), 1.0])]
    rows += [(180, [1.0, 2.0, 3.0]), (181, [1.0, 2.0, 4.0]), (200, [1.0]), (220, [0.0, -0.0]), (240, [1e308, 1.0])]
    want = brute(rows)
    for shard in (4096, 8):
        assert got(frame(spark, rows), shard=shard, part=1) == want
    assert topk.top_k(frame(spark, rows).limit(0)).count() == 0
    # No query, or no candidate.
    assert got(frame(spark, [(1, [1.0]), (2, [2.0])])) == [] and got(frame(spark, [(20, [1.0])])) == []


def test_many_shards_of_clusters(spark):
    g = np.random.default_rng(2)
    centres = 3 * g.normal(size=(40, 16))
    x = centres[g.integers(0, 40, 20_000)] + 0.3 * g.normal(size=(20_000, 16))
    x[5000:9000] = x[5000]  # a fifth are one vector
    rows = list(enumerate(x.tolist()))
    f = np.floor(64 * x)
    asked = np.arange(0, 20_000, 500)
    s = f[asked] @ f.T
    s[np.arange(len(asked)), asked] = -np.inf
    want = [(int(q), n + 1, int(j), int(s[i, j])) for i, q in enumerate(asked) for n, j in enumerate(np.lexsort((np.arange(20_000), -s[i]))[:20])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert got(df, every=500, shard=512) == sorted(want)
