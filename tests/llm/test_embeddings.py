import numpy as np

from furrow.llm import embeddings, topk


def vectors(seed, n=500, dim=24):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dim))
    for i in range(60):
        x[100 + i] = x[0] + 0.15 * g.normal(size=dim)  # a dense group
    for i in range(0, 60, 2):
        x[300 + i + 1] = x[300 + i] + 0.28 * g.normal(size=dim)
    x[420:430] = x[400]
    return x.astype(np.float32)


def odd(rows):
    return [*rows, (9001, None, 0), (9002, [], 0), (9003, [0.0] * 24, 0), (9004, [float("nan")] * 24, 0), (9005, [None] + [1.0] * 23, 0), (None, rows[0][1], 0), (9006, [1.0, 2.0], 0), (9007, [1.0, 2.1], 0)]


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    x = vectors(4)
    rows = odd([(i * 3, [float(c) for c in v], 1) for i, v in enumerate(x)]) + [(15, [float(c) for c in x[5]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int").repartition(3)
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows)
    ok = [r for r in rows if r[0] is not None and (r[0] < 9001 or r[0] > 9005)]
    links, parent = [0] * len(ok), list(range(len(ok)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(ok):
        for j, b in enumerate(ok[:i]):
            if len(a[1]) == len(b[1]):
                p, q = np.array(a[1]), np.array(b[1])
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.9:
                    links[i] += 1
                    links[j] += 1
                    s, t = sorted((find(i), find(j)))
                    parent[t] = s
    low = {}
    for i, r in enumerate(ok):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    want = [(r[0], links[i], low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(ok)]
    want += [(i, 0, i, True) for i in range(9001, 9006)] + [(None, 0, None, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert max(links) > 50
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_is_told_and_enforced(spark, monkeypatch):
    import pytest

    x = vectors(8)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df).recall >= embeddings.RECALL
    monkeypatch.setattr(embeddings, "TRIES", 1)
    monkeypatch.setattr(embeddings, "checked", lambda edges, nodes: edges.limit(0).selectExpr("node AS a", "near AS b"))
    with pytest.raises(RuntimeError, match="audited"):
        embeddings.near_duplicates(df)


def test_windows_hold_whole_groups():
    import pyarrow as pa

    sizes = [3, 1, 40, 7, 100, 2, 16, 16]
    key = np.repeat(np.arange(len(sizes)), sizes)
    table = pa.table({"k": key, "i": np.arange(len(key))})
    for step in (1, 5, 16, 200):
        together = set()
        for t in embeddings._whole(iter(table.to_batches(max_chunksize=step)), ["k"], 16):
            for k in set(t["k"].to_pylist()):
                own = [i for i, o in zip(t["i"].to_pylist(), t["k"].to_pylist(), strict=True) if o == k]
                assert len(own) <= 32
                together |= {(a, b) for a in own for b in own}
        for k, n in enumerate(sizes):
            i = np.flatnonzero(key == k)
            near = 16 if n <= 16 else 8
            assert all((a, b) in together for a in i.tolist() for b in i.tolist() if abs(a - b) < near)


def test_top_k_equals_brute_force(spark):
    x = vectors(6)
    rows = odd([(i, [float(c) for c in v], 1) for i, v in enumerate(x)]) + [(20, [float(c) for c in x[20]], 1), (77, [float(c) for c in x[77]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    ok = [(r[0], np.floor(64 * np.array(r[1], float)).astype(int)) for r in rows if r[0] is not None and (r[0] < 9001 or r[0] > 9005)]
    want = []
    for i, q in {(i, tuple(q)) for i, q in ok if i % 20 == 0}:
        found = sorted((-int(np.dot(q, c)), j) for j, c in ok if j != i and len(c) == len(q))[:20]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found)]
    for shard in (4096, 64):
        got = topk.top_k(df, shard=shard).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    few = topk.top_k(df.where("vec_id in (40, 41, 42)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(40, 1), (40, 2)]
