import random

import numpy as np
import pytest
import xxhash

from furrow.llm import simhash


def brute_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    n, parent = len(fps), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def texts(seed):
    r = random.Random(seed)
    words = ["alpha", "Beta", "Ünder", "É", "x", "of", "the", " z", "q\x85", "nine9"]
    own = lambda n: r.choice([" ", "\n"]).join(r.choice(words) + str(r.randint(0, 40)) for _ in range(n))
    out = [None, "", " \n\t ", "one", "one two THREE", own(300), "w " * 70_000]
    for _ in range(30):
        base = own(r.randint(20, 200))
        out.append(base)
        for _ in range(r.randint(0, 4)):
            w = base.split(" ")
            w[r.randrange(len(w))] = "edit"
            out.append(" ".join(w))
    return out + [out[7]] * 3


def test_fingerprints():
    for t in texts(1):
        assert simhash.fingerprint(t) == brute_print(t)


@pytest.mark.parametrize("bucket", [8192, 3])
def test_components_equal_brute_force(spark, bucket):
    g = np.random.default_rng(bucket)
    base = g.integers(0, 1 << 64, 40, np.uint64)
    fps = [int(x) for x in base]
    for x in base:
        for _ in range(int(g.integers(0, 9))):
            for b in g.choice(64, int(g.integers(1, 7)), replace=False):
                x ^= np.uint64(1 << int(b))
            fps.append(int(x))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket)
    from furrow.llm.common import components

    got = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(fps)
    names = {}
    for s, w in zip(signed, want, strict=True):
        assert names.setdefault(w, got.get(s, s)) == got.get(s, s)
    assert len(set(names.values())) == len(names)


def test_documents(spark):
    ts = texts(2)
    rows = [(i, t, "s") for i, t in enumerate(ts)] + [(None, ts[8], "s"), (8, ts[8], "s"), (None, "quite alone here now", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    comp = brute_components([brute_print(t) for _, t, _ in rows])
    low = {}
    for (i, _, _), c in zip(rows, comp, strict=True):
        low[c] = min(x for x in (low.get(c), i) if x is not None) if (low.get(c), i) != (None, None) else None
    want = sorted(((i, low[c]) for (i, _, _), c in zip(rows, comp, strict=True)), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
