import hashlib
import random

import pytest

from furrow.llm import repeats


def brute(texts, length):
    """(n_removed, n_spans, sha256) of each text."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage, base = text(9), text(60), text(150)
    out = ["", None, "short", "x" * 5000, "ab" * 1000, line * 30, passage]
    for _ in range(40):
        parts = [text(r.randint(5, 90))]
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice([line, line + "\n" + line, passage, passage[: r.randint(50, len(passage))], text(20)]))
        out.append(" ".join(parts) + text(r.randint(0, 30)))
    for _ in range(30):
        words = base.split(" ")
        words[r.randrange(len(words))] = word()
        out.append(" ".join(words))
    out += [out[8]] * 5
    return out


@pytest.mark.parametrize(("seed", "group", "length"), [(1, 256, 200), (2, 3, 200), (3, 2, 60)])
def test_equals_brute_force(spark, seed, group, length):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, digit int").repartition(3)
    got = {r.doc_id: (r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.without_repeats(docs, length, group).collect()}
    for i, want in enumerate(brute([(t or "").encode() for t in texts], length)):
        assert got[i] == want, i


def test_repeated_rows_and_null_ids(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(150)) + "".join(chr(97 + i * 7 % 25) for i in range(151))
    docs = spark.createDataFrame([(None, t), (None, t), (5, t[::-1]), (5, "tail " + t[::-1]), (5, "other")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.without_repeats(docs).collect())
    assert got == [(0, 301, 301), (0, 301, 301), (5, 5, 0), (5, 301, 301), (5, 306, 301)]
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(repeats.CHUNK + 5000))
    docs = spark.createDataFrame([(1, long), (2, "zz" + long[1000:] + "q")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in repeats.without_repeats(docs).collect())
    assert got == [(1, len(long) - 1000), (2, len(long) - 1000)]
