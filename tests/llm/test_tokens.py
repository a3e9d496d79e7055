import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash

from furrow.llm import tokens

PATH = public_tokenizers.path(tokens.TOKENIZER)


def texts(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "é", "İ", "ſ", "'s", "don't", "ç", "9", "½", "_", ".", ",", "ß", "σς", "中", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "A", "zz", "-", "Th.", "e,", "a##", "x%%%.", "é!?", "'S"]) for _ in range(r.randint(1, 5)))
    return ["".join(word() + r.choice([" ", " ", "\n", "\t", " ", " ", "\x1c", "\x85"]) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", " ", None]


def brute(ts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, tokens.END] for x in ts]


def test_words_encode_like_whole_texts():
    e = tokens.Encoder(PATH)
    for seed in range(3):
        ts = texts(seed)
        ids, n = e.encode([t or "" for t in ts])
        want = brute(ts)
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("seed", range(4))
def test_shard_round_trip_and_random_access(seed):
    g = np.random.default_rng(seed)
    counts = g.integers(1, 90, 60)
    ids = g.choice([5, 6, 7, 300, 49_000], counts.sum(), p=[0.4, 0.3, 0.2, 0.05, 0.05]).astype(np.uint32)
    ids[np.cumsum(counts) - 1] = tokens.END
    raw = tokens.shard_bytes(ids, counts)
    s = tokens.Shard(raw)
    got, n = s.all()
    assert np.array_equal(got, ids) and np.array_equal(n, counts) and len(s.rules)
    assert not recurring(s.seq, s.begin)
    at = 0
    for i, c in enumerate(counts.tolist()):
        assert np.array_equal(s.document(i), ids[at : at + c])
        k = int(g.integers(c))
        assert s.token(i, k) == ids[at + k]
        at += c
    with pytest.raises(IndexError):
        s.token(0, int(counts[0]))


def recurring(seq, begin):
    """Pairs of neighbours within a document that occur twice without overlap."""
    ends = {*(np.append(begin[1:], len(seq)) - 1).tolist()}
    seen, last = {}, {}
    for i in range(len(seq) - 1):
        if i not in ends and last.get((p := (int(seq[i]), int(seq[i + 1])))) != i - 1:
            seen[p] = seen.get(p, 0) + 1
            last[p] = i
    return [p for p, n in seen.items() if n > 1]


@pytest.mark.parametrize("times", [2, 3, 12, 2000])
def test_pairs_are_replaced_until_none_recurs(times):
    block = np.arange(100, 150, dtype=np.uint32)
    for docs in (1, times):
        ids = np.tile(np.append(block, tokens.END) if docs > 1 else block, times).astype(np.uint32)
        counts = np.full(docs, len(ids) // docs)
        rules, seq, begin = tokens.repair(ids, np.cumsum(counts) - counts)
        assert not recurring(seq, begin)
        assert len(seq) <= (2 * docs if docs > 1 else 60)
        assert np.array_equal(tokens.Shard(tokens.shard_bytes(ids, counts)).all()[0], ids)


def test_one_id_in_a_row_and_long_texts():
    for n in (1, 2, 3, 4, 5, 1000, 300_001):
        ids = np.full(n, 7, np.uint32)
        rules, seq, begin = tokens.repair(ids, np.zeros(1, int))
        assert not recurring(seq, begin) and len(seq) < 2 + n.bit_length() * 3
        s = tokens.Shard(tokens.shard_bytes(ids, np.array([n])))
        assert np.array_equal(s.document(0), ids) and s.token(0, n - 1) == 7
    text = "a" * 100_000 + " " + "word " * 50_000
    ids, n = tokens.Encoder(PATH).encode([text])
    assert ids.tolist() == brute([text])[0]


def test_files_hold_all_documents_in_order(spark):
    ts = texts(11)
    rows = [(i * 3 % 251, t, 1) for i, t in enumerate(ts)] + [(None, f"also {i}", 1) for i in range(40)] + [(None, "null id", 1), (5, "again", 1), (5, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_shards(tokens.write_shards(docs, PATH, 400)).collect()))
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest((t or "").encode(), 42), "big", signed=True)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want, at = [], 0
    for (doc, _, _), ids in zip(order, brute([r[1] for r in order]), strict=True):
        want.append((at, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokens.read_shards(tokens.write_shards(docs.limit(0), PATH)).count() == 0


def test_slices_by_bytes_hold_every_row_in_order():
    texts = [None, "", "aaaa", "é" * 5, "b" * 100, "c", None, "dd"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = [p.column("text").to_pylist() for p in tokens.by_bytes(iter([batch, batch.slice(0, 0)]), 14)]
    assert sum(parts, []) == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 14 for p in parts)
    assert parts[0] == [None, "", "aaaa", "é" * 5]
