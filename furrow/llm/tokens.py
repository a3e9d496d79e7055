"""Token ids in grammar-compressed shard files (Re-Pair), written and read back.

Every whole text (null: empty) is encoded with a public tokenizer, an end id is appended, and documents follow each
other in ascending doc_id (null ids first). Rows are range-sorted by doc_id; a task cuts its range
into shards of about ``SHARD`` ids, whole documents each. In a shard the most frequent pairs of neighbouring
ids are replaced by nonterminals, round after round, until no pair occurs ``LEAST`` times without overlap (Re-Pair). A
shard file holds its rules, the length that each rule expands to, the final
sequence, and for each document where its part of the sequence begins: no rule crosses a document's end, so any
document is decoded on its own, and any id in it is found by expansion lengths.

Files are the rows of a Parquet table (part, shard, ids of the part ahead of it, payload), so they live in any store that Spark
writes to. Memory is bounded by a shard or, if longer, one document, and ``KEPT`` bytes of known words. Texts are split at ASCII white space,
which the tokenizer drops and never joins over, and each distinct word is encoded once in a task. Rows of one id, or none, follow each
other by the hash of their text, so they need not be in one task; repeated rows are written as often as they occur. An empty table has no
files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import documents, emit, partitions, small_batches, written

TOKENIZER = "word_bpe_49k.json"
END = 2
SHARD, LEAST = 500_000, 2
#: Bytes of text that are encoded together, unless one text has more.
BYTES = 8_000_000
#: Bytes of words and their ids that a process keeps, about; each has some OVERHEAD more.
KEPT, OVERHEAD = 300_000_000, 200
_MAGIC = b"FRP2"


_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Encoder:
    """Ids of texts, word by word; words are what lies between ASCII white space.

    The tokenizer lower-cases, and takes letters and what isn't letters or digits as separate pieces; so A-Z are lowered
    first (but in texts that might hold a special token's string), and plain letters with ASCII marks behind them
    have the ids of both. New words of plain letters are encoded together, by the same model without
    the steps that find and normalise pieces, and cut at the ids that end a piece. Any other new word goes through
    the whole tokenizer by itself.
    """

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        spaces = {"type": "WhitespaceSplit"}
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        parts |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [spaces, level]}}
        self.pieces = Tokenizer.from_str(json.dumps(parts))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end = np.array([end], np.uint32).tobytes()
        self.known: dict[bytes, bytes] = {b"": b""}
        self.held = 0
        self.marks: dict[bytes, bytes] = {}

    def _whole(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, np.uint32).tobytes() for w, e in zip(words, found, strict=True)}

    def _plain(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of the words that are plain letters."""
        decoded = b" ".join(words).decode().split(" ") if words else []
        both = [(raw, w) for raw, w in zip(words, decoded, strict=True) if w.isalpha() and (w.isascii() or max(w) < "\u0130")]
        found = self.pieces.encode_batch_fast([" ".join([w for _, w in both]).lower()], add_special_tokens=False)[0]
        ids = np.array(found.ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, int)
        if len(stops) != len(both):
            return {}
        cuts, raw = (4 * stops).tolist(), ids.tobytes()
        return {w: raw[a:b] for (w, _), a, b in zip(both, [0, *cuts], cuts, strict=False)}

    def _new(self, words: list[bytes], more: dict[bytes, bytes]) -> dict[bytes, bytes]:
        """Ids of words that neither ``known`` nor ``more`` has."""
        marks = self.marks
        marked = [(w, body) for w in words if (body := w.rstrip(_MARKS)) and len(body) < len(w)]
        fresh = self._plain(list({body for _, body in marked}.union(words).difference(self.known, more, [w for w, _ in marked])))
        for w, body in marked:
            ids = fresh.get(body)
            if ids is None and (text := body.decode()).isalpha() and (text.isascii() or max(text) < "\u0130"):
                ids = self.known.get(body) or more.get(body)
            if ids is not None:
                tail = w[len(body) :]
                if tail not in marks:
                    marks[tail] = self._whole([tail])[tail]
                fresh[w] = ids + marks[tail]
        return fresh | self._whole([w for w in words if w not in fresh])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts with the end ids, and how many each text has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        column = pa.array(texts, pa.large_string())
        lowered = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        words = pc.ascii_split_whitespace(lowered)
        n_words = pc.list_value_length(words).to_numpy()
        found = words.flatten().dictionary_encode()
        distinct = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        known, fresh = self.known, {}
        ids = list(map(known.get, distinct))
        if None in ids:
            new = [w for w, x in zip(distinct, ids, strict=True) if x is None]
            for i in range(0, len(new), 10_000):
                fresh |= self._new(new[i : i + 10_000], fresh)
            ids = [fresh[w] if x is None else x for w, x in zip(distinct, ids, strict=True)]
        size = sum(map(len, fresh)) + sum(map(len, fresh.values())) + OVERHEAD * len(fresh)
        if self.held + size <= KEPT:
            known |= fresh
            self.held += size
        if len(self.marks) > 100_000:
            self.marks.clear()
        # The end id is one more word, behind every text's last.
        ids.append(self.end)
        codes = np.insert(found.indices.to_numpy(), np.cumsum(n_words), len(distinct))
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = np.cumsum(lens) - lens
        size = lens[codes]
        ends = np.cumsum(size)
        every = np.frombuffer(b"".join(ids), np.uint32)[np.arange(ends[-1]) + np.repeat(place[codes] - ends + size, size)]
        return every, np.diff(ends[np.cumsum(n_words + 1) - 1], prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file; the words it knows serve later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def repair(ids: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, sequence, starts): rules[i] is the pair that nonterminal base + i stands for, where base is the
    largest id + 1; starts are those of the documents in the sequence.

    A round replaces every place whose pair is more frequent than those that overlap it (ties at random, seeded). Then only the
    places beside a replaced one, and those that had to stand back, can hold a pair that recurs: they are the next round's
    queue, so a shard's rounds together are some three times its length."""
    n = len(ids)
    seq = ids.astype(np.int64)
    base, made, rules = int(seq.max(initial=0)) + 1, 0, []
    # Neighbours in the same document; -1, the last place of the arrays, where there is none.
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[starts[1:] - 1] = -1
    after[-1:] = -1
    before[starts] = -1
    alive, strength = np.ones(n, bool), np.zeros(n + 1, np.int64)
    random = np.random.default_rng(0)
    at = np.flatnonzero(after >= 0).astype(np.int32)
    while len(at):
        to = after[at]
        key = seq[at] << 32 | seq[to]
        code, found = pd.factorize(key, size_hint=len(key))
        free = np.ones(len(at), bool)
        twin = np.flatnonzero((key >> 32) == (key & 0xFFFFFFFF))
        if len(twin):
            # Of the places of one id in a row, every second one from the left.
            p = at[twin]
            stretch = np.flatnonzero(np.append(True, to[twin][:-1] != p[1:]))
            odd = (np.arange(len(p)) - np.repeat(stretch, np.diff(np.append(stretch, len(p))))) & 1
            free[twin[odd == 1]] = False
        count = np.bincount(code[free], minlength=len(found))
        often = count >= least
        power = np.where(often, count << 32 | random.integers(1 << 32, size=len(found)), 0)[code]
        power[~free] = 0
        strength[at] = power
        win = np.flatnonzero((power > strength[before[at]]) & (power > strength[to]))
        strength[at] = 0
        worth = np.bincount(code[win], minlength=len(found)) >= least
        win = win[worth[code[win]]]
        place, gone = at[win], to[win]
        if not len(place):
            break
        pair = found[worth]
        rules.append(np.stack([pair >> 32, pair & 0xFFFFFFFF], 1))
        seq[place] = (base + made - 1 + np.cumsum(worth))[code[win]]
        made += len(pair)
        alive[gone] = False
        rest = after[gone]
        after[place] = rest
        before[rest[rest >= 0]] = place[rest >= 0]
        queue = np.zeros(n + 1, bool)
        queue[at[often[code]]] = True
        queue[place] = True
        queue[before[place]] = True
        at = np.flatnonzero(queue[:n] & alive).astype(np.int32)
        at = at[after[at] >= 0]
    first = np.zeros(n, bool)
    first[starts] = True
    every = np.concatenate(rules) if rules else np.zeros((0, 2))
    return every.astype(np.uint32), seq[alive].astype(np.uint32), np.flatnonzero(first[alive])


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each nonterminal expands to; rules only refer to earlier ones."""
    out = np.ones(len(rules), np.int64)
    place = np.maximum(rules.astype(np.int64) - base, 0)
    while len(rules):
        total = np.where(rules >= base, out[place], 1).sum(1)
        if np.array_equal(total, out):
            break
        out = total
    return out


def flat(rules: np.ndarray, base: int) -> np.ndarray:
    """What each nonterminal expands to, one after the other."""
    seq = np.arange(base, base + len(rules), dtype=np.uint32)
    while len(at := np.flatnonzero(seq >= base)):
        n = np.ones(len(seq), np.int64)
        n[at] = 2
        place = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint32)
        out[place] = seq
        pair = rules[seq[at] - base]
        out[place[at]] = pair[:, 0]
        out[place[at] + 1] = pair[:, 1]
        seq = out
    return seq


def _packed(x: np.ndarray, most: int) -> bytes:
    """Unsigned numbers below ``most`` in 2 bytes if they fit, else 4."""
    return x.astype("<u2" if most <= 1 << 16 else "<u4").tobytes()


def shard_bytes(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A shard file of documents with ``counts`` ids each."""
    starts = np.cumsum(counts) - counts
    rules, seq, begin = repair(ids, starts)
    base = int(ids.max(initial=0)) + 1
    most, long = base + len(rules), lengths(rules, base)
    head = _MAGIC + struct.pack("<QQQQQ", base, len(rules), len(seq), len(begin), int(long.max(initial=0)))
    return head + _packed(rules, most) + _packed(long, int(long.max(initial=0)) + 1) + _packed(seq, most) + begin.astype("<u8").tobytes()


class Shard:
    """Reads a shard file; any document alone, or any id of it."""

    def __init__(self, raw: bytes):
        if raw[:4] != _MAGIC:
            raise ValueError("not a shard file")
        self.base, n_rules, n_seq, n_docs, longest = struct.unpack_from("<QQQQQ", raw, 4)
        kind = "<u2" if self.base + n_rules <= 1 << 16 else "<u4"
        at, width = 44, int(kind[-1])
        self.rules = np.frombuffer(raw, kind, 2 * n_rules, at).reshape(-1, 2).astype(np.uint32)
        at += 2 * n_rules * width
        size = "<u2" if longest + 1 <= 1 << 16 else "<u4"
        self.lengths = np.frombuffer(raw, size, n_rules, at)
        at += int(size[-1]) * n_rules
        self.seq = np.frombuffer(raw, kind, n_seq, at).astype(np.uint32)
        at += n_seq * width
        self.begin = np.frombuffer(raw, "<u8", n_docs, at).astype(np.int64)
        # Every symbol's place and length in one array: the ids below base themselves, then what rules expand to.
        self.flat = np.concatenate([np.arange(self.base, dtype=np.uint32), flat(self.rules, self.base)])
        self.size = np.concatenate([np.ones(self.base, np.int32), self.lengths.astype(np.int32)])
        self.place = np.cumsum(self.size, dtype=np.int64) - self.size

    def __len__(self) -> int:
        return len(self.begin)

    def part(self, i: int) -> np.ndarray:
        return self.seq[self.begin[i] : self.begin[i + 1] if i + 1 < len(self.begin) else len(self.seq)]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.part(i))

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids that a sequence, or any part of it, stands for."""
        size = self.size[seq]
        ends = np.cumsum(size, dtype=np.int64)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.place[seq] - ends + size, size)]

    def token(self, i: int, k: int) -> int:
        """Id number ``k`` of document ``i``, descending through the one symbol that holds it."""
        part = self.part(i)
        size = self.size[part]
        ends = np.cumsum(size)
        if not 0 <= k < (ends[-1] if len(ends) else 0):
            raise IndexError(k)
        at = int(np.searchsorted(ends, k, side="right"))
        symbol, k = int(part[at]), k - int(ends[at] - size[at])
        while symbol >= self.base:
            a, b = (int(x) for x in self.rules[symbol - self.base])
            n = int(self.lengths[a - self.base]) if a >= self.base else 1
            symbol, k = (a, k) if k < n else (b, k - n)
        return symbol

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each document has."""
        return self.expand(self.seq), np.add.reduceat(self.size[self.seq].astype(np.int64), self.begin) if len(self.begin) else np.zeros(0, np.int64)


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have at most ``most`` bytes together, or one row."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + most, side="right")))
            yield b.slice(at, upto - at)
            at = upto


def _writer(path: str, shard: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        docs: list[pa.Array] = []
        part, held, nth, ahead = -1, 0, 0, 0

        def flush() -> pa.RecordBatch:
            every, n = np.concatenate(ids), np.concatenate(counts)
            names = pa.concat_arrays(docs)
            return emit(
                {
                    "part": pa.array([part], pa.int32()),
                    "shard": pa.array([nth], pa.int32()),
                    "ahead": pa.array([ahead], pa.int64()),
                    "n_ids": pa.array([len(every)], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                    "payload": pa.array([shard_bytes(every, n)], pa.binary()),
                }
            )

        for x in by_bytes(batches):
            part = x.column("part")[0].as_py()
            got, n = coder.encode([t or "" for t in x.column("text").to_pylist()])
            ends = np.cumsum(n)
            done = 0
            while done < len(n):
                # Documents up to the one that fills the shard.
                before = int(ends[done] - n[done])
                upto = min(int(np.searchsorted(ends, before + shard - held)) + 1, len(n))
                last = int(ends[upto - 1])
                ids.append(got[before:last])
                counts.append(n[done:upto])
                docs.append(x.column("doc_id").slice(done, upto - done))
                held, done = held + last - before, upto
                if held >= shard:
                    yield flush()
                    ids, counts, docs, held, nth, ahead = [], [], [], 0, nth + 1, ahead + held
        if held:
            yield flush()

    return write


def write_shards(docs: DataFrame, tokenizer: str, shard: int = SHARD) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as shard files in ascending doc_id; returns the table of files."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions(docs.sparkSession)
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("part", F.spark_partition_id())
    files = dealt.select("doc_id", "text", "part").mapInArrow(_writer(tokenizer, shard), "part int, shard int, ahead long, n_ids long, doc_ids array<long>, payload binary")
    return written(files, "shards")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            shard = Shard(b.column("payload")[i].as_py())
            ids, counts = shard.all()
            ends = np.cumsum(counts)
            starts = ends - counts
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            base = b.column("base")[i].as_py()
            yield emit(
                {
                    "doc_id": b.column("doc_ids")[i].values,
                    "start": pa.array(starts + base),
                    "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )


def read_shards(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, decoded from them."""
    from pyspark.sql import Window

    # A file knows the ids of its part before it; one window over parts, of which there are as many as shuffle
    # partitions, has those of the parts before, and is small enough to broadcast. So no file is shuffled.
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("of_part")).select("part", (F.sum("of_part").over(w) - F.col("of_part")).alias("base"))
    rows = files.join(F.broadcast(parts), "part").withColumn("base", F.col("base") + F.col("ahead"))
    return rows.select("doc_ids", "payload", "base").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER)))
