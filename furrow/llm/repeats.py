"""Removal of repeated byte strings: a depth-limited radix sort of all suffixes, spread over Spark.

A suffix matters only through its first ``LENGTH`` bytes, its window; a window that occurs twice anywhere, in
whatever document, is removed with all its bytes. Suffixes go through passes of a most-significant-digit radix
sort, and only groups that are still together go on:

1. First digit: the ``DIGIT`` bytes at the window's lowest-hash position (its anchor; equal windows have it at
   the same place). Neighbouring suffixes share an anchor, so a run of suffixes is one row, about a
   seventieth of the bytes. Digits that occur once are done.
2. Second digit: the whole run, to the end of its last window. Runs that occur twice are repeated as a whole and
   go on as one representative, however many copies there are.
3. Last digit: the windows themselves, in groups of runs that share an anchor and differ. Groups of up to
   ``GROUP`` distinct runs are sorted in memory by window. Runs of larger groups are cut where the anchor's distance is
   a multiple of ``PIECE``; what all windows of a piece have in common is a digit of its own, pieces that occur
   twice are repeated as a whole, and only what still shares that digit and differs goes on window by
   window. All of this is counted with partial aggregation, so no group lands in one task.

The equal groups of the last pass are exactly the repeated windows. Digits are compared as 64-bit hashes, a window
together with its anchor's (128 bits in all). Null texts count as empty; texts shorter than a window keep
everything. Repeated rows repeat each other, so all their windows go. Documents are told apart by doc_id,
which may be null, and a hash of the text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import documents, dropped, emit, joined, partitions, released, sliced, small_batches, written

LENGTH = 200
#: Bytes of the first digit.
DIGIT = 32
GROUP, PIECE = 256, 8
#: Bytes that are hashed at once; a position in them takes at most 20 bits.
CHUNK = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_MULT = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, 256, np.uint64)


def _powers(base: int) -> np.ndarray:
    out = np.full(1 << 20, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_MULT), _powers(pow(_MULT, -1, 1 << 64))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of which hashes() takes the hash of any part of ``data`` (at most 1 << 20 bytes)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _DOWN[: len(data)], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever those bytes stand."""
    return mixed((p[end] - p[start]) * _UP[start])


def _lowest(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n, have = len(v) - w + 1, 1
    while 2 * have <= w:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[:n], v[w - have : w - have + n])


def runs(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor hash, run hash, anchor, first and last suffix of each run of a text."""
    out = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK - length + 1):
        part = data[at : at + CHUNK]
        p = prefix(part)
        n = len(part) - DIGIT + 1
        h = mixed((p[DIGIT:] - p[:-DIGIT]) * _UP[:n])
        v = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
        place = (_lowest(v, length - DIGIT + 1) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        last = np.append(first[1:], len(place)) - 1
        anchor = place[first]
        # The run's bytes and where the anchor stands in it.
        whole = hashes(p, first, last + length) ^ mixed((last - first).astype(np.uint64) << np.uint64(20) | (anchor - first).astype(np.uint64))
        out.append((h[anchor], whole, anchor + at, first + at, last + at))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bytes(b: pa.RecordBatch, name: str = "text") -> Iterator[np.ndarray]:
    for x in b.column(name):
        yield np.frombuffer(x.as_buffer() or b"", np.uint8) if x.is_valid else np.zeros(0, np.uint8)


def _scanner(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            got = [runs(d, length) for d in _bytes(b)]
            sizes = np.array([len(g[0]) for g in got])
            if not sizes.sum():
                continue
            anchor_hash, whole, _, first, last = (np.concatenate(x) for x in zip(*got, strict=True))
            row = pa.array(np.repeat(np.arange(len(got)), sizes))
            yield emit(
                {
                    "digit": pa.array(anchor_hash.view(np.int64)),
                    "whole": pa.array(whole.view(np.int64)),
                    "doc_id": b.column("doc_id").take(row),
                    "text_hash": b.column("text_hash").take(row),
                    "first": pa.array(first),
                    "last": pa.array(last),
                }
            )

    return scan


OPENED = "digit long, core long, whole long, doc_id long, text_hash long, first long, last long, single boolean, bytes binary, large boolean"


def _opened(columns: dict[str, list | np.ndarray]) -> pa.RecordBatch:
    kinds = {"bytes": pa.binary(), "single": pa.bool_(), "large": pa.bool_()}
    return emit({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()})


def pieces(run: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(first, last, core, whole) of each piece of a run: suffixes that start from first to last in it, the hash of
    what all windows at these distances from the anchor share, the hash of all bytes of the piece."""
    p = prefix(run)
    anchor, n = int(runs(run, length)[2][0]), len(run) - length
    out = []
    for c in range(max(0, anchor - n) // PIECE, anchor // PIECE + 1):
        high = anchor - PIECE * c
        a, z = max(0, high - PIECE + 1), min(n, high)
        at = np.array([high, a])
        core, whole = hashes(p, at, np.array([high - PIECE + 1 + length, z + length])).view(np.int64).tolist()
        out.append((a, z, core, whole ^ (z - a) << 8 ^ (high - z)))
    return out


def _opener(length: int):
    """Of documents with the runs to sort by window: runs of small groups, and pieces of the runs of large ones."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows: dict[str, list] = {k.split()[0]: [] for k in OPENED.split(", ")}
            for data, todo, doc, text_hash in zip(_bytes(b), b.column("todo"), b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), strict=True):
                raw = data.tobytes()
                for r in todo.as_py():
                    s, e = r["first"], r["last"]
                    for a, z, core, whole in pieces(data[s : e + length], length) if r["large"] else [(0, e - s, 0, 0)]:
                        for k, v in zip(rows, (r["digit"], core, whole, doc, text_hash, s + a, s + z, r["single"], raw[s + a : s + z + length], r["large"]), strict=True):
                            rows[k].append(v)
            yield _opened(rows)

    return opened


def _windows(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column("bytes").to_pylist()
            sizes = np.array([len(t) for t in texts])
            p = prefix(np.frombuffer(b"".join(texts), np.uint8))
            count = sizes - length + 1
            row = np.repeat(np.arange(len(texts)), count)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(np.cumsum(sizes) - sizes, count) + offset
            i = pa.array(row)
            rest = {k: b.column(k).take(i) for k in ("digit", "doc_id", "text_hash", "single")}
            yield emit(rest | {"window": pa.array(hashes(p, start, start + length).view(np.int64)), "first": pa.array(b.column("first").to_numpy()[row] + offset)})

    return cut


def _repeated(digit: np.ndarray, texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For whole groups of runs, sorted by digit: the run and the offset in it of each repeated window."""
    sizes = np.array([len(t) for t in texts])
    p = prefix(np.frombuffer(b"".join(texts), np.uint8))
    count = sizes - length + 1
    run = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(sizes) - sizes, count) + offset
    w = hashes(p, start, start + length)
    order = np.lexsort((w, digit[run]))
    w, d = w[order], digit[run][order]
    same = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    hit = np.zeros(len(w), bool)
    hit[1:] |= same
    hit[:-1] |= same
    return run[order[hit]], offset[order[hit]]


def _sorter(length: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch | None:
            run, offset = _repeated(t["digit"].to_numpy(), t["bytes"].to_pylist(), length)
            keep = t["single"].to_numpy()[run]
            run, offset = run[keep], offset[keep]
            if not len(run):
                return None
            order = np.lexsort((offset, run))
            run, offset = run[order], offset[order]
            new = np.append(True, (run[1:] != run[:-1]) | (offset[1:] != offset[:-1] + 1))
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(run)) - 1
            first = t["first"].to_numpy()[run[a]]
            i = pa.array(run[a])
            return emit(
                {
                    "doc_id": t["doc_id"].take(i).combine_chunks(),
                    "text_hash": t["text_hash"].take(i).combine_chunks(),
                    "first": pa.array(first + offset[a]),
                    "last": pa.array(first + offset[z]),
                }
            )

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            while b.num_rows:
                # Whole groups only: what has the last digit so far waits for more.
                held.append(b.slice(0, 512))
                size += held[-1].column("bytes").nbytes
                b = b.slice(512)
                if size > 400_000:
                    t = pa.Table.from_batches(held)
                    d = t["digit"].to_numpy()
                    cut = int(np.searchsorted(d, d[-1]))
                    if cut:
                        if out := done(t.slice(0, cut)):
                            yield out
                        held = t.slice(cut).combine_chunks().to_batches()
                        size = sum(x.column("bytes").nbytes for x in held)
        if held and (out := done(pa.Table.from_batches(held))):
            yield out

    return sort


def repeated_runs(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, text_hash, first, last): each row says that all windows that start from first to last in that
    document are repeated. docs: doc_id, text_hash and text as binary."""
    spark = docs.sparkSession
    found = written(docs.mapInArrow(_scanner(length), "digit long, whole long, doc_id long, text_hash long, first long, last long"), "runs")
    # Written, as a join right behind an aggregation has no exchange whose large partitions Spark could split.
    digits = written(found.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digit").alias("d")), "digits")
    left = written(found.join(digits, F.col("digit") == F.col("d"), "left_semi"), "left")
    dropped(found, digits)
    released(spark)
    distinct = left.groupBy("digit", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "first", "last")).alias("at"))
    distinct = written(distinct, "distinct")
    copied = distinct.where("n > 1").select(F.col("digit").alias("d"), F.col("whole").alias("w"))
    full = written(left.join(copied, (F.col("digit") == F.col("d")) & (F.col("whole") == F.col("w")), "left_semi").select("doc_id", "text_hash", "first", "last"), "full")
    groups = distinct.groupBy("digit").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    groups = written(groups.select(F.col("digit").alias("d"), (F.col("m") > group).alias("large")), "groups")
    todo = distinct.join(groups, F.col("digit") == F.col("d")).select("at.doc_id", "at.text_hash", F.struct("digit", "at.first", "at.last", (F.col("n") == 1).alias("single"), "large").alias("run"))
    todo = written(todo.groupBy("doc_id", "text_hash").agg(F.collect_list("run").alias("todo")), "todo")
    dropped(left, distinct, groups)
    released(spark)
    texts = joined(docs, todo, ["doc_id", "text_hash"])
    parts = written(texts.mapInArrow(_opener(length), OPENED), "opened")
    dropped(todo)
    released(spark)
    place = ["doc_id", "text_hash", "first", "last"]
    n = partitions(spark)
    small = parts.where("not large").select("digit", *place, "single", "bytes").repartition(n, "digit").sortWithinPartitions("digit")
    small = small.mapInArrow(_sorter(length), "doc_id long, text_hash long, first long, last long")
    large = parts.where("large").drop("large")
    kinds = large.groupBy("digit", "core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place, "single", "bytes")).alias("at"))
    kinds = written(kinds, "pieces")
    twice = kinds.where("n > 1").select(F.col("digit").alias("d"), F.col("core").alias("c"), F.col("whole").alias("w"))
    on = (F.col("digit") == F.col("d")) & (F.col("core") == F.col("c"))
    again = large.where("single").join(twice, on & (F.col("whole") == F.col("w")), "left_semi").select(*place)
    open_ = kinds.groupBy("digit", "core").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    open_ = open_.select(F.col("digit").alias("d"), F.col("core").alias("c"))
    last = kinds.join(open_, on, "left_semi").select("digit", "at.doc_id", "at.text_hash", "at.first", (F.col("at.single") & (F.col("n") == 1)).alias("single"), "at.bytes")
    last = written(last.mapInArrow(_windows(length), "digit long, doc_id long, text_hash long, single boolean, window long, first long"), "windows")
    shared = last.groupBy("digit", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digit").alias("d"), F.col("window").alias("w"))
    final = last.where("single").join(shared, (F.col("digit") == F.col("d")) & (F.col("window") == F.col("w")), "left_semi")
    final = final.select("doc_id", "text_hash", "first", F.col("first").alias("last"))
    out = written(full.unionByName(small).unionByName(again).unionByName(final), "repeated")
    dropped(parts, full, kinds, last)
    released(spark)
    return out


def _cutter(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            spans, kept, total = [], [], []
            for data, run in zip(_bytes(b), b.column("runs"), strict=True):
                own: list[tuple[int, int]] = []
                if run.is_valid and len(run):
                    first, last = (run.values.field(k).to_numpy() for k in ("first", "last"))
                    order = np.argsort(first, kind="stable")
                    first, end = first[order], np.maximum.accumulate(last[order] + length)
                    new = np.append(True, first[1:] > end[:-1])
                    a = np.flatnonzero(new)
                    own = list(zip(first[a].tolist(), end[np.append(a[1:], len(first)) - 1].tolist(), strict=True))
                raw, at, parts = data.tobytes(), 0, []
                for s, e in own:
                    parts.append(raw[at:s])
                    at = e
                parts.append(raw[at:])
                spans.append([{"start": s, "end": e} for s, e in own])
                kept.append(b"".join(parts))
                total.append(len(raw))
            yield emit(
                {
                    "doc_id": b.column("doc_id"),
                    "n_bytes": pa.array(total, pa.int64()),
                    "n_removed": pa.array([n - len(k) for n, k in zip(total, kept, strict=True)], pa.int64()),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    "kept": pa.array(kept, pa.binary()),
                }
            )

    return cut


def keyed(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text"))


def without_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Every row's doc_id, n_bytes, n_removed, spans (byte offsets of what is removed), kept_sha256 and kept (the
    remaining bytes)."""
    own = keyed(docs)
    found = repeated_runs(own, length, group).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    rows = joined(own, found, ["doc_id", "text_hash"], "left")
    return rows.mapInArrow(_cutter(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
