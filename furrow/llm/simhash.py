"""SimHash near-duplicates, with pigeonring filtering of candidates.

Fingerprints of 64 bits within 4 differing bits are linked. Cut into five consecutive segments on a
ring, two such fingerprints agree in at least one segment from which the differences added up along
the ring stay within l * 4 / 5 after l segments, for every l (pigeonring principle). So fingerprints
are dealt out by the value of each segment, and within a bucket the chain that starts there is
checked segment by segment before the full Hamming distance. A bucket passes on only the stars of
its own components, never its pairs. A bucket with more than ``BUCKET`` fingerprints is dealt
again by two segments, the second with at most one bit changed, which is the chain's second budget.

Null texts count as empty; texts without words have fingerprint zero and are linked like others.
Repeated rows, ids or texts are separate documents; null ids take part, but never name a component
unless all ids of it are null. Texts may be of any length; an empty table gives no rows. More columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import column, components, documents, emit, groups, partitions, roots, sliced, small_batches, written

WORDS, SEED, DISTANCE = 4, 42, 4
#: Widths of the segments, from the lowest bit.
SEGMENTS = (13, 13, 13, 13, 12)
BUCKET = 8192
_AT = [sum(SEGMENTS[:i]) for i in range(len(SEGMENTS))]
_MASK = [np.uint64(((1 << w) - 1) << a) for a, w in zip(_AT, SEGMENTS, strict=True)]


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    take = min(WORDS, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - take + 1].tolist()
    ends = ends[take - 1 :].tolist()
    digest, n, ones = xxhash.xxh64_digest, len(starts), np.zeros(64, np.int64)
    for i in range(0, n, 65_280):
        h = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + 65_280], ends[i : i + 65_280], strict=True)])
        bits = np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
        yield emit({"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"), "fp": pa.array(fp.view(np.int64))})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def linked(fps: np.ndarray, segment: int, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (as stars) between distinct fingerprints that agree in ``segment``; fps unsigned."""
    n, ring = len(fps), len(SEGMENTS)
    label = np.arange(n)
    step = max(1, min(n, 1_000_000 // n))
    for i in range(0, n, step):
        x = fps[i : i + step, None] ^ fps[None, i:]
        at_a, at_b = np.nonzero(np.bitwise_count(x & _MASK[(segment + 1) % ring]) <= 2 * distance // ring)
        keep = at_b > at_a
        at_a, at_b = at_a[keep], at_b[keep]
        x = x[at_a, at_b]
        total = np.bitwise_count(x & _MASK[(segment + 1) % ring]).astype(np.int64)
        for length in range(3, ring + 1):
            total += np.bitwise_count(x & _MASK[(segment + length - 1) % ring])
            ok = total <= length * distance // ring
            at_a, at_b, x, total = at_a[ok], at_b[ok], x[ok], total[ok]
        ok = np.bitwise_count(x) <= distance
        if ok.any():
            # The step's links and the stars so far become stars: never more than n of them are held.
            held = np.flatnonzero(label != np.arange(n))
            nodes, low = roots(np.concatenate([i + at_a[ok], held]), np.concatenate([i + at_b[ok], label[held]]))
            label[nodes] = low
    held = np.flatnonzero(label != np.arange(n))
    return fps[held], fps[label[held]]


def _bucket_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        return emit({"a": pa.array(np.concatenate([x for x, _ in out])), "b": pa.array(np.concatenate([y for _, y in out]))})

    for (key,), parts in groups(batches, ["key"]):
        fps = np.unique(column(parts, "fp")).view(np.uint64)
        if len(fps) < 2:
            continue
        a, b = linked(fps, int(key) >> 59 & 7)
        if len(a):
            nodes, low = roots(a.view(np.int64), b.view(np.int64))
            keep = nodes != low
            out.append((nodes[keep], low[keep]))
            held += int(keep.sum())
        if held > 100_000:
            yield flush()
            out, held = [], 0
    if held:
        yield flush()


def _value(segment: int):
    return F.shiftrightunsigned(F.col("fp"), _AT[segment]).bitwiseAND((1 << SEGMENTS[segment]) - 1)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that span the components of the distinct fingerprints ``fps`` (a column fp)."""
    spark = fps.sparkSession
    n = partitions(spark)
    keys = [F.lit(i << 59).bitwiseOR(_value(i)) for i in range(len(SEGMENTS))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key")
    # At most five fingerprints' worth of keys of 2 ** 13 values each: 40,960 rows, a proven bound.
    large = F.broadcast(large)
    plain = rows.join(large, "key", "left_anti")
    again = []
    for i in range(len(SEGMENTS)):
        j = (i + 1) % len(SEGMENTS)
        masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(SEGMENTS[j])])
        hot = rows.where(F.shiftrightunsigned("key", 59) == i).join(large, "key", "left_semi")
        value = _value(j)
        near = F.transform(masks, lambda m: F.col("key").bitwiseOR(F.shiftleft(value.bitwiseXOR(m) + 1, 20)))  # noqa: B023
        again.append(hot.select("fp", F.explode(near).alias("key")))
    for x in again:
        plain = plain.unionByName(x)
    dealt = plain.select("key", "fp").repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_bucket_stars, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row of ``docs``; component_id is the smallest doc_id of
    all documents that links reach, root a fingerprint that names the component."""
    prints = written(fingerprints(docs), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    # Written, so that no task runs two Python functions at a time.
    found = components(written(links(first.select("fp")), "links"))
    rooted = first.join(found, first["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # Both sides of the join are written, so that Spark can split the rows of a large component.
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    named = rooted.join(least, "root").select(F.col("fp").alias("of"), "root", "component_id")
    return prints.join(named, prints["fp"] == named["of"]).select("doc_id", "text_hash", "fp", "root", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
