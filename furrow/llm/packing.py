"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

A document's size is its words between ASCII white space. A document of more than ``CAPACITY`` words fills
sequences of its own, piece by piece, and its last piece is packed like a short document. Documents
are dealt out at random, by a hash of id and text, to shards of about ``SHARD`` rows (a shard that comes out more than twice as large, as
equal rows make it, is packed in parts); in a shard, by falling size, each goes to the
fullest bin it fits into that holds nothing of its source and nothing of its duplicate cluster (texts that are
equal after lower-casing and collapsing white space). Bins are kept in order of what they have left;
each carries a bitmap of its sources and one of its clusters, and the search runs on through the
successors until a bin is compatible; if none is, a bin is opened. No document is dropped.

Null sources conflict with nothing; null and empty texts have size zero, belong to no cluster and take
a place of length zero. Texts may be of any length, and an empty table gives no rows. Repeated rows are separate documents of one cluster.
Null ids are allowed; ties fall by hash and id, so reruns agree. The caller's other columns, whatever their names, are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import chunked, column, documents, emit, partitions

CAPACITY = 2048
SHARD = 2048
SCHEMA = "doc_id long, source string, cluster long, size long, piece long, start long, length long, bin_id long, position long, bin_free long"


class Bins:
    """Open bins of one shard, ordered by what they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.left: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Places an item with the given bitmaps; returns its bin and its position there."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            residual, b = self.order[at]
            if not self.sources[b] & source and not self.clusters[b] & cluster:
                break
            at += 1
        if at < len(self.order):
            del self.order[at]
        else:
            residual, b = self.capacity, len(self.left)
            self.left.append(residual)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.left[b] = residual - size
        insort(self.order, (residual - size, b))
        return b, self.capacity - residual


def pack(items: Iterable[tuple[int, object, object]], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Packs (size, source, cluster), in the order given after sorting by falling last piece.

    Returns (item, piece, length, bin, position) of every piece, and what each bin has left."""
    items = list(items)
    bins = Bins(capacity)
    bit_s: dict[object, int] = {}
    bit_c: dict[object, int] = {}
    out = []
    rest = [n - capacity * ((n - 1) // capacity) if n else 0 for n, _, _ in items]
    for i in sorted(range(len(items)), key=lambda i: -rest[i]):
        n, source, cluster = items[i]
        s = 0 if source is None else 1 << bit_s.setdefault(source, len(bit_s))
        c = 0 if cluster is None else 1 << bit_c.setdefault(cluster, len(bit_c))
        full = (n - rest[i]) // capacity
        for k in range(full):
            bins.left.append(0)
            bins.sources.append(s)
            bins.clusters.append(c)
            insort(bins.order, (0, len(bins.left) - 1))
            out.append((i, k, capacity, len(bins.left) - 1, 0))
        out.append((i, full, rest[i], *bins.put(rest[i], s, c)))
    return out, bins.left


def _packer(capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, 0  # bins of a shard's earlier parts
        for (shard,), parts in chunked(batches, ["shard"], lambda _: most):
            last, used = shard, used if shard == last else 0
            rows = pa.Table.from_batches(parts)
            size, source, cluster = column(parts, "size").tolist(), rows["source"].to_pylist(), rows["cluster"].to_pylist()
            placed, left = pack(zip(size, source, cluster, strict=True), capacity)
            i, piece, length, b, position = map(list, zip(*placed, strict=True))
            got = rows.select(["doc_id", "source", "cluster", "size"]).take(pa.array(i)).combine_chunks().to_batches()[0]
            yield emit(
                {n: got.column(n) for n in ("doc_id", "source", "cluster", "size")}
                | {
                    "piece": pa.array(piece, pa.int64()),
                    "start": pa.array([k * capacity for k in piece], pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "bin_id": pa.array([(int(shard) << 32) + used + x for x in b], pa.int64()),
                    "position": pa.array(position, pa.int64()),
                    "bin_free": pa.array([left[x] for x in b], pa.int64()),
                }
            )
            used += len(left)

    return run


def items(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, cluster, h) of every row."""
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.when(F.length(plain) > 0, F.xxhash64(plain)).alias("cluster"),
        F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(8)).alias("h"),
    )


def packed(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row for each piece of every document: its bin, its position there and what the bin has left."""
    spark = docs.sparkSession
    n = max(1, -(-docs.count() // shard))
    rows = items(docs).withColumn("shard", F.pmod("h", F.lit(n)))
    dealt = rows.repartition(max(1, min(partitions(spark), n)), "shard").sortWithinPartitions("shard", "h", "doc_id", "source", "size", "cluster")
    return dealt.mapInArrow(_packer(capacity, 2 * shard), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
