"""What the text operators share: tables in the shared folder, streaming over sorted groups, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session that has none (tests) gets a temporary one, a cluster an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            at = found.get()
        elif not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            at = tempfile.mkdtemp(prefix="furrow-")
            sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/furrow-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._furrow_path = path  # for dropped()
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_furrow_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows``, unless the session asks for another number than Spark's default: of texts, the
    default makes batches of tens of megabytes, several copies of which are held on both sides at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key() -> list[Column]:
    """Names a document by doc_id and a hash of its text: rows that agree in both are the same text
    under the same id, so what is true of one is true of the other."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")]


def joined(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` where the named columns are equal, null to null; one set of them is kept."""
    right = b.withColumnsRenamed({n: f"_right_{n}" for n in names})
    on = F.lit(True)
    for i, n in enumerate(names):
        eq = F.col(n).eqNullSafe(F.col(f"_right_{n}"))
        on = on & eq if i else eq
    return a.join(right, on, how).drop(*[f"_right_{n}" for n in names])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal keys in a partition sorted by them, each as a list of slices."""
    key: tuple | None = None
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], b.num_rows)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            k = tuple(c[s] for c in cols)
            if key is not None and k != key:
                yield key, held
                held = []
            key = k
            held.append(b.slice(s, e - s))
    if key is not None:
        yield key, held


def chunked(batches: Iterator[pa.RecordBatch], keys: list[str], most: Callable[[tuple], int]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Like groups(), but a run of equal keys comes in chunks of up to ``most`` (key) rows, so that none is held whole."""
    key: tuple | None = None
    held: list[pa.RecordBatch] = []
    n = 0
    for b in sliced(batches):
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        change[:1] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
            k = tuple(c[s] for c in cols)
            while s < e:
                if held and (k != key or n >= most(key)):
                    yield key, held
                    held, n = [], 0
                key = k
                take = min(e - s, max(1, most(k) - n))
                held.append(b.slice(s, take))
                s, n = s + take, n + take
    if held:
        yield key, held


class Cells:
    """Median splits along the widest directions of a bounded sample of vectors: near vectors share a cell."""

    def __init__(self, x: np.ndarray, cells: int):
        self.directions, self.limits, self.below = [], [], []
        todo, leaves = [(np.arange(len(x)), -1, 0)], 1
        while todo:
            at, parent, side = todo.pop(0)
            with np.errstate(over="ignore", invalid="ignore"):
                part = x[at]
                away = part - part.mean(0)
                size = np.nan_to_num((away * away).sum(1))
                far = np.nan_to_num(away[np.argmax(size)]) if len(at) else np.zeros(x.shape[1])
                top = np.abs(far).max(initial=0)
                far = far / top if top > 0 else far
                place = np.nan_to_num(part @ far)
            limit = float(np.median(place)) if len(at) else 0.0
            me = len(self.directions)
            self.directions.append(far)
            self.limits.append(limit)
            self.below.append([-1, -1])
            if parent >= 0:
                self.below[parent][side] = me
            low = place <= limit
            if leaves < cells and 0 < low.sum() < len(at):
                leaves += 1
                todo += [(at[low], me, 0), (at[~low], me, 1)]
        self.directions, self.limits, self.below = np.array(self.directions), np.array(self.limits), np.array(self.below)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and where it lies along the cell's widest direction."""
        node = np.zeros(len(x), np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            while True:
                place = np.nan_to_num(np.einsum("ij,ij->i", x, self.directions[node]))
                to = np.where(place <= self.limits[node], self.below[node, 0], self.below[node, 1])
                if (to < 0).all():
                    return node, place
                node = np.where(to < 0, node, to)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows``, so that what a task holds besides its input stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def column(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(name).to_numpy(zero_copy_only=False) for p in parts])


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of the edges (a, b) and for each the smallest node that it reaches."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a partition's edges by stars of the same components, some batches at a time."""
    a, b, n = [], [], 0

    def flush() -> pa.RecordBatch:
        nodes, low = roots(np.concatenate(a), np.concatenate(b))
        keep = nodes != low
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(low[keep])], names=["a", "b"])

    for x in batches:
        a.append(x.column(0).to_numpy())
        b.append(x.column(1).to_numpy())
        n += x.num_rows
        if n > 1_000_000:
            yield flush()
            a, b, n = [], [], 0
    if n:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns): root is the smallest reachable node.

    Alternating large-star and small-star steps on distributed edges; each round first contracts
    what lies in one partition and is written to the shared folder. Least neighbours are written before they are joined, so
    that Spark can split the edges of a hub. No null nodes.
    """
    spark = edges.sparkSession
    e = edges.toDF("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long")
    e = written(e.distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        seen, old = mark, e
        both = e.union(e.select("b", "a"))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), "low")
        large = both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(large.distinct(), "stars")
        least = written(small.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"), "least")
        star = small.join(least, small["a"] == least["k"])
        star = star.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        star = star.select("x.a", "x.b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct()
        e = written(star, "edges")
        dropped(old, low, small, least)


def emit(rows: dict[str, Callable | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))
