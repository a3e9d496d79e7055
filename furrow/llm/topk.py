"""Exact top-k search by inner product: ball-tree branch and bound per shard.

Vectors are floor(64 x) of every component, which a double holds exactly. Rows are dealt into shards by place: a tree of median
splits, fitted on at most ``ROUTE`` vectors, names a cell of every vector, and a cell is cut along its widest direction
into shards of up to ``SHARD`` rows. A shard has a centre and a radius, so q.c + |q| r bounds all its scores. In a shard a ball
tree (median splits on the widest direction, leaves of up to ``LEAF`` rows) is searched from the node with the highest bound
down, and a node is skipped for the queries whose kth score is above its bound.

Queries go out in rounds (``ROUNDS``): each to the shard with its highest bound; then, as the kth score found so far is shared
with all shards, to the next few whose bound reaches it; then to all others that still do. The kth result goes along: of equal
scores only smaller vec_ids can still enter, so a shard that can't beat it is left out, and no shard returns what does not. Bounds are
taken between blocks of queries and packs of shards, and only pairs that can give a result are rows. Queries of a shard that many ask are
split into parts.

Scores are exact. Where squared norms are below 2 ** 53, so is every partial sum of a product, and doubles are exact; any other
vector (``big``) is scored with unbounded integers. Ranks follow the exact score; one beyond a long is shown as the nearest
long, and one of more than 38 digits is an error, as no column holds it.

Queries are the rows whose vec_id is divisible by ``EVERY``, candidates all rows but the query's own vec_id. Vectors that are
null or empty, hold null or non-finite components (64 x must be finite, too), or have no vec_id take no part; vectors of other
lengths than a query's never meet it. Repeated rows are separate candidates and one query. An empty table has no results.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.common import Cells, chunked, emit, groups, partitions, sliced, written

K, EVERY, SHARD, LEAF, BLOCK = 20, 20, 4096, 64, 256
#: Shards that each query goes to, round by round; then all that its kth score leaves.
ROUNDS = (1, 8)
#: Vectors the cells are fitted on; cells; shards whose bounds are taken at once; queries of a shard in one part.
ROUTE, CELLS, PACK, PART = 16_384, 1024, 1024, 8192
EXACT = 2.0**53


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(1))


def upper(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Bound of the scores of each query (row) with anything in each ball (column), a little above it for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        n = norms(q)[:, None]
        u = q @ centre.T + n * radius[None] + 1e-9 * (1 + n * (norms(centre)[None] + radius[None]))
    return np.where(np.isnan(u), np.inf, u)


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    with np.errstate(over="ignore", invalid="ignore"):
        centre = x.mean(0)
        radius = float(norms(x - centre).max())
    return (centre, radius) if np.isfinite(radius) else (np.zeros(x.shape[1]), np.inf)


class BallTree:
    """A ball tree of integer vectors, searched for blocks of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        self.spans: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        centres, radii = [], []
        todo = [(0, len(x), -1)] if len(x) else []
        while todo:
            a, z, parent = todo.pop()
            part = x[order[a:z]]
            centre, radius = ball(part)
            me = len(self.spans)
            self.spans.append((a, z))
            self.children.append([])
            centres.append(centre)
            radii.append(radius)
            if parent >= 0:
                self.children[parent].append(me)
            if z - a > leaf and 0 < radius < np.inf:
                away = part - centre
                far = away[np.argmax((away * away).sum(1))]
                order[a:z] = order[a:z][np.argsort(away @ far, kind="stable")]
                mid = (a + z) // 2
                todo += [(a, mid, me), (mid, z, me)]
        self.ids, self.x = ids[order], x[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of the k best of each query that reach ``floor``; squared norms are below 2 ** 53."""
        none = np.iinfo(np.int64).max
        best_s = np.full((len(q), k), -np.inf)
        best_i = np.full((len(q), k), none)
        kth = floor.astype(float).copy()
        if not self.spans:
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        # Nodes by the highest bound of any query that is left.
        heap = [(-np.inf, 0, np.arange(len(q)), upper(q, self.centres[:1], self.radii[:1])[:, 0])]
        while heap:
            _, node, rows, bound = heapq.heappop(heap)
            rows = rows[bound >= kth[rows]]
            if not len(rows):
                continue
            below = self.children[node]
            if below:
                u = upper(q[rows], self.centres[below], self.radii[below])
                for i, child in enumerate(below):
                    heapq.heappush(heap, (-float(u[:, i].max()), child, rows, u[:, i]))
                continue
            a, z = self.spans[node]
            s = q[rows] @ self.x[a:z].T
            s[qid[rows][:, None] == self.ids[None, a:z]] = -np.inf
            s[s < kth[rows][:, None]] = -np.inf
            hit = np.flatnonzero(s.max(1) > -np.inf)
            if not len(hit):
                continue
            rows, s = rows[hit], s[hit]
            alls = np.concatenate([best_s[rows], s], 1)
            alli = np.concatenate([best_i[rows], np.where(s > -np.inf, self.ids[None, a:z], none)], 1)
            at = np.lexsort((alli, -alls), axis=1)[:, :k]
            best_s[rows], best_i[rows] = np.take_along_axis(alls, at, 1), np.take_along_axis(alli, at, 1)
            kth[rows] = np.maximum(kth[rows], best_s[rows, -1])
        row, place = np.nonzero(best_s > -np.inf)
        return row, best_i[row, place], best_s[row, place]


def whole(x: np.ndarray) -> np.ndarray:
    """The same numbers as integers without bounds."""
    return np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)


def search_whole(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, floor: list[int | None], k: int) -> tuple[list[int], list[int], list[int]]:
    """As BallTree.search, for vectors of any size: every score as an integer."""
    rows, found, scores = [], [], []
    names = ids.tolist()
    for a in range(0, len(q), 64):
        s = whole(q[a : a + 64]) @ whole(x).T
        for r, line in enumerate(s.tolist(), a):
            able = ((-v, i) for v, i in zip(line, names, strict=True) if i != qid[r] and (floor[r] is None or v >= floor[r]))
            for v, i in heapq.nsmallest(k, able):
                rows.append(r)
                found.append(i)
                scores.append(-v)
    return rows, found, scores


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        v, ids = b.column("v"), b.column("id").to_numpy()
        size = pc.list_value_length(v).to_numpy()
        values, start = v.flatten().to_numpy(), np.cumsum(size) - size
        for dim in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == dim)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(64 * values[start[at][:, None] + np.arange(dim)]) + 0.0  # one of the two zeros
                square = (x * x).sum(1)
            ok = np.isfinite(x).all(1)
            raw = [r.tobytes() for r in x[ok]]
            yield emit({"id": pa.array(ids[at][ok]), "dim": pa.array(np.full(len(raw), dim)), "big": pa.array(square[ok] >= EXACT), "vector": pa.array(raw, pa.binary())})


def _placer(cells: dict[int, Cells]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            dims = b.column("dim").to_numpy()
            cell, along = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                if dim in cells:
                    at = np.flatnonzero(dims == dim)
                    cell[at], along[at] = cells[dim].of(_matrix(b.column("vector").take(pa.array(at)).to_pylist()))
            yield emit({n: b.column(n) for n in b.schema.names} | {"cell": pa.array(cell), "along": pa.array(along)})

    return place


def _sharder(shard: int):
    """Rows with the shard they are in, and a row for each shard: its smallest id, its centre as vector, and its radius."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        # A shard has some megabytes at the most, however long its vectors.
        for (dim, big, _), parts in chunked(batches, ["dim", "big", "cell"], lambda k: max(LEAF, min(shard, (1 << 23) // (8 * int(k[0]))))):
            name, n = task << 32 | nth, sum(p.num_rows for p in parts)
            raw = [v for p in parts for v in p.column("vector").to_pylist()]
            centre, radius = ball(_matrix(raw))
            ids = np.concatenate([p.column("id").to_numpy() for p in parts])
            for kind, i, v, r in ((0, ids, raw, np.zeros(n)), (1, ids.min(keepdims=True), [centre.tobytes()], np.array([radius]))):
                same = {k: pa.array(np.full(len(v), x)) for k, x in (("dim", dim), ("shard", name), ("kind", kind))}
                yield emit({"id": pa.array(i), "vector": pa.array(v, pa.binary()), "radius": pa.array(r), "big": pa.array(np.full(len(v), bool(big)))} | same)
            nth += 1

    return deal


def _bounder(width: int | None):
    """For each query of a block: the shards of a pack whose bound reaches its kth score, the ``width`` highest of them."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            asked, pack = b.column("asked")[0].as_py(), b.column("pack_of")[0].as_py()
            q, c = _matrix([a["vector"] for a in asked]), _matrix([p["centre"] for p in pack])
            u = upper(q, c, np.array([p["radius"] for p in pack]))
            kth = np.array([-np.inf if a["floor"] is None else float(a["floor"]) for a in asked])
            last = np.array([np.iinfo(np.int64).max if a["last"] is None else a["last"] for a in asked])
            low = np.array([p["low"] for p in pack])
            # Scores are whole numbers: below kth + 1 a shard can only tie, and then needs a smaller id.
            open_ = (u >= kth[:, None]) & ((u >= kth[:, None] + 1) | (low[None] < last[:, None]))
            names = np.array([p["shard"] for p in pack])
            for i, a in enumerate(asked):
                if a["sent"]:
                    open_[i] &= ~np.isin(names, a["sent"])
            u = np.where(open_, u, -np.inf)
            if width is not None and width < len(names):
                drop = np.argpartition(-u, width - 1, axis=1)[:, width:]
                np.put_along_axis(open_, drop, False, 1)
            i, j = np.nonzero(open_)
            yield emit({"id": pa.array(np.array([a["id"] for a in asked])[i]), "copy": pa.array(np.array([a["copy"] for a in asked])[i]), "shard": pa.array(names[j]), "bound": pa.array(u[i, j])})

    return bound


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for (shard, part, kind), parts in groups(batches, ["shard", "part", "kind"]):
            ids = np.concatenate([p.column("id").to_numpy() for p in parts])
            big = np.concatenate([p.column("big").to_numpy(zero_copy_only=False) for p in parts])
            x = _matrix([v for p in parts for v in p.column("vector").to_pylist()])
            if kind == 0:
                held = (shard, part), ids, x, bool(big[0]), None if big[0] else BallTree(ids, x)
                continue
            if held is None or held[0] != (shard, part):
                raise RuntimeError("queries without their shard")
            copy = np.concatenate([p.column("copy").to_numpy() for p in parts])
            floor = [None if f is None else int(f) for p in parts for f in p.column("floor").to_pylist()]
            last = [i for p in parts for i in p.column("last").to_pylist()]
            for one in (False, True):
                mine = np.flatnonzero((big | held[3]) == one)
                for at in (mine[i : i + BLOCK] for i in range(0, len(mine), BLOCK)):
                    low = [floor[i] for i in at.tolist()]
                    if one:
                        row, i, s = search_whole(held[1], held[2], ids[at], x[at], low, k)
                        new = [n for n, r in enumerate(row) if low[r] is None or s[n] > low[r] or i[n] < last[at[r]]]
                        row, i, s = ([y[n] for n in new] for y in (row, i, s))
                        if any(abs(v) >= 10**38 for v in s):
                            raise OverflowError("a score has more than 38 digits")
                        scores = pa.array(s, pa.decimal128(38, 0))
                    else:
                        row, i, s = held[4].search(ids[at], x[at], np.array([-np.inf if f is None else float(f) for f in low]), k)
                        least = np.array([-np.inf if f is None else float(f) for f in low])[row]
                        new = (s > least) | (i < np.array([0 if n is None else n for n in last], np.int64)[at][row])
                        row, i, s = row[new], i[new], s[new]
                        scores = pa.array(s.astype(np.int64)).cast(pa.decimal128(38, 0))
                    yield emit({"query": pa.array(ids[at][row]), "copy": pa.array(copy[at][row]), "vec_id": pa.array(i, pa.int64()), "score": scores})

    return search


FOUND = "query long, copy long, vec_id long, score decimal(38,0)"


def top_k(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = K, every: int = EVERY, shard: int = SHARD, part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every query, all if there are fewer."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    packed = written(rows.mapInArrow(_floors, "id long, dim long, big boolean, vector binary"), "vectors")
    n = packed.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed, tasks = packed.withColumns({"cell": F.lit(0).cast("long"), "along": F.lit(0.0)}), 1
    if n > shard:
        sample: dict[int, list[bytes]] = {}
        for r in packed.orderBy(F.xxhash64("id", "vector")).select("dim", "vector").limit(ROUTE).collect():
            sample.setdefault(r.dim, []).append(r.vector)
        cells = {d: Cells(_matrix(v), min(CELLS, -(-n // shard))) for d, v in sample.items()}
        placed = packed.mapInArrow(_placer(cells), "id long, dim long, big boolean, vector binary, cell long, along double")
        tasks = max(1, min(partitions(spark), n // shard))
    order = ["dim", "big", "cell", "along", "id"]
    dealt = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    dealt = written(dealt.mapInArrow(_sharder(shard), "id long, vector binary, radius double, big boolean, dim long, shard long, kind long"), "shards")
    balls, members = dealt.where("kind = 1"), dealt.where("kind = 0")
    shards = balls.count()
    packs = max(1, -(-shards // PACK))
    packed_balls = balls.withColumn("pack", F.pmod(F.xxhash64("shard"), F.lit(packs))).groupBy("dim", "pack")
    packed_balls = packed_balls.agg(F.collect_list(F.struct("shard", F.col("vector").alias("centre"), "radius", F.col("id").alias("low"))).alias("pack_of"))
    # Queries of one id are told apart by their vectors; equal ones are one query.
    asked = packed.where(F.col("id") % every == 0).withColumn("copy", F.xxhash64("vector")).select("id", "copy", "dim", "big", "vector").distinct()
    asked = written(asked, "queries")
    blocks = max(1, asked.count() // BLOCK)
    state = asked.withColumns({"floor": F.lit(None).cast("decimal(38,0)"), "last": F.lit(None).cast("long"), "sent": F.array().cast("array<long>")})
    ranked = Window.partitionBy("query", "copy").orderBy(F.desc("score"), "vec_id")
    best = sent = None
    asked_of = 0  # shards that every query has been to, unless its kth score ruled them out
    for width in (*ROUNDS, None):
        block = state.withColumn("block", F.pmod(F.xxhash64("id", "copy"), F.lit(blocks))).groupBy("dim", "block")
        block = block.agg(F.collect_list(F.struct("id", "copy", "vector", "floor", "last", "sent")).alias("asked"))
        block = block.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))))
        pairs = block.join(packed_balls, ["dim", "pack"]).select("asked", "pack_of").repartition(min(partitions(spark), blocks * packs))
        pairs = pairs.mapInArrow(_bounder(width), "id long, copy long, shard long, bound double")
        if width is not None and packs > 1:
            first = Window.partitionBy("id", "copy").orderBy(F.desc("bound"), "shard")
            pairs = pairs.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= width)
        pairs = written(pairs.select("id", "copy", "shard"), "pairs")
        if pairs.isEmpty():
            break
        load = pairs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / part).cast("long").alias("parts"))
        trees = members.join(load, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        trees = trees.select("shard", "part", "kind", "id", F.lit(0).cast("long").alias("copy"), "big", "vector", F.lit(None).cast("decimal(38,0)").alias("floor"), F.lit(None).cast("long").alias("last"))
        to = pairs.join(load, "shard").join(state, ["id", "copy"]).withColumn("part", F.pmod(F.xxhash64("id", "copy"), "parts"))
        to = to.select("shard", "part", F.lit(1).cast("long").alias("kind"), "id", "copy", "big", "vector", "floor", "last")
        every_row = trees.unionByName(to).repartition(partitions(spark), "shard", "part").sortWithinPartitions("shard", "part", "kind", "id")
        found = every_row.mapInArrow(_searcher(k), FOUND)
        found = found if best is None else found.unionByName(best)
        best = written(found.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= k).drop("nth"), "best")
        asked_of += width or shards
        if asked_of >= shards:
            break
        kth = best.groupBy(F.col("query").alias("id"), "copy").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct((-F.col("score")).alias("under"), "vec_id")).alias("kth"))
        kth = kth.where(F.col("n") >= k).select("id", "copy", (-F.col("kth.under")).cast("decimal(38,0)").alias("floor"), F.col("kth.vec_id").alias("last"))
        sent = pairs if sent is None else sent.unionByName(pairs)
        gone = sent.groupBy("id", "copy").agg(F.collect_list("shard").alias("sent"))  # at most sum(ROUNDS) a query
        state = asked.join(kth, ["id", "copy"], "left").join(gone, ["id", "copy"], "left")
        state = written(state.withColumn("sent", F.coalesce("sent", F.array().cast("array<long>"))), "asked")
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = best.withColumn("rank", F.row_number().over(ranked))
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    shown = F.greatest(F.least("score", top), -top - 1).cast("long")
    return out.select(F.col("query").alias("query_id"), "rank", "vec_id", shown.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
