"""Near-duplicates of embeddings by cosine: NN-descent, audited, with exact counts.

Vectors that are equal in every component are one node with a count. A neighbour graph starts from cells of random
hyperplanes and is refined by NN-descent: every node introduces its neighbours and those that list it to
each other, and each keeps its best. Lists of ``K`` neighbours that are full of links are doubled for the next round, up to
``K_MOST``; a full list keeps its ``K`` weakest links, too, as it is these that join one dense group to another, and they introduce
like others. Cells and circles are compared whole, in overlapping windows of ``BLOCK`` where they are larger. Rounds end when few lists change. Candidate
edges are checked in double precision and those of at least
``THRESHOLD`` are links. The recall is audited: up to ``AUDIT`` vectors, chosen by hash, are compared with all
others in blocks; while the graph misses more than one in a hundred of their links it is refined again from new hyperplanes, and
links of all refinements count. After ``TRIES`` of them a recall below ``LEAST`` is an error, so no result has less; the figure is the
attribute ``recall`` of the result. Links that the audit itself has found join the graph in the end.

All links of a vector lie in its component. So the number of links is counted there, members against members in blocks of ``BLOCK``,
however many there are, and only counts leave a block: lists are bounded, counts aren't.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id, link with
nothing: n_links 0, a component of their own (null for a null vec_id), kept. Vectors of different lengths never
meet. Repeated rows link with each other. An empty table gives no rows. Other columns, labels among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import components, dropped, emit, groups, partitions, released, sliced, written

THRESHOLD, K, K_MOST, ROUNDS = 0.9, 8, 32, 3
#: Hyperplane tables, rows of a cell, rows compared at once.
TABLES, CELL, BLOCK = 8, 128, 512
AUDIT, RECALL, LEAST, TRIES = 256, 0.99, 0.9, 6
#: Approximate similarities may be this far off.
SLACK = 0.01


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = []
        for v in b.column("v").to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            # + 0.0 makes one of the two zeros.
            raw.append((x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield emit({"vec_id": b.column("vec_id"), "vector": pa.array(raw, pa.binary())})


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the unit vector in half precision."""
    for b in batches:
        raw = b.column("vector").to_pylist()
        small = [_unit([r]).astype(np.float16).tobytes() for r in raw]
        yield emit({n: b.column(n) for n in b.schema.names} | {"small": pa.array(small, pa.binary())})


def _cells(bits: int, seed: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, TABLES * (bits + 1)))
                small = b.column("small").take(pa.array(at))
                x = np.frombuffer(b"".join(small.to_pylist()), np.float16).reshape(len(at), dim).astype(np.float32)
                y = (x @ planes[dim]).reshape(len(at), TABLES, bits + 1)
                cell = (y[:, :, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                rep = pa.array(np.repeat(np.arange(len(at)), TABLES))
                yield emit(
                    {
                        "dim": pa.array(np.full(len(rep), dim, np.int64)),
                        "cell": pa.array((np.arange(TABLES) << 40 | cell).ravel()),
                        "along": pa.array(y[:, :, bits].astype(np.float64).ravel()),
                        "node": b.column("node").take(pa.array(at)).take(rep),
                        "small": small.take(rep),
                    }
                )

    return cells


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Some rows at a time of a partition sorted by ``keys``, never less than all of a key; of keys with more than ``most`` rows windows of
    as many, each with half of the one before."""
    held: pa.Table | None = None
    for b in sliced(batches, most):
        t = pa.Table.from_batches([b])
        held = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        cols = [held[k].to_numpy() for k in keys]
        last = np.logical_and.reduce([c == c[-1] for c in cols])
        start = int(held.num_rows - np.argmin(last[::-1])) if not last.all() else 0
        if start:
            yield held.slice(0, start)
            held = held.slice(start)
        while held.num_rows > most:
            yield held.slice(0, most)
            held = held.slice(most // 2)
    if held is not None and held.num_rows:
        yield held


def _meet(own: str, many: bool):
    """Members of one cell or circle (the column ``own``) and the best others of each."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole(batches, ["dim", own], BLOCK):
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim)) if (dims != dim).any() else b
                x = np.frombuffer(b"".join(part.column("small").to_pylist()), np.float16).reshape(part.num_rows, -1).astype(np.float32)
                group, node = part.column(own).to_numpy(), part.column("node").to_numpy()
                k = part.column("k").to_numpy() if many else np.full(len(node), K)
                kth = part.column("kth").to_numpy() if many else np.full(len(node), -1.0)
                edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                a, c, s = [], [], []
                for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(group)], strict=True):
                    if j - i < 2:
                        continue
                    sim = x[i:j] @ x[i:j].T
                    sim[node[i:j, None] == node[None, i:j]] = -2
                    most = min(int(k[i:j].max()), j - i - 1)
                    best = np.argpartition(-sim, most - 1, axis=1)[:, :most]
                    got = np.take_along_axis(sim, best, 1)
                    row, col = np.nonzero((got > kth[i:j, None]) & (got > -1.5))
                    a.append(node[i + row])
                    c.append(node[i + best[row, col]])
                    s.append(got[row, col])
                if a:
                    yield emit({"node": pa.array(np.concatenate(a)), "near": pa.array(np.concatenate(c)), "sim": pa.array(np.round(np.concatenate(s).astype(np.float64), 5))})

    return meet


EDGE = "node long, near long, sim double"


def _lists(edges: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """(node, k, list of (sim, near), kth) with each node's k best edges and, beyond them, its K weakest links."""
    best = edges.groupBy("node").agg(F.collect_set(F.struct("sim", "near")).alias("list"))
    best = best.join(wide, "node", "left").withColumn("k", F.coalesce("k", F.lit(K))) if wide is not None else best.withColumn("k", F.lit(K))
    best = best.withColumn("list", F.sort_array("list", asc=False))
    full = F.size("list") >= F.col("k")
    best = best.withColumn("kth", F.when(full, F.get("list", F.col("k").cast("int") - 1)["sim"]).otherwise(F.lit(-1.0)))
    rest = F.filter(F.slice("list", F.col("k").cast("int") + 1, F.size("list")), lambda e: e["sim"] >= THRESHOLD - SLACK)
    return best.withColumn("list", F.concat(F.slice("list", 1, F.col("k")), F.slice(F.reverse(rest), 1, K)))


def graph(nodes: DataFrame, count: int, seed: int, before: DataFrame | None = None) -> DataFrame:
    """Edges (node, near, sim) of the refined neighbour graph; sim is approximate. nodes: node, dim, small."""
    spark = nodes.sparkSession
    n = partitions(spark)
    bits = max(1, min(30, round(np.log2(max(2, count / CELL)))))
    rows = nodes.select("node", "dim", "small").mapInArrow(_cells(bits, seed), "dim long, cell long, along double, node long, small binary")
    dealt = rows.repartitionByRange(n, "dim", "cell", "along").sortWithinPartitions("dim", "cell", "along")
    edges = dealt.mapInArrow(_meet("cell", False), EDGE)
    lists = written(_lists(edges if before is None else edges.unionByName(before)), "lists")
    for _ in range(ROUNDS):
        flat = lists.select("node", F.inline("list")).select("node", "near", "sim")
        circle = flat.select(F.col("node").alias("by"), F.col("near").alias("node"))
        circle = circle.union(flat.select(F.col("near").alias("by"), "node")).union(lists.select(F.col("node").alias("by"), "node")).distinct()
        known = lists.select("node", F.when(F.col("kth") >= THRESHOLD - SLACK, F.least(2 * F.col("k"), F.lit(K_MOST))).otherwise(F.col("k")).alias("k"), "kth")
        known = known.withColumn("kth", F.when(F.col("kth") >= THRESHOLD - SLACK, F.lit(THRESHOLD - SLACK)).otherwise(F.col("kth")))
        members = circle.join(nodes.select("node", "dim", "small").join(known, "node"), "node")
        dealt = members.repartitionByRange(n, "dim", "by", "node").sortWithinPartitions("dim", "by", "node")
        new = dealt.select("dim", "by", "node", "small", "k", "kth").mapInArrow(_meet("by", True), EDGE)
        old, lists = lists, written(_lists(flat.unionByName(new), known.select("node", "k")), "lists")
        changed = lists.join(old.select("node", F.col("list").alias("was")), "node").where(F.size(F.array_except("list", "was")) > 0).count()
        dropped(old)
        released(spark)
        if changed <= 0.01 * count:
            break
    return lists.select("node", F.inline("list")).select("node", "near", "sim")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 4096):
        ok = np.zeros(b.num_rows, bool)
        va, vb = b.column("va").to_pylist(), b.column("vb").to_pylist()
        size = np.array([len(x) for x in va])
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            ok[at] = (_unit([va[i] for i in at]) * _unit([vb[i] for i in at])).sum(1) >= THRESHOLD
        yield emit({k: b.column(k).filter(pa.array(ok)) for k in ("a", "b")})


def checked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links (a, b), a < b, among candidate edges."""
    pair = edges.where(F.col("sim") >= THRESHOLD - SLACK).select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).distinct()
    pair = pair.join(nodes.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a").join(nodes.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b")
    return pair.select("a", "b", "va", "vb").mapInArrow(_exact, "a long, b long")


def _auditor(queries: list[tuple[int, int, bytes]]):
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {d for _, d, _ in queries}:
            own = [(i, v) for i, d, v in queries if d == dim]
            by[dim] = np.array([i for i, _ in own]), _unit([v for _, v in own])
        for b in sliced(batches, 4096):
            dims, node = b.column("dim").to_numpy(), b.column("node").to_numpy()
            for dim, (ids, q) in by.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    x = _unit(b.column("vector").take(pa.array(at)).to_pylist())
                    i, j = np.nonzero(x @ q.T >= THRESHOLD)
                    keep = node[at[i]] != ids[j]
                    yield emit({"a": pa.array(ids[j][keep]), "b": pa.array(node[at[i]][keep])})

    return audit


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, parts in groups(batches, ["root", "i", "j"]):
        t = pa.Table.from_batches(parts)
        side, node, copies = (t[k].to_numpy() for k in ("side", "node", "copies"))
        x = _unit(t["vector"].to_pylist())
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(a) and len(b):
            hit = x[a] @ x[b].T >= THRESHOLD
            hit &= node[a][:, None] != node[b][None]
            yield emit({"node": pa.array(node[a]), "links": pa.array((hit @ copies[b].astype(np.float64)).astype(np.int64))})


def link_counts(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, links): links of each member within its component. members: root, node, vector, copies."""
    spark = members.sparkSession
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select("root", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    rows = members.join(size, "root").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    a = rows.withColumn("j", other).select("root", F.col("own").alias("i"), "j", F.lit(0).alias("side"), "node", "copies", "vector")
    b = rows.withColumn("i", other).select("root", "i", F.col("own").alias("j"), F.lit(1).alias("side"), "node", "copies", "vector")
    dealt = a.unionByName(b).repartition(partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(_counter, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    rows = written(rows.mapInArrow(_pack, "vec_id long, vector binary"), "packed")
    able = rows.where("vec_id is not null and vector is not null")
    nodes = able.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    nodes = nodes.withColumn("dim", (F.length("vector") / 8).cast("long")).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes.mapInArrow(_short, "vector binary, copies long, low long, dim long, node long, small binary"), "nodes")
    count = nodes.count()
    every = max(1, count // AUDIT)
    sample = nodes.where(F.pmod(F.xxhash64("vector"), F.lit(every)) == 0).orderBy(F.xxhash64("vector"), "node").limit(2 * AUDIT)
    queries = [(r.node, r.dim, r.vector) for r in sample.select("node", "dim", "vector").collect()]
    truth = written(nodes.select("node", "dim", "vector").mapInArrow(_auditor(queries), "a long, b long"), "audit")
    links, recall = None, 0.0
    for seed in range(TRIES):
        edges = graph(nodes, count, seed)
        found = checked(edges, nodes)
        found = written(found if links is None else found.unionByName(links).distinct(), "links")
        links = found
        roots = written(components(found), "roots")
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        got = truth.join(a, "a", "left").join(b, "b", "left").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ra") == F.col("rb")).cast("long")).alias("hit")).first()
        recall = (got["hit"] or 0) / got["n"] if got["n"] else 1.0
        if recall >= RECALL:
            break
    if recall < LEAST:
        raise RuntimeError(f"only {recall:.3f} of the audited links were found")
    if recall < 1:
        roots = written(components(found.unionByName(truth)), "roots")
    members = nodes.join(roots, "node").select("root", "node", "vector", "copies")
    counts = link_counts(members, BLOCK)
    named = nodes.join(roots, "node").groupBy("root").agg(F.min("low").alias("component_id"))
    own = nodes.select("node", "vector", "copies", "low").join(roots, "node", "left").join(named, "root", "left").join(counts, "node", "left")
    own = own.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    out = able.join(own, "vector").select("vec_id", "n_links", "component_id")
    rest = rows.where("vec_id is null or vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(rest)
    out = out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    out.recall = recall
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS norm
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
r(id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
