"""Mixing sources to target weights by weighted fair queueing.

Sources by code point, the null source last, weigh 1, 2, 3 and so on in turn and share the budget,
which is the size of all documents (size: words between ASCII white space; null text: 0). A target stops at
``REPEATS`` times its source's size and the excess is shared again by weight. Each source's documents,
shuffled by a hash of their id and text, queue up to ``REPEATS`` times over; a copy's virtual finish time is
the source's words up to its end, divided by the target. All copies are sorted by finish time
(ties: source, hash, id, round) and taken while their running total is within the budget.

No sort is global and no source is one task: running sums are kept by slices of the hash within a source, and
the order by finish time needs only the totals of its ranges, and rows in order in the one range where the
budget ends. Reruns agree: rows that tie in everything are alike. Documents of size zero are
taken like others and add nothing. Texts of any length, null ids and sources, repeated rows and empty tables (no rows) are
allowed; other columns, whatever their names, are kept out. Tables with a row for each source are small beside the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.common import documents, joined, written

REPEATS = 3
WEIGHTS = 3
#: Ranges of virtual time in one unit; times from FAR units on share the last range.
RANGES, FAR = 4096, 4


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h, text_hash) of every row; h orders the documents at random. It hangs on the text too, so that rows
    of one id, or of none, are spread like others."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text))).alias("h"),
        F.xxhash64(text).alias("text_hash"),
    )


def targets(sources: DataFrame) -> DataFrame:
    """Adds target to (source, source_size): shares of the whole by weight, none above REPEATS sizes.

    The table has a row for each source; its windows are over sources, never documents.
    """
    name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sources.withColumn("weight", (F.row_number().over(name) - 1) % WEIGHTS + 1).withColumn("cap", REPEATS * F.col("source_size"))
    up = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(1))
    s = s.withColumns({"total": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every), "capped": F.sum("cap").over(up), "before": F.sum("weight").over(up)})
    # Level at which the sources up to this one would be full and the rest still share what is left.
    left = F.greatest(F.col("total") - F.col("capped") + F.col("cap"), F.lit(0)).cast("double")
    s = s.withColumn("level", left / (F.col("all_weight") - F.col("before") + F.col("weight")))
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"]
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))))
    return s.select("source", "source_size", "total", "target")


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, source, h, size, source_size, target, copies, taken) of every row of ``docs``."""
    rows = written(sized(docs).withColumn("slice", F.substring("h", 1, 3)), "sized")
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sources = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")))
    names = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = slices.withColumn("ahead", F.sum("slice_size").over(names) - F.col("slice_size"))
    ahead = joined(ahead, sources, ["source"]).drop("slice_size")
    w = Window.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("within", F.sum("size").over(w))
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("source", "slice").orderBy("h", "doc_id")))
    at = joined(placed, ahead, ["source", "slice"])
    at = at.select("source", "slice", "nth", "h", "doc_id", "text_hash", "size", "source_size", "total", "target", (F.col("ahead") + F.col("within")).alias("end"))
    at = written(at, "queued")
    copies = at.select("source", "slice", "nth", "h", "doc_id", "size", "source_size", "total", "target", "end", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("round"))
    finish = F.coalesce(F.try_divide((F.col("end") + F.col("round") * F.col("source_size")).cast("double"), F.col("target")), F.lit(0.0))
    copies = copies.withColumn("finish", finish).withColumn("range", F.floor(F.least(F.col("finish"), F.lit(float(FAR))) * RANGES))
    ranges = copies.groupBy("range").agg(F.sum("size").alias("range_size"), F.max("total").alias("total"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At most RANGES * FAR + 1 rows.
    ranges = ranges.withColumn("upto", F.sum("range_size").over(order)).withColumn("base", F.col("upto") - F.col("range_size"))
    ranges = F.broadcast(ranges.where("base <= total").select(F.col("range").alias("r"), "upto", "base", F.col("total").alias("budget")))
    copies = copies.join(ranges, F.col("range") == F.col("r"))
    taken = ["source", "slice", "nth", "size"]
    inside = copies.where("upto <= budget").select(*taken)
    last = Window.partitionBy("range").orderBy("finish", F.col("source").isNull(), "source", "h", "doc_id", "round", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = copies.where("upto > budget").withColumn("running", F.col("base") + F.sum("size").over(last)).where("running <= budget").select(*taken)
    got = inside.unionByName(edge).groupBy("source", "slice", "nth").agg(F.count(F.lit(1)).alias("copies"))
    out = joined(at, got, ["source", "slice", "nth"], "left")
    return out.select(
        "doc_id", "text_hash", "source", "h", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"), (F.coalesce("copies", F.lit(0)) * F.col("size")).alias("taken")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, 3 * source_size AS cap,
             CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
u AS (SELECT *, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
             CAST(sum(cap) OVER w AS BIGINT) AS capped, CAST(sum(weight) OVER w AS BIGINT) AS upto
      FROM r WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, CAST(greatest(total - capped + cap, 0) AS DOUBLE) / (all_weight - upto + weight) AS level FROM u),
f AS (SELECT arg_min(level, CAST(cap AS DOUBLE) / weight) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT l.source, l.source_size, l.total, least(CAST(l.cap AS DOUBLE), coalesce(f.level * l.weight, CAST(l.cap AS DOUBLE))) AS target
      FROM l LEFT JOIN f ON true),
q AS (SELECT d.*, t.source_size, t.total, t.target,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, k.k, coalesce(CAST(fin + k.k * source_size AS DOUBLE) / nullif(target, 0), 0) AS finish FROM q, (VALUES (0), (1), (2)) k(k)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, h, doc_id, k ROWS UNBOUNDED PRECEDING) AS running FROM c)
SELECT doc_id, size, source_size, target, CAST(coalesce(sum(size) FILTER (WHERE running <= total), 0) AS BIGINT) AS taken
FROM o GROUP BY doc_id, source, h, size, source_size, target
"""
