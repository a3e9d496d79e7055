"""Small statistics: one-dimensional k-means, median lines, systematic samples, brightest pixels of bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.lineage import cut


def every_nth(df: DataFrame, order: list[Column | str], most: int = 5000) -> DataFrame:
    """``most`` rows at equal steps through the order, all if there are fewer.

    Row numbers come from counts by range partition and one window a partition, so no task holds all rows. The ranges
    come from a sample of the rows, so they are drawn once and kept."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(*order)
    dealt = cut(dealt.withColumn("_nth", F.row_number().over(w) - 1))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = sizes.select("_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    out = dealt.join(F.broadcast(base), "_part").withColumn("_rn", F.col("_base") + F.col("_nth"))
    step = F.greatest(F.floor(F.col("_all") / most), F.lit(1))
    return out.where((F.col("_rn") % step == 0) & (F.floor(F.col("_rn") / step) < most)).drop("_part", "_nth", "_base", "_all", "_rn", "_n")


def kmeans3(values: DataFrame, column: str) -> list[float] | None:
    """The three centres, ascending, that are best for a bounded sample of one-dimensional values (up to some
    thousands, see every_nth); None with fewer than three distinct values."""
    x = np.sort(np.array([r[0] for r in values.select(F.col(column).cast("double")).dropna().collect()]))
    distinct, first = np.unique(x, return_index=True)
    if len(distinct) < 3:
        return None
    s, q, n = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(x * x)), len(x)
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    cuts = first[1:]
    best, at = np.inf, (0, 0)
    for i, a in enumerate(cuts[:-1]):
        later = cuts[i + 1 :]
        total = cost(0, a) + cost(a, later) + cost(later, n)
        k = int(total.argmin())
        if total[k] < best - 1e-12 * abs(best if np.isfinite(best) else 1):
            best, at = float(total[k]), (int(a), int(later[k]))
    a, b = at
    return [float(x[:a].mean()), float(x[a:b].mean()), float(x[b:].mean())]


def brightest(df: DataFrame, by: str, x: str, y: str, low: Column, high: Column, bins: int = 50, least: int = 20, most: int = 20, share: float = 0.01) -> DataFrame:
    """(by, bin, mx, my): means of the highest ``y`` of each bin of ``x``.

    Bins of equal width lie between ``low`` and ``high``, ends included below; those with fewer than ``least`` rows are left out, then
    rows above mean + 3 sd, and of the rest the highest min(``most``, ceil(``share`` * rows))."""
    lo, width = low, (high - low) / bins
    d = df.withColumn("bin", F.floor(F.try_divide(F.col(x) - lo, width)).cast("int")).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    w = Window.partitionBy(by, "bin")
    d = d.withColumns({"_n": F.count(F.lit(1)).over(w), "_m": F.avg(y).over(w), "_s": F.stddev_pop(y).over(w)})
    d = d.where((F.col("_n") >= least) & (F.round(F.col(y), 6) <= F.round(F.col("_m") + 3 * F.col("_s"), 6)))
    d = d.withColumns({"_good": F.count(F.lit(1)).over(w), "_rank": F.row_number().over(w.orderBy(F.desc(y), x))})
    d = d.where(F.col("_rank") <= F.least(F.lit(most), F.ceil(F.col("_good") * share)))
    return d.groupBy(by, "bin").agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))


def median_line(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, slope, intercept, n) of the line with the least absolute residuals, for groups of at most some dozens of points.

    A best line goes through two of the points; ties go to the smaller slope, then intercept. Groups with fewer than two
    distinct x have no line."""
    g = points.groupBy(by).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("p"), F.count(F.lit(1)).alias("n"))
    a = g.select(by, "n", "p", F.explode("p").alias("a")).select(by, "n", "p", "a", F.explode("p").alias("b")).where("a.x < b.x")
    slope = (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))
    a = a.withColumn("slope", slope).withColumn("intercept", F.col("a.y") - F.col("slope") * F.col("a.x"))
    off = F.aggregate("p", F.lit(0.0), lambda s, q: s + F.abs(q["y"] - F.col("intercept") - F.col("slope") * q["x"]))
    a = a.withColumn("off", F.round(off, 6)).withColumns({"slope": F.round("slope", 9), "intercept": F.round("intercept", 6)})
    best = a.groupBy(by).agg(F.min(F.struct("off", "slope", "intercept", "n")).alias("best"))
    return best.select(by, "best.slope", "best.intercept", F.col("best.n").alias("n"))
