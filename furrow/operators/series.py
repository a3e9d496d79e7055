"""Operators on pixel series that are windows: every row is (key, t_idx, v), positions are days.

All windows of a pipeline share one partitioning and order, so they cost one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, T, V = "pix", "t_idx", "v"
ROUND = 9


def over(key: str = KEY) -> WindowSpec:
    return Window.partitionBy(key).orderBy(T)


def before(c: Column, key: str = KEY) -> Column:
    """The last value before this row that isn't missing."""
    return F.last(c, ignorenulls=True).over(over(key).rowsBetween(Window.unboundedPreceding, -1))


def after(c: Column, key: str = KEY) -> Column:
    """The first value after this row that isn't missing."""
    return F.first(c, ignorenulls=True).over(over(key).rowsBetween(1, Window.unboundedFollowing))


def neighbours(df: DataFrame, value: str = V, key: str = KEY) -> DataFrame:
    """Adds pre, pre_t, post and post_t: the nearest observations strictly before and after each row."""
    v, t = F.col(value), F.when(F.col(value).isNotNull(), F.col(T))
    return df.withColumns({"pre": before(v, key), "pre_t": before(t, key), "post": after(v, key), "post_t": after(t, key)})


def straight(t: Column | str = T) -> Column:
    """The value at ``t`` on the line between the neighbours."""
    t = F.col(t) if isinstance(t, str) else t
    return F.col("pre") + (F.col("post") - F.col("pre")) * F.try_divide((t - F.col("pre_t")).cast("double"), (F.col("post_t") - F.col("pre_t")).cast("double"))


def despiked(df: DataFrame, depth: float, days: int, sweeps: int = 2, value: str = V, key: str = KEY) -> DataFrame:
    """Observations off the line between their neighbours by more than ``depth`` and twice the
    neighbours' difference, within ``days``, become missing; all of a sweep at once."""
    for _ in range(sweeps):
        n = neighbours(df, value, key)
        off = straight() - F.col(value)
        ratio = F.try_divide(off, F.col("post") - F.col("pre"))
        spike = (F.col("post_t") - F.col("pre_t") < days) & (F.round(F.abs(off), ROUND) > depth) & (F.round(F.abs(ratio), ROUND) > 2)
        df = n.withColumn(value, F.when(~F.coalesce(spike, F.lit(False)), F.col(value))).drop("pre", "pre_t", "post", "post_t")
    return df


def z_scores(df: DataFrame, value: str = V, key: str = KEY) -> DataFrame:
    """Adds med, mad and z = 0.6745 (v - median) / MAD; z is NULL where the MAD is zero."""
    w = Window.partitionBy(key)
    df = df.withColumn("med", F.median(value).over(w))
    df = df.withColumn("mad", F.median(F.abs(F.col(value) - F.col("med"))).over(w))
    return df.withColumn("z", F.try_divide(F.lit(0.6745) * (F.col(value) - F.col("med")), F.col("mad")))


def without_outliers(df: DataFrame, most: float = 3.5, value: str = V, key: str = KEY) -> DataFrame:
    """Values with a modified z-score beyond ``most`` become missing; with a MAD of zero all stay."""
    z = z_scores(df, value, key)
    far = F.round(F.abs(F.col("z")), ROUND) > most
    return z.withColumn(value, F.when(~F.coalesce(far, F.lit(False)), F.col(value))).drop("med", "mad", "z")


def filled(df: DataFrame, limit: int | None = 61, edges: bool = True, value: str = V, key: str = KEY) -> DataFrame:
    """Gaps between observations become straight lines, the first ``limit`` days of each (all if None); with
    ``edges``, days before the first and after the last observation take its value."""
    n = neighbours(df, value, key)
    inner = straight()
    if limit is not None:
        inner = F.when(F.col(T) - F.col("pre_t") <= limit, inner)
    got = F.coalesce(F.col(value), F.when(F.col("pre").isNotNull() & F.col("post").isNotNull(), inner))
    if edges:
        got = F.when(got.isNotNull(), got).when(F.col("pre").isNull(), F.col("post")).when(F.col("post").isNull(), F.col("pre"))
    return n.withColumn(value, got).drop("pre", "pre_t", "post", "post_t")


def rolling_mean(value: str = V, width: int = 21, key: str = KEY) -> Column:
    """Centred mean of ``width`` days, missing unless all are there."""
    w = over(key).rowsBetween(-(width // 2), width // 2)
    return F.when(F.count(F.col(value)).over(w) == width, F.avg(F.col(value)).over(w))


def convolved(value: str = V, width: int = 21, key: str = KEY) -> Column:
    """Centred sum over ``width``, with zeros beyond the ends: low near them."""
    return F.sum(F.col(value)).over(over(key).rowsBetween(-(width // 2), width // 2)) / width


def trailing_mean(value: str = V, width: int = 7, key: str = KEY) -> Column:
    """Mean of the last ``width`` days, missing unless all are there."""
    w = over(key).rowsBetween(1 - width, 0)
    return F.when(F.count(F.col(value)).over(w) == width, F.avg(F.col(value)).over(w))


def density(df: DataFrame, value: str = V, key: str = KEY) -> DataFrame:
    """(key, n, valid, gap, spread, class): days for each observation, peak to peak, and the class of smoothing.

    Class: none (no observation), over10, over7, over5 or dense, by days for each observation."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("valid"), (F.max(value) - F.min(value)).alias("spread"))
    gap = F.try_divide(F.col("n").cast("double"), F.col("valid").cast("double"))
    g = g.withColumn("gap", gap)
    kind = F.when(F.col("valid") == 0, "none").when(F.col("gap") > 10, "over10").when(F.col("gap") > 7, "over7").when(F.col("gap") > 5, "over5").otherwise("dense")
    return g.withColumn("class", kind).withColumn("despike", F.coalesce(F.col("gap") <= 15, F.lit(False)))
