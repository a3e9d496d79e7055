"""The clearest date, and gains and offsets of the other dates against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clearest(df: DataFrame) -> DataFrame:
    """(t, n) of the date with the most clear pixels (mask 1); the first of equals. One row."""
    return df.groupBy("t").agg(F.count_if(F.col("mask") == 1).alias("n")).orderBy(F.desc("n"), "t").limit(1)


def gains(df: DataFrame, column: str, best: DataFrame, least: int = 100, per_date: bool = True) -> DataFrame:
    """(t, gain, bias) of every date against the clearest (``best``: one row, t).

    Common pixels are land and clear (water 0, mask 1) on both dates. The gain is the standard deviation of the clearest date
    there (all its clear land, unless ``per_date``) over that of the whole date, the bias the ratio of the means; 1 and 0
    for dates that share ``least`` pixels or fewer."""
    best = F.broadcast(best.select(F.col("t").alias("best_t")))
    clear = df.where((F.col("mask") == 1) & (F.col("water") == 0))
    top = clear.join(best, F.col("t") == F.col("best_t")).select("y", "x", F.col(column).alias("top"))
    shared = clear.select("t", "y", "x").join(top, ["y", "x"]).groupBy("t")
    shared = shared.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("top").alias("sd"), F.avg("top").alias("mean"))
    whole = df.groupBy("t").agg(F.stddev_pop(column).alias("all_sd"), F.avg(column).alias("all_mean"))
    out = whole.join(shared, "t", "left")
    if not per_date:
        out = out.drop("sd").crossJoin(F.broadcast(top.agg(F.stddev_pop("top").alias("sd"))))  # one row
    enough = F.col("n") > least
    gain, bias = F.try_divide(F.col("sd"), F.col("all_sd")), F.try_divide(F.col("mean"), F.col("all_mean"))
    return out.select("t", F.when(enough, gain).otherwise(F.lit(1.0)).alias("gain"), F.when(enough, bias).otherwise(F.lit(0.0)).alias("bias"))
