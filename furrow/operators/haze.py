"""Haze lines: the clear-sky line of blue and red for each date, and each pixel's distance from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.scalars import haze_distance
from furrow.operators.lineage import per_date
from furrow.operators.stats import brightest, median_line

STEEPEST, BINS = 1.5, 50


def lines(df: DataFrame, x: str, y: str, low: str, high: float, bins: int = BINS) -> DataFrame:
    """(t, slope, intercept, fitted) of every date with bins: the median line of each bin's brightest pixels if half of the bins have one and
    it is steeper than 1.5, else (fitted 0) a line of slope 1.5 through the means."""
    points = brightest(df, "t", x, y, F.col(low), F.lit(float(high)), bins)
    flat = points.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg("mx").alias("ax"), F.avg("my").alias("ay"))
    fit = median_line(points, "t", "mx", "my").select("t", "slope", "intercept")
    out = flat.join(fit, "t", "left")
    good = (F.col("n") >= bins / 2) & (F.col("slope") > STEEPEST)
    return out.select(
        "t",
        F.when(good, F.col("slope")).otherwise(F.lit(STEEPEST)).alias("slope"),
        F.when(good, F.col("intercept")).otherwise(F.round(F.col("ay") - F.col("ax") * STEEPEST, 6)).alias("intercept"),
        F.coalesce(good, F.lit(False)).cast("int").alias("fitted"),
    )


def with_fallback(found: DataFrame, dates: DataFrame) -> DataFrame:
    """A line for every date: its own if fitted, else the mean of the fitted ones, or slope 1.5 through the origin."""
    mean = found.where("fitted = 1").agg(F.avg("slope").alias("ms"), F.avg("intercept").alias("mi"))
    own = dates.join(found, "t", "left").crossJoin(F.broadcast(mean))  # one row
    use = F.col("fitted") == 1
    return own.select(
        "t",
        F.when(use, F.col("slope")).otherwise(F.coalesce("ms", F.lit(STEEPEST))).alias("slope"),
        F.when(use, F.col("intercept")).otherwise(F.coalesce("mi", F.lit(0.0))).alias("intercept"),
    )


def distances(df: DataFrame, line: DataFrame, x: str, y: str, out: str = "hot") -> DataFrame:
    """Adds the distance of (x, y) from its date's line."""
    return per_date(df, line).withColumn(out, haze_distance(F.col(x), F.col(y), F.col("slope"), F.col("intercept"))).drop("slope", "intercept")
