"""From long band rows to one row per observation, and what is done to whole dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions.bands import ASSETS, BANDS, NEEDED
from furrow.functions.qa import mask

KEYS = ("sensor", "y", "x", "t")


def band_table(spark: SparkSession) -> DataFrame:
    """(sensor, asset, band): 33 rows."""
    return spark.createDataFrame([(s, a, b) for s, assets in ASSETS.items() for a, b in assets.items()], "sensor string, asset string, band string")


def harmonised(long: DataFrame, bands: Sequence[str] = NEEDED) -> DataFrame:
    """Rows (sensor, asset, y, x, t, value) as one row per sensor, pixel and date with a column per band.

    The table of bands has 33 rows and is broadcast; bands that aren't asked for are dropped before the shuffle."""
    lut = F.broadcast(band_table(long.sparkSession).where(F.col("band").isin(*bands)))
    named = long.join(lut, ["sensor", "asset"])
    return named.groupBy(*KEYS).agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])


def to_long(wide: DataFrame, bands: Sequence[str] = NEEDED) -> DataFrame:
    """The reverse of harmonised(): a row for each band under its sensor's asset name."""
    names = {s: {b: a for a, b in assets.items()} for s, assets in ASSETS.items()}
    asset = lambda b: F.when(F.col("sensor") == "S30", names["S30"].get(b)).otherwise(names["L30"].get(b))
    items = F.array(*[F.struct(asset(b).alias("asset"), F.col(b).cast("double").alias("value")) for b in bands])
    return wide.select(*KEYS, F.inline(items)).where("asset is not null and value is not null")


def united(spark: SparkSession, *parts: DataFrame | None) -> DataFrame:
    """All rows of the sensors' tables, duplicates too; missing tables count as empty, and so do all."""
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "sensor string, y int, x int, t date")


def dated(df: DataFrame, column: str = "datetime") -> DataFrame:
    """Adds the UTC date t of a timestamp."""
    return df.withColumn("t", F.to_date(column))


def with_days(df: DataFrame, value: str, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """A row for every key and day from the first to the last day; days without an observation have NULL."""
    span = df.agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a is not null")
    days = span.select(F.posexplode(F.sequence("a", "b")).alias("t_idx", "t"))
    # One row a day of the calendar: bounded by the years that are covered.
    spine = df.select(*keys).distinct().crossJoin(F.broadcast(days))
    return spine.join(df.groupBy(*keys, "t").agg(F.max(value).alias(value)), [*keys, "t"], "left")


def composite(df: DataFrame, values: Sequence[str], how: str = "mean", keys: Sequence[str] = ("y", "x", "t")) -> DataFrame:
    """One row per key where several observations fall on it: their mean, or the first sensor's by name."""
    if how == "mean":
        return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])
    if how == "first":
        return df.groupBy(*keys).agg(F.min(F.struct("sensor", *values)).alias("one")).select(*keys, *[F.col(f"one.{v}").alias(v) for v in values])
    raise ValueError("how is mean or first")


def without_empty_dates(df: DataFrame, column: str = "NIR1") -> DataFrame:
    """Rows of the dates on which any pixel has the column."""
    full = df.groupBy("t").agg(F.count(column).alias("n")).where("n > 0")
    return df.join(full.select("t"), "t", "left_semi")


def without_snow_dates(df: DataFrame) -> DataFrame:
    """Rows of the dates on which some pixel has no snow."""
    snowy = df.groupBy("t").agg(F.bool_and(F.coalesce(mask("snow"), F.lit(0)) == 1).alias("all_snow")).where("all_snow")
    return df.join(snowy.select("t"), "t", "left_anti")


def without_snow_pixels(df: DataFrame) -> DataFrame:
    """Bands of snow pixels as NULL; angles and the quality word stay."""
    clear = F.coalesce(mask("snow"), F.lit(0)) == 0
    return df.withColumns({b: F.when(clear, F.col(b)) for b in BANDS})


def always_water(df: DataFrame) -> DataFrame:
    """Adds water: 1 where the pixel's water bit is set on every date."""
    every = F.bool_and(F.coalesce(mask("water"), F.lit(0)) == 1).over(Window.partitionBy("y", "x"))
    return df.withColumn("water", every.cast("int"))
