"""Cloud and shadow masks from the whole time series of a scene, in stages.

Input: one row per date and pixel (t, y, x, six bands, FMASK, SZA, SAA, VZA, VAA), y and x from 0. Output: mask 0 shadow, 1
clear, 2 cloud, 3 background. Stages are joined by small per-date or one-row tables; where a stage's mask is read again and
again, its lineage is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.bands import BANDS
from furrow.functions.qa import masked
from furrow.operators import gains, haze, raster, stats
from furrow.operators.cube import always_water, without_empty_dates, without_snow_dates, without_snow_pixels
from furrow.operators.lineage import cut, per_date


@dataclass(frozen=True)
class Parameters:
    """What the stages read; ``blue_land`` and ``nir_water`` follow dn_max unless they are given."""

    dn_max: float = 10000
    blue_land: float | None = None
    nir_water: float | None = None
    a_cloud: float = 1.2
    buffer: int = 5
    shortest: float = 0
    longest: float = 134
    b_shadow: float = 1.0
    sample: int = 5000

    @property
    def land_limit(self) -> float:
        return self.blue_land if self.blue_land is not None else 0.15 * self.dn_max

    @property
    def water_limit(self) -> float:
        return self.nir_water if self.nir_water is not None else 0.05 * self.dn_max


KEYS = ("t", "y", "x")


def prepared(df: DataFrame) -> DataFrame:
    """Dates without data or all in snow go, snow pixels lose their bands; adds qa, water, qa_cloud and qa_shadow."""
    df = without_snow_pixels(without_snow_dates(without_empty_dates(df)))
    df = always_water(df)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.withColumns({"qa": zero(masked(["all"])), "qa_cloud": zero(masked(["cloud", "cirrus", "cloud_adj"])), "qa_shadow": zero(masked(["shadow"]))})


def with_haze(df: DataFrame, p: Parameters) -> DataFrame:
    """Adds hot: distance from the date's line of blue and red on land, of blue and near infrared on dark water."""
    dates = df.select("t").distinct()
    dark = F.col("NIR1") < 0.1 * p.dn_max
    land = ((F.col("water") == 0) | ~dark) & (F.col("qa") == 0)

    def lines(part: DataFrame, y: str, most: float) -> DataFrame:
        fit = part.where(F.col("BLUE").isNotNull() & F.col(y).isNotNull())
        low = fit.where(F.col("BLUE").between(0.01 * p.dn_max, most)).groupBy("t").agg(F.min("BLUE").alias("low"))
        return haze.with_fallback(haze.lines(per_date(fit, low, "inner"), "BLUE", y, "low", most), dates)

    # A line for each date.
    on_land = lines(df.where(land), "RED", p.land_limit)
    on_water = lines(df.where((F.col("water") == 1) & dark), "NIR1", p.water_limit)
    df = haze.distances(df, on_land, "BLUE", "RED", "hot")
    df = haze.distances(df, on_water, "BLUE", "NIR1", "hot_water")
    wet = (F.col("water") == 1) & dark
    df = df.withColumn("hot", F.when(F.coalesce(wet, F.lit(False)), F.col("hot_water")).otherwise(F.col("hot"))).drop("hot_water")
    df = df.withColumn("mask", F.when(F.col("hot").isNull(), 3).otherwise(1))
    return df.withColumn("hot", F.coalesce("hot", F.lit(0.0)))


def nearer(value: Column, centres: list[float], first: int, second: int) -> Column:
    return F.when(F.abs(value - centres[0]) >= F.abs(value - centres[1]), second).otherwise(first)


def _centres(df: DataFrame, column: str, p: Parameters) -> list[float] | None:
    rows = df.where(F.col(column).isNotNull()).select(*KEYS, column)
    return stats.kmeans3(stats.every_nth(rows, list(KEYS), p.sample), column)


def clouds(df: DataFrame, p: Parameters) -> DataFrame:
    """Classifies land by haze, refines by the spread of clear dates, clears lone clouds and adds a buffer."""
    centres = _centres(df.where((F.col("qa_cloud") == 1) & (F.col("mask") != 3) & (F.col("water") == 0)), "hot", p)
    threshold = F.lit(0.0)
    if centres:
        land = (F.col("mask") != 3) & (F.col("water") == 0)
        df = df.withColumn("mask", F.when(land, nearer(F.col("hot"), centres, 1, 2)).otherwise(F.col("mask")))
        threshold = F.when(F.col("water") == 0, (centres[0] + centres[1]) / 2).otherwise(F.lit(0.0))
    df = cut(raster.without_lone_clouds(df, 1))
    pixel = Window.partitionBy("y", "x")
    df = df.withColumn("often", F.count_if(~F.col("mask").isin(2, 3)).over(pixel) >= 2)
    own = lambda c: F.when(c, F.col("hot"))
    g = df.agg(
        (F.avg(own(F.col("mask") == 2)) - F.stddev_pop(own(F.col("mask") == 2))).alias("g_th"),
        F.avg(own(F.col("often"))).alias("mean"), F.stddev_pop(own(F.col("often"))).alias("sd"), (F.max(own(F.col("often"))) - F.min(own(F.col("often")))).alias("range"),
    )
    df = df.crossJoin(F.broadcast(g)).withColumn("th", threshold)  # one row
    limit = F.col("mean") + (F.try_divide(F.col("th") - F.col("range"), F.col("th") + F.col("range")) + p.a_cloud) * F.col("sd")
    df = df.withColumn("limit", limit)
    m = F.when(F.col("often") & (F.col("mask") == 2) & (F.col("hot") <= F.col("limit")), 1).otherwise(F.col("mask"))
    df = df.withColumn("mask", m)
    m = F.when(F.col("often") & (F.col("hot") > F.col("limit")) & (F.col("NIR1") > 0.1 * p.dn_max) & (F.col("mask") != 3), 2).otherwise(F.col("mask"))
    df = df.withColumn("mask", m)
    m = F.when(~F.col("often") & (F.col("hot") > F.col("g_th")) & (F.col("mask") != 3), 2).otherwise(F.col("mask"))
    df = df.withColumn("mask", m).drop("often", "g_th", "mean", "sd", "range", "th", "limit")
    return cut(raster.cloud_buffer(raster.without_lone_clouds(df, 3), p.buffer))


def corner_angles(df: DataFrame) -> DataFrame:
    """(t, corner, sza, saa, vza, vaa) of the four corner pixels of each date."""
    size = F.broadcast(df.agg(F.max("y").alias("my"), F.max("x").alias("mx")))  # one row
    at = df.crossJoin(size).where(F.col("y").isin(0) | (F.col("y") == F.col("my"))).where(F.col("x").isin(0) | (F.col("x") == F.col("mx")))
    return at.select("t", (F.when(F.col("y") > 0, 2).otherwise(0) + F.when(F.col("x") > 0, 1).otherwise(0)).alias("corner"), *[F.col(a).alias(a.lower()) for a in ("SZA", "SAA", "VZA", "VAA")])


def potential(df: DataFrame, p: Parameters) -> DataFrame:
    """Adds mask2: the mask with possible shadows 0 and possible edges 99, and zone."""
    size = df.agg(F.max("x") + 1, F.max("y") + 1).first()
    if size[0] is None:
        return df.withColumn("zone", F.lit(0)).withColumn("mask2", F.col("mask"))
    df = raster.shadow_zone(df, corner_angles(df), min(p.longest, *size), p.shortest)
    two = F.when((F.col("zone") == 1) & (F.col("mask") == 1), 0).when((F.col("zone") == 99) & (F.col("mask") == 1), 99).otherwise(F.col("mask"))
    df = df.withColumns({"one": F.col("mask"), "mask": two})
    df = raster.shadow_buffer(df, 5, 1, 0)
    return cut(df.withColumnsRenamed({"mask": "mask2", "one": "mask"}))


def with_shadow_index(df: DataFrame, p: Parameters) -> DataFrame:
    """Adds idx: near and short-wave infrared, fitted to the clearest date, on land without cloud; blue and green on bright water;
    else whether shadow is possible."""
    able = (F.col("water") == 0) | (F.col("NIR1") >= 0.1 * p.dn_max)
    seen = df.withColumn("one", F.col("mask")).withColumn("mask", F.when(F.coalesce(able, F.lit(False)), F.col("mask2")).otherwise(-1))
    best = gains.clearest(seen)
    own = df.withColumn("one", F.col("mask")).withColumn("mask", F.col("mask2"))
    g1 = gains.gains(own, "NIR1", best, per_date=False).withColumnsRenamed({"gain": "g1", "bias": "b1"})
    g2 = gains.gains(own, "SWIR1", best).withColumnsRenamed({"gain": "g2", "bias": "b2"})
    df = per_date(df, g1.join(g2, "t", "full"))
    land = F.coalesce(able & (F.col("mask") <= 1), F.lit(False))
    wet = F.coalesce((F.col("water") == 1) & (F.col("NIR1") >= 0.1 * p.dn_max) & (F.col("mask") <= 1), F.lit(False))
    value = F.when(wet, F.col("BLUE") + F.col("GREEN")).when(land, F.col("g1") * F.col("NIR1") + F.col("b1") + F.col("g2") * F.col("SWIR1") + F.col("b2"))
    return df.withColumn("idx", value.otherwise((F.col("zone") == 1).cast("double"))).drop("g1", "b1", "g2", "b2")


def shadows(df: DataFrame, p: Parameters) -> DataFrame:
    """Classifies possible shadows, refines each date by the first rule that finds any, clears lone ones and adds a buffer."""
    maybe = (F.col("mask2") == 0) & (F.col("water") == 0)
    centres = _centres(df.where(maybe & (F.col("qa_shadow") == 1)), "idx", p)
    if centres:
        df = df.withColumn("mask2", F.when(maybe, nearer(F.col("idx"), centres, 0, 1)).otherwise(F.col("mask2")))
    df = cut(df.withColumn("ini", F.when(F.col("mask2") != 0, F.col("mask")).otherwise(0)))
    clear = F.when(F.col("ini") == 1, F.col("idx"))
    df = df.crossJoin(F.broadcast(df.agg(F.avg(clear).alias("mean"), F.stddev_pop(clear).alias("sd"))))  # one row
    dark = F.col("idx") < 0.5 * p.dn_max
    rules = {
        "r1": (F.col("idx") < F.col("mean")) & (F.col("ini") == 0),
        "r2": (F.col("idx") < F.col("mean") - p.b_shadow * F.col("sd")) & dark & (F.col("mask2") == 0),
        "r3": (F.col("idx") < F.col("mean") - (p.b_shadow + 1) * F.col("sd")) & dark & (F.col("mask2") == 99),
    }
    df = df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in rules.items()})
    # Counts by date, joined back: a date's pixels are never one task.
    dates = df.groupBy("t").agg((F.count_if(F.col("ini") == 1) < 2).alias("few"), *[F.bool_or(n).alias(f"any_{n}") for n in rules])
    df = per_date(df, dates, "inner")
    rule = F.when(F.col("few"), F.lit("ini")).when(F.col("any_r1"), "r1").when(F.col("any_r2"), "r2").when(F.col("any_r3"), "r3")
    hit = F.when(rule == "r1", F.col("r1")).when(rule == "r2", F.col("r2")).when(rule == "r3", F.col("r3")).otherwise(F.lit(False))
    m = F.when((rule == "ini") & (F.col("mask") != 0), F.col("ini")).when(hit, 0).otherwise(F.col("mask"))
    df = df.withColumn("mask", m).select(*KEYS, "mask")
    return raster.shadow_buffer(raster.without_lone_shadows(df, 3), p.buffer, 3, 0)


def mask(df: DataFrame, parameters: Parameters | None = None) -> DataFrame:
    """(t, y, x, mask) of every pixel of the dates that have data."""
    p = parameters or Parameters()
    df = prepared(df.select(*KEYS, *BANDS, "FMASK", "SZA", "SAA", "VZA", "VAA"))
    df = potential(clouds(cut(with_haze(df, p)), p), p)
    return shadows(with_shadow_index(df, p), p).withColumn("mask", F.col("mask").cast("int"))
