"""Operators on images: trailing windows, small components, buffers and the projection of cloud shadows.

An image is rows (t, y, x, mask); codes: 0 shadow, 1 clear, 2 cloud, 3 background, 99 edge of a possible shadow. Window sums are
separable, along x and then along y. No window is centred: a pixel sees the rows and columns up to its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.lineage import cut, per_date

IMAGE = "t"


def window_sum(df: DataFrame, flag: Column, size: int, out: str) -> DataFrame:
    """Adds the sum of ``flag`` over the last ``size`` rows and columns; NULL where they aren't all in the image,
    which starts at row and column 0."""
    back = 1 - size
    along_x = Window.partitionBy(IMAGE, "y").orderBy("x").rangeBetween(back, 0)
    along_y = Window.partitionBy(IMAGE, "x").orderBy("y").rangeBetween(back, 0)
    df = df.withColumn("_row", F.sum(flag.cast("int")).over(along_x))
    df = df.withColumn(out, F.when((F.col("x") >= size - 1) & (F.col("y") >= size - 1), F.sum("_row").over(along_y)))
    return df.drop("_row")


def components(df: DataFrame, value: int, least: int = 8) -> DataFrame:
    """Adds big: whether the pixel of that value has at least ``least`` of them in its 4-connected component.

    Only whether a component reaches ``least`` matters. Every pixel starts with its neighbours of that value, and
    joins the sets of its members, so the reach doubles each round; a set that is large enough is cut
    to ``least``. No set is longer and no image is one task.
    """
    keys = [IMAGE, "y", "x"]
    rows = Window.partitionBy(IMAGE, "y").orderBy("x").rangeBetween(-1, 1)
    columns = Window.partitionBy(IMAGE, "x").orderBy("y").rangeBetween(-1, 1)
    place = F.struct("y", "x")
    near = F.array_union(F.collect_list(place).over(rows), F.collect_list(place).over(columns))
    at = df.where(F.col("mask") == value).select(*keys).withColumn("own", near)
    reach = 1
    while reach < least - 1:
        told = at.select(*keys, F.explode("own").alias("m"))
        other = at.select(F.col(IMAGE).alias("_t"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("own").alias("heard"))
        told = told.join(other, (F.col(IMAGE) == F.col("_t")) & (F.col("m.y") == F.col("_y")) & (F.col("m.x") == F.col("_x")))
        at = told.groupBy(*keys).agg(F.slice(F.array_distinct(F.flatten(F.collect_list("heard"))), 1, least).alias("own"))
        reach *= 2
    big = at.select(*keys, (F.size("own") >= least).alias("big"))
    return df.join(big, keys, "left")


def without_lone_clouds(df: DataFrame, method: int = 1, code: int = 2, becomes: int = 1, rounds: int = 5) -> DataFrame:
    """Clouds (or another ``code``) become clear where they stand alone: method 1 up to 4 in the last 4 x 4, method 2 in rounds
    (repeated()), method 3 up to 8 there and fewer than 8 connected."""
    if method not in (1, 2, 3):
        raise ValueError("the method is 1, 2 or 3")
    if method == 2:
        return repeated(df, code, becomes, rounds)
    if method == 3:
        df = components(df, code)
    df = window_sum(df, F.col("mask") == code, 4, "_near")
    lone = (F.col("mask") == code) & (F.col("_near") <= (8 if method == 3 else 4))
    if method == 3:
        lone = lone & ~F.coalesce(F.col("big"), F.lit(False))
    return df.withColumn("mask", F.when(F.coalesce(lone, F.lit(False)), F.lit(becomes)).otherwise(F.col("mask"))).drop("_near", "big")


def repeated(df: DataFrame, code: int, becomes: int, rounds: int) -> DataFrame:
    """Every round clears the pixels of ``code`` that stood alone after the one before, and only those: others have their first value
    again. Rounds end when no date differs from the first mask by ``rounds`` or more, or after ``rounds`` + 1 of them."""
    first = df.withColumn("_first", F.col("mask"))
    now = first
    for _ in range(rounds + 1):
        now = window_sum(now, F.col("mask") == code, 4, "_near")
        lone = F.coalesce((F.col("mask") == code) & (F.col("_near") <= 4), F.lit(False))
        now = cut(now.withColumn("mask", F.when(lone, F.lit(becomes)).otherwise(F.col("_first"))).drop("_near"))
        moved = now.groupBy(IMAGE).agg(F.sum(F.abs(F.col("mask") - F.col("_first"))).alias("n")).agg(F.max("n")).first()[0]
        if (moved or 0) < rounds:
            break
    return now.drop("_first")


def without_lone_shadows(df: DataFrame, method: int = 3, rounds: int = 5) -> DataFrame:
    if method not in (2, 3):
        raise ValueError("the method is 2 or 3")
    return without_lone_clouds(df, method, code=0, rounds=rounds)


def cloud_buffer(df: DataFrame, size: int = 5) -> DataFrame:
    """Every pixel with a cloud in its last ``size`` + 1 rows and columns becomes a cloud."""
    df = window_sum(df, F.col("mask") == 2, size + 1, "_near")
    return df.withColumn("mask", F.when(F.col("_near") > 0, 2).otherwise(F.col("mask"))).drop("_near")


def shadow_buffer(df: DataFrame, size: int = 5, kind: int = 1, value: int = 0) -> DataFrame:
    """Pixels near ``value`` take it: kind 1 clear ones, 2 clear ones and edges, 3 all but clouds and background."""
    able = {1: F.col("mask") == 1, 2: F.col("mask").isin(1, 99), 3: ~F.col("mask").isin(2, 3)}
    if kind not in able:
        raise ValueError("the kind is 1, 2 or 3")
    df = window_sum(df, F.col("mask") == value, size + 1, "_near")
    return df.withColumn("mask", F.when((F.col("_near") > 0) & able[kind], value).otherwise(F.col("mask"))).drop("_near")


def shadow_heights(angles: DataFrame, longest: float, shortest: float) -> DataFrame:
    """A row for each cloud height: (columns of ``angles``, k, dx, dy). angles: sza, saa, vza, vaa in hundredths of a
    degree; heights are 3 apart from the one that casts the shortest shadow up to the longest."""
    a = {n: F.radians(F.col(n) * 0.01) for n in ("sza", "saa", "vza", "vaa")}
    reach = F.sqrt(F.pow(F.tan(a["sza"]) * F.sin(a["saa"]), 2) + F.pow(F.tan(a["sza"]) * F.cos(a["saa"]), 2))
    df = angles.withColumns({"high": F.try_divide(F.lit(float(longest)), reach), "low": F.try_divide(F.lit(float(shortest)), reach)})
    df = df.withColumn("n", F.ceil(F.round((F.col("high") - F.col("low")) / 3, 9)).cast("int")).where("n > 0")
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    h = F.col("low") + F.col("k") * 3
    sun_x, sun_y = h * F.tan(a["sza"]) * F.sin(a["saa"]), h * F.tan(a["sza"]) * F.cos(a["saa"])
    view_x, view_y = h * F.tan(a["vza"]) * F.sin(a["vaa"]), h * F.tan(a["vza"]) * F.cos(a["vaa"])
    half_even = lambda c: F.rint(F.round(c, 9)).cast("int")
    return df.withColumns({"dx": half_even(-sun_x) + half_even(view_x), "dy": half_even(sun_y) + half_even(view_y)}).drop("high", "low", "n")


def shadow_zone(df: DataFrame, angles: DataFrame, longest: float = 134, shortest: float = 0) -> DataFrame:
    """Adds zone: 1 where a cloud or its projection at some height falls, 99 in the strip that clouds outside the
    image could shade, else 0. angles: t, corner, sza, saa, vza, vaa; up to four rows a date."""
    heights = shadow_heights(angles.dropna(), longest, shortest)
    # At most four corners of some dozens of heights a date.
    shifts = heights.select(IMAGE, "dx", "dy").union(df.select(IMAGE, F.lit(0).alias("dx"), F.lit(0).alias("dy"))).distinct()
    shifts = shifts.groupBy(IMAGE).agg(F.collect_list(F.struct("dx", "dy")).alias("shift"))
    cloud = df.where(F.col("mask") == 2).select(IMAGE, "y", "x")
    # One row a date, joined where the clouds are; its shifts are then rows on that side, without a shuffle of their own.
    hit = per_date(cloud, shifts, "inner").select(IMAGE, "y", "x", F.inline("shift"))
    hit = hit.select(IMAGE, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()
    hit = hit.withColumn("potential", F.lit(1))
    ends = heights.groupBy(IMAGE, "corner").agg(F.max_by(F.struct("dx", "dy"), "k").alias("e")).select(IMAGE, "e.dx", "e.dy")
    size = df.groupBy(IMAGE).agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"))
    edges = ends.join(size, IMAGE).groupBy(IMAGE).agg(
        F.min(F.when(F.col("dx") <= 0, F.col("nx") - 1 + F.col("dx"))).alias("right"),
        F.max(F.when(F.col("dx") > 0, F.col("dx"))).alias("left"),
        F.min(F.when(F.col("dy") <= 0, F.col("ny") - 1 + F.col("dy"))).alias("bottom"),
        F.max(F.when(F.col("dy") > 0, F.col("dy"))).alias("top"),
    )
    strip = (F.col("x") >= F.col("right")) | (F.col("x") <= F.col("left")) | (F.col("y") >= F.col("bottom")) | (F.col("y") <= F.col("top"))
    out = per_date(df.join(hit, [IMAGE, "y", "x"], "left"), edges)
    return out.withColumn("zone", F.when(F.coalesce(strip, F.lit(False)), 99).otherwise(F.coalesce("potential", F.lit(0)))).drop("potential", "right", "left", "bottom", "top")
