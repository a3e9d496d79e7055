"""Scene catalogs: a data source over saved search results, paging, address rewriting, and areas of interest."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sensor string, item_id string, datetime timestamp, min_x double, min_y double, max_x double, max_y double, assets map<string, string>"
PAGE = 100
# Names of the two collections, and the two address prefixes.
COLLECTIONS = {"S30": "HLSS30.v2.0", "L30": "HLSL30.v2.0"}
WEB, STORE = "https://data.lpdaac.earthdatacloud.nasa.gov/lp-prod-protected", "s3://lp-prod-protected"


class Part(InputPartition):
    def __init__(self, sensor: str, path: str):
        self.sensor, self.path = sensor, path


class Reader(DataSourceReader):
    """Reads JSON files of items, one partition a sensor; the options sensor, since, until and bbox say what to read.

    They are options and not pushed filters, as a reader that keeps filters keeps them for later queries on the same frame."""

    def __init__(self, options: dict):
        from datetime import datetime, timezone

        self.path = options.get("path", "")
        self.box = [float(x) for x in options["bbox"].split(",")] if options.get("bbox") else None
        self.sensors = [s for s in COLLECTIONS if options.get("sensor", s) == s]
        at = lambda k: datetime.fromisoformat(options[k]).replace(tzinfo=timezone.utc) if options.get(k) else None
        self.since, self.until = at("since"), at("until")

    def partitions(self) -> Sequence[InputPartition]:
        return [Part(s, f"{self.path}/{s}.json") for s in self.sensors]

    def read(self, part: Part) -> Iterator[tuple]:
        import os
        from datetime import datetime, timezone

        if not os.path.exists(part.path):
            return
        with open(part.path) as f:
            items = json.load(f)["features"]
        for i in items:
            at = datetime.fromisoformat(i["properties"]["datetime"].replace("Z", "+00:00")).astimezone(timezone.utc)
            plain = at.replace(tzinfo=None)
            box = i.get("bbox") or [None] * 4
            if self.since and at < self.since or self.until and at > self.until:
                continue
            if self.box and box[0] is not None and (box[0] > self.box[2] or box[2] < self.box[0] or box[1] > self.box[3] or box[3] < self.box[1]):
                continue
            yield part.sensor, i["id"], plain.replace(tzinfo=timezone.utc), *box, {k: v["href"] for k, v in i.get("assets", {}).items()}


class SceneCatalog(DataSource):
    """spark.read.format("scene_catalog").option("bbox", "minx,miny,maxx,maxy").option("since", "2024-01-01").load(folder of S30.json and L30.json)"""

    @classmethod
    def name(cls) -> str:
        return "scene_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(SceneCatalog)


def items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON documents of any store that Spark reads: one search result, or one item, a document."""
    kind = "struct<id:string, collection:string, properties:struct<datetime:string>, bbox:array<double>, assets:map<string, struct<href:string>>>"
    docs = spark.read.text(path, wholetext=True)
    both = F.from_json("value", f"struct<features:array<{kind}>, id:string, collection:string, properties:struct<datetime:string>, bbox:array<double>, assets:map<string, struct<href:string>>>")
    one = F.struct(*[F.col(f"j.{c}").alias(c) for c in ("id", "collection", "properties", "bbox", "assets")])
    rows = docs.select(both.alias("j")).select(F.explode(F.coalesce("j.features", F.array(one))).alias("i"))
    sensor = F.when(F.col("i.collection").contains("S30"), "S30").otherwise("L30")
    box = [F.get("i.bbox", F.lit(k)).alias(n) for k, n in enumerate(("min_x", "min_y", "max_x", "max_y"))]
    return rows.select(sensor.alias("sensor"), F.col("i.id").alias("item_id"), F.to_timestamp("i.properties.datetime").alias("datetime"), *box, F.transform_values("i.assets", lambda _, v: v["href"]).alias("assets"))


def within(df: DataFrame, bbox: Sequence[float], start: str, end: str) -> DataFrame:
    """Items that touch the box (in degrees) from ``start`` to ``end``, both at midnight."""
    a, b, c, d = (float(v) for v in bbox)
    near = (F.col("min_x") <= c) & (F.col("max_x") >= a) & (F.col("min_y") <= d) & (F.col("max_y") >= b)
    return df.where(near & F.col("datetime").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def page(df: DataFrame, after: tuple[object, object] | None = None, size: int = PAGE) -> DataFrame:
    """The next ``size`` items of each sensor in order of time and id, after the (datetime, item_id) given."""
    if after is not None:
        t, i = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col("datetime") > t) | ((F.col("datetime") == t) & (F.col("item_id") > i)))
    w = Window.partitionBy("sensor").orderBy("datetime", "item_id")
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= size).drop("_nth")


def paged(df: DataFrame, limit: int = PAGE) -> DataFrame:
    """The first ``limit`` items of each sensor, rounded up to whole pages, with the number of the page."""
    pages = max(1, math.ceil(limit / PAGE))
    w = Window.partitionBy("sensor").orderBy("datetime", "item_id")
    df = df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= pages * PAGE)
    return df.withColumn("page", F.floor((F.col("_nth") - 1) / PAGE).cast("int")).drop("_nth")


def in_store(href: Column) -> Column:
    """A web address as the same object's address in the store."""
    return F.replace(href, F.lit(WEB), F.lit(STORE))


def assets_in_store(df: DataFrame) -> DataFrame:
    return df.withColumn("assets", F.transform_values("assets", lambda _, v: in_store(v)))


def degrees(x: float, y: float, zone: int = 13, north: bool = True) -> tuple[float, float]:
    """Longitude and latitude of a point in a UTM zone (WGS 84), by Krueger's series to the fourth order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    xi, eta = ((y if north else y - 1e7) / (0.9996 * radius)), (x - 5e5) / (0.9996 * radius)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    p = xi - sum(b * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    q = eta - sum(b * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = math.asin(math.sin(p) / math.cosh(q))
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    lat = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    lon = math.atan2(math.sinh(q), math.cos(p))
    return zone * 6 - 183 + math.degrees(lon), math.degrees(lat)


def box_in_degrees(bbox: Sequence[float], zone: int = 13) -> tuple[float, float, float, float]:
    """A box in UTM metres, any sequence of four numbers, as its corners' box in degrees."""
    a, b, c, d = bbox
    return (*degrees(a, b, zone), *degrees(c, d, zone))
