"""Deterministic views of the driver's tables that stand for imagery; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _nd(m: int, a: int, b: int, off: int, mod: int) -> str:
    return f"CAST(CASE WHEN l_orderkey % {m} = 0 THEN -9999 ELSE {off} + (l_partkey*{a} + l_orderkey*{b}) % {mod} END AS DOUBLE)"


#: The same text is valid in both engines.
OBS = f"""
SELECT CAST(l_suppkey AS INT) AS y, CAST(l_linenumber AS INT) AS x, CAST(l_shipdate AS DATE) AS t,
       CASE WHEN l_linestatus = 'F' THEN 'S30' ELSE 'L30' END AS sensor,
       {_nd(97, 13, 7, 200, 1800)} AS BLUE, {_nd(97, 17, 11, 300, 2200)} AS GREEN, {_nd(101, 19, 5, 200, 2600)} AS RED,
       {_nd(103, 23, 3, 500, 4500)} AS NIR1, {_nd(107, 29, 2, 400, 3800)} AS SWIR1, {_nd(109, 31, 1, 300, 3000)} AS SWIR2,
       CAST(l_orderkey % 256 AS INT) AS FMASK,
       CAST(3000 + l_suppkey % 3000 AS DOUBLE) AS SZA, CAST(14000 + l_partkey % 3000 AS DOUBLE) AS SAA,
       CAST(l_linenumber * 100 AS DOUBLE) AS VZA, CAST(10000 + l_suppkey % 1000 AS DOUBLE) AS VAA
FROM lineitem"""

DAILY = """
SELECT p.pix, d.t_idx, o.v
FROM (SELECT DISTINCT user_id AS pix FROM events) p
CROSS JOIN (SELECT DISTINCT CAST(day(ts) AS INT) - 1 AS t_idx FROM events) d
LEFT JOIN (SELECT user_id AS pix, CAST(day(ts) AS INT) - 1 AS t_idx, max(value) AS v FROM events
           WHERE (user_id * 7 + day(ts)) % 3 <> 0
           GROUP BY user_id, CAST(day(ts) AS INT) - 1) o
  ON o.pix = p.pix AND o.t_idx = d.t_idx"""

SEASON = """
SELECT p.pix, d.i AS t_idx,
       CAST(CASE WHEN o.m IS NULL THEN NULL ELSE
            1.5e-1 + 4e-1 * greatest(0e0, least((d.i - 90) / 9e1, 1e0 - (d.i - 200) / 1.2e2))
                   + 2e-2 * (o.m - 4e-2) / 4e-2 END AS DOUBLE) AS v
FROM (SELECT DISTINCT l_suppkey AS pix FROM lineitem) p
CROSS JOIN (SELECT DISTINCT CAST(dayofyear(l_shipdate) AS INT) - 1 AS i FROM lineitem
            WHERE dayofyear(l_shipdate) <= 365) d
LEFT JOIN (SELECT l_suppkey AS pix, CAST(dayofyear(l_shipdate) AS INT) - 1 AS i, max(l_tax) AS m
           FROM lineitem GROUP BY l_suppkey, CAST(dayofyear(l_shipdate) AS INT) - 1) o
  ON o.pix = p.pix AND o.i = d.i"""

_CODE = "CASE WHEN {e} > 1e-1 THEN 2 WHEN {e} < -2e-1 THEN 0 ELSE 1 END"
CHIP_SPARK = f"""
SELECT vec_id AS t, CAST(pos DIV 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(e AS DOUBLE) AS val, {_CODE.format(e="e")} AS mask
FROM embeddings LATERAL VIEW posexplode(embedding) q AS pos, e"""
CHIP_SQL = f"""
SELECT vec_id AS t, CAST((i-1)//8 AS INT) AS y, CAST((i-1)%8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS val, {_CODE.format(e="embedding[i]")} AS mask
FROM embeddings, range(1,65) r(i)"""

#: Edges of the zones: (zone, edge, x1, y1, x2, y2); half-integer corners, so no pixel centre lies on an edge.
ZONE_EDGES = [
    (1, 1, 0.5, -0.5, 3.5, -0.5), (1, 2, 3.5, -0.5, 3.5, 49.5), (1, 3, 3.5, 49.5, 0.5, 49.5), (1, 4, 0.5, 49.5, 0.5, -0.5),
    (2, 1, 2.5, 20.5, 7.5, 20.5), (2, 2, 7.5, 20.5, 5.5, 80.5), (2, 3, 5.5, 80.5, 2.5, 20.5),
]
ZONES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({z}, {k}, {a}e0, {b}e0, {c}e0, {d}e0)" for z, k, a, b, c, d in ZONE_EDGES) + ") z(zone_id, ord, x1, y1, x2, y2)"

SCENES = "SELECT event_id AS item_id, CASE WHEN event_id % 2 = 0 THEN 'S30' ELSE 'L30' END AS sensor, ts AS datetime, props FROM events"

#: Models invented for the queries.
BIOMASS = {"name": "biomass_demo", "intercept": 200.0, "coef": {"NDVI": 1500.0, "DFI": 8.0, "SWIR1": -0.02, "TCGI": 900.0}}
BOOTSTRAP = [{"name": f"boot_{b:02d}", "intercept": 200.0 + 3 * b, "coef": {"NDVI": 1500.0 - 5 * b, "DFI": 8.0, "SWIR1": -0.02, "TCGI": 900.0}} for b in range(20)]
PROTEIN = {"name": "cp_demo", "intercept": 8.0, "coef": {"NDVI": 6.0, "NDVI_d30": 10.0, "iNDVI": 0.05, "t_SOS": -0.02, "iNDVI_dry": -0.3}}


def _table(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {src}"), src=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem", OBS)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events", DAILY)


def season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem", SEASON)


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings", CHIP_SPARK)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events", SCENES)


def zone_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONE_EDGES, "zone_id int, ord int, x1 double, y1 double, x2 double, y2 double")
