"""Queries on images: windows, components, buffers, shadow projection, the staged cloud mask."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions.bands import band
from furrow.operators import atsa, raster
from furrow.plans.registry import query
from furrow.plans.views import CHIP_SQL, chips

WITH = f"WITH chip AS ({CHIP_SQL})"


def near(flag: str, size: int, src: str = "chip") -> str:
    """SQL: the rows of ``src`` with the trailing sum of a flag, by a join with the window's pixels."""
    return f"""(SELECT a.t, a.y, a.x, any_value(a.mask) AS mask, CASE WHEN a.y >= {size - 1} AND a.x >= {size - 1} THEN CAST(sum(CASE WHEN b.{flag} THEN 1 ELSE 0 END) AS BIGINT) END AS near
  FROM {src} a JOIN {src} b ON b.t = a.t AND b.y BETWEEN a.y - {size - 1} AND a.y AND b.x BETWEEN a.x - {size - 1} AND a.x GROUP BY a.t, a.y, a.x)"""


@query("roll4_sum", f"{WITH} SELECT t, y, x, near FROM {near('mask = 2', 4)}")
def roll4(spark, d):
    return raster.window_sum(chips(spark, d), F.col("mask") == 2, 4, "near").select("t", "y", "x", "near")


@query("roll4_isolated", f"{WITH} SELECT t, y, x, CASE WHEN mask = 2 AND near <= 4 THEN 1 ELSE mask END AS mask FROM {near('mask = 2', 4)}")
def isolated(spark, d):
    return raster.without_lone_clouds(chips(spark, d), 1).select("t", "y", "x", "mask")


#: All six rounds, and the first after which no date has moved by five or more.
_ROUNDS, _SRC = WITH, "chip"
for _k in range(6):
    _ROUNDS += f""", c{_k} AS (SELECT n.t, n.y, n.x, CASE WHEN n.mask = 2 AND n.near <= 4 THEN 1 ELSE chip.mask END AS mask
  FROM {near('mask = 2', 4, _SRC)} n JOIN chip ON chip.t = n.t AND chip.y = n.y AND chip.x = n.x),
m{_k} AS (SELECT coalesce(max(s), 0) AS moved FROM (SELECT sum(abs(c.mask - chip.mask)) AS s FROM c{_k} c JOIN chip ON chip.t = c.t AND chip.y = c.y AND chip.x = c.x GROUP BY c.t))"""
    _SRC = f"c{_k}"
_ROUNDS += ", k AS (SELECT CASE " + " ".join(f"WHEN (SELECT moved FROM m{i}) < 5 THEN {i}" for i in range(5)) + " ELSE 5 END AS k)"


@query("remove_cloud_repeated", f"{_ROUNDS} " + " UNION ALL ".join(f"SELECT t, y, x, mask FROM c{i} WHERE (SELECT k FROM k) = {i}" for i in range(6)))
def isolated_repeated(spark, d):
    return raster.without_lone_clouds(chips(spark, d), 2).select("t", "y", "x", "mask")


def component_sql(code: int, least: int = 8) -> str:
    """SQL: the pixels of a code that reach at least ``least`` pixels of it, 4-connected."""
    return f"""px AS (SELECT t, y * 8 + x AS p, y, x FROM chip WHERE mask = {code}),
e AS (SELECT a.t, a.p AS a, b.p AS b FROM px a JOIN px b ON a.t = b.t AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
r(t, a, b) AS (SELECT t, p, p FROM px UNION SELECT r.t, r.a, e.b FROM r JOIN e ON e.t = r.t AND e.a = r.b),
big AS (SELECT t, a AS p FROM r GROUP BY t, a HAVING count(*) >= {least})"""


RECURSIVE = WITH.replace("WITH", "WITH RECURSIVE", 1)


@query("small_objects", f"{RECURSIVE}, {component_sql(2)} SELECT c.t, c.y, c.x, big.p IS NOT NULL AS big FROM chip c LEFT JOIN big ON big.t = c.t AND big.p = c.y * 8 + c.x WHERE c.mask = 2")
def small_objects(spark, d):
    return raster.components(chips(spark, d), 2).where("mask = 2").select("t", "y", "x", "big")


def _removed(code: int) -> str:
    return f"""{RECURSIVE}, {component_sql(code)} SELECT c.t, c.y, c.x, CASE WHEN c.mask = {code} AND near <= 8 AND big.p IS NULL THEN 1 ELSE c.mask END AS mask
FROM {near(f'mask = {code}', 4)} c LEFT JOIN big ON big.t = c.t AND big.p = c.y * 8 + c.x"""


@query("remove_cloud", _removed(2))
def remove_cloud(spark, d):
    return raster.without_lone_clouds(chips(spark, d), 3).select("t", "y", "x", "mask")


@query("remove_shadow", _removed(0))
def remove_shadow(spark, d):
    return raster.without_lone_shadows(chips(spark, d), 3).select("t", "y", "x", "mask")


@query("buffer_cloud", f"{WITH} SELECT t, y, x, CASE WHEN near > 0 THEN 2 ELSE mask END AS mask FROM {near('mask = 2', 4)}")
def buffer_cloud(spark, d):
    return raster.cloud_buffer(chips(spark, d), 3).select("t", "y", "x", "mask")


def _buffer(kind: int, able: str) -> None:
    edged = "CASE WHEN mask = 1 AND x = 7 THEN 99 ELSE mask END"

    @query(
        f"buffer_shadow_{kind}",
        f"{WITH}, e AS (SELECT t, y, x, {edged} AS mask FROM chip) SELECT t, y, x, CASE WHEN near > 0 AND {able} THEN 0 ELSE mask END AS mask FROM {near('mask = 0', 4, 'e')}",
    )
    def run(spark, d):
        c = chips(spark, d).withColumn("mask", F.when((F.col("mask") == 1) & (F.col("x") == 7), 99).otherwise(F.col("mask")))
        return raster.shadow_buffer(c, 3, kind).select("t", "y", "x", "mask")


_buffer(1, "mask = 1")
_buffer(2, "mask IN (1, 99)")
_buffer(3, "mask NOT IN (2, 3)")

#: Angles of a date in hundredths of a degree.
_ANGLES = {"sza": "2000 + t * 37 % 4000 + 300 * c", "saa": "9000 + t * 53 % 9000 + 4000 * c", "vza": "100 + t * 7 % 900 + 50 * c", "vaa": "10000 + t * 11 % 9000 - 700 * c"}
LONGEST, SHORTEST = 8, 0


@query(
    "shadow_project",
    f"""{WITH}, a AS (SELECT DISTINCT t, c.c AS corner, {', '.join(f'radians(({e}) * 0.01e0) AS {n}' for n, e in _ANGLES.items())} FROM chip, range(0, 4) c(c)),
b AS (SELECT *, sqrt(pow(tan(sza) * sin(saa), 2) + pow(tan(sza) * cos(saa), 2)) AS reach FROM a),
h AS (SELECT b.*, {SHORTEST} / reach + 3 * k.k AS h, k.k AS k FROM b, range(0, 100) k(k) WHERE k.k < ceil(round(({LONGEST} / reach - {SHORTEST} / reach) / 3, 9))),
s AS (SELECT t, corner, k, CAST(round_even(round(-(h * tan(sza) * sin(saa)), 9), 0) + round_even(round(h * tan(vza) * sin(vaa), 9), 0) AS INTEGER) AS dx,
             CAST(round_even(round(h * tan(sza) * cos(saa), 9), 0) + round_even(round(h * tan(vza) * cos(vaa), 9), 0) AS INTEGER) AS dy FROM h),
z AS (SELECT t, dx, dy FROM s UNION SELECT DISTINCT t, 0, 0 FROM chip),
hit AS (SELECT DISTINCT c.t, c.y + z.dy AS y, c.x + z.dx AS x FROM chip c JOIN z ON z.t = c.t WHERE c.mask = 2),
f AS (SELECT t, corner, arg_max(dx, k) AS ex, arg_max(dy, k) AS ey FROM s GROUP BY t, corner),
e AS (SELECT t, max(CASE WHEN ex > 0 THEN ex END) AS l, min(CASE WHEN ex <= 0 THEN 7 + ex END) AS r, max(CASE WHEN ey > 0 THEN ey END) AS u, min(CASE WHEN ey <= 0 THEN 7 + ey END) AS d FROM f GROUP BY t)
SELECT c.t, c.y, c.x, CAST(CASE WHEN coalesce(c.x <= e.l OR c.x >= e.r OR c.y <= e.u OR c.y >= e.d, false) THEN 99
  WHEN hit.t IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS zone
FROM chip c LEFT JOIN hit ON hit.t = c.t AND hit.y = c.y AND hit.x = c.x LEFT JOIN e ON e.t = c.t""",
)
def shadow_project(spark, d):
    c = chips(spark, d)
    corners = F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)]))
    angles = c.select("t").distinct().select("t", corners.alias("c")).select("t", F.col("c").alias("corner"), *[F.expr(e).cast("double").alias(n) for n, e in _ANGLES.items()])
    return raster.shadow_zone(c, angles, LONGEST, SHORTEST).select("t", "y", "x", "zone")


def scene(spark, d, dates: int | None = None):
    """A scene of 24 x 24 pixels out of chips: nine of them a date, with bands that follow their values. All chips,
    so that the dates grow with the table, or those of the first ``dates`` alone."""
    c = chips(spark, d)
    if dates is None:
        top = spark.read.parquet(f"{d}/embeddings.parquet").agg(F.max("vec_id")).first()[0]
        dates = (top or 0) // 9 + 1
    c = c.where(F.col("t") < 9 * dates)
    c = c.select((F.col("t") % dates).alias("t"), (F.col("y") + 8 * F.floor(F.col("t") / dates / 3)).cast("int").alias("y"), (F.col("x") + 8 * (F.floor(F.col("t") / dates) % 3)).cast("int").alias("x"), "val", "mask")
    bright = F.when(F.col("mask") == 2, 2500).when(F.col("mask") == 0, -150).otherwise(0)
    noise = lambda k: F.floor(F.abs(F.col("val")) * k)
    cols = {"BLUE": 400 + bright + noise(900), "GREEN": 600 + bright + noise(800), "RED": 500 + bright * 1.1 + noise(1100), "NIR1": 2500 + bright + noise(2000), "SWIR1": 2000 + bright * 0.8 + noise(1500), "SWIR2": 1200 + bright * 0.6 + noise(900)}
    fmask = F.when(F.col("mask") == 2, 2).when(F.col("mask") == 0, 8).otherwise(0)
    angles = {"SZA": 3000.0, "SAA": 15000.0, "VZA": 500.0, "VAA": 10000.0}
    return c.select("t", "y", "x", *[v.cast("double").alias(k) for k, v in cols.items()], fmask.alias("FMASK"), *[F.lit(v).alias(k) for k, v in angles.items()])


@query("atsa_prepare")
def atsa_prepare(spark, d):
    return atsa.prepared(scene(spark, d)).select("t", "y", "x", "qa", "water", "qa_cloud", "qa_shadow", band("BLUE").alias("BLUE"))


@query("atsa_mask")
def atsa_mask(spark, d):
    return atsa.mask(scene(spark, d), atsa.Parameters(longest=12))
