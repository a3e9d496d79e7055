"""Queries on catalogs and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions.indices import ndvi
from furrow.operators import cube, zones
from furrow.plans.observations import INDEX_SQL
from furrow.plans.registry import query
from furrow.plans.views import OBS, SCENES, ZONES_SQL, obs, scenes, zone_edges
from furrow.sources import catalog

WITH = f"WITH obs AS ({OBS}), edge AS ({ZONES_SQL})"
_INSIDE = """p AS (SELECT DISTINCT y, x FROM obs), i AS (SELECT p.y, p.x, e.zone_id FROM p JOIN edge e ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / nullif(e.y2 - e.y1, 0)
  GROUP BY p.y, p.x, e.zone_id HAVING count(*) % 2 = 1), z AS (SELECT y, x, max(zone_id) AS zone FROM i GROUP BY y, x)"""


@query("zone_assign", f"{WITH}, {_INSIDE} SELECT p.y, p.x, CAST(coalesce(z.zone, 0) AS INTEGER) AS zone FROM p LEFT JOIN z ON z.y = p.y AND z.x = p.x")
def zone_assign(spark, d):
    return zones.assigned(obs(spark, d).select("y", "x").distinct(), zone_edges(spark)).select("y", "x", "zone")


@query("zone_mean", f"{WITH}, {_INSIDE} SELECT CAST(coalesce(z.zone, 0) AS INTEGER) AS zone, count(*) AS n, round(avg({INDEX_SQL['NDVI']}), 6) AS ndvi FROM obs o LEFT JOIN z ON z.y = o.y AND z.x = o.x GROUP BY 1")
def zone_mean(spark, d):
    o = zones.assigned(obs(spark, d), zone_edges(spark))
    return o.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ndvi()), 6).alias("ndvi"))


CAT = f"WITH s AS ({SCENES})"


@query("catalog_page", f"{CAT} SELECT item_id, sensor, datetime FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY datetime, item_id) AS k FROM s WHERE datetime > TIMESTAMP '2024-01-10 00:00:00') WHERE k <= 100")
def catalog_page(spark, d):
    import datetime

    after = (datetime.datetime(2024, 1, 10, tzinfo=datetime.timezone.utc), 1 << 62)
    return catalog.page(scenes(spark, d), after).select("item_id", "sensor", F.col("datetime"))


@query("catalog_paged", f"{CAT} SELECT sensor, CAST((k - 1) // 100 AS INTEGER) AS page, count(*) AS n, min(item_id) AS low FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY datetime, item_id) AS k FROM s) WHERE k <= 300 GROUP BY ALL")
def catalog_paged(spark, d):
    return catalog.paged(scenes(spark, d), 250).groupBy("sensor", "page").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("low"))


_HREF = f"'{catalog.WEB}/' || sensor || '/' || item_id || '.tif'"


@query("catalog_href_rewrite", f"{CAT} SELECT item_id, '{catalog.STORE}/' || sensor || '/' || item_id || '.tif' AS href FROM s")
def catalog_href(spark, d):
    s = scenes(spark, d).select("item_id", F.create_map(F.lit("B02"), F.concat(F.lit(catalog.WEB + "/"), "sensor", F.lit("/"), F.col("item_id").cast("string"), F.lit(".tif"))).alias("assets"))
    return catalog.assets_in_store(s).select("item_id", F.col("assets")["B02"].alias("href"))


@query("catalog_json", f"{CAT} SELECT sensor, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM s GROUP BY ALL")
def catalog_json(spark, d):
    return scenes(spark, d).groupBy("sensor", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("catalog_dates", f"{CAT} SELECT sensor, CAST(datetime AS DATE) AS t, count(*) AS n FROM s WHERE datetime BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' GROUP BY ALL")
def catalog_dates(spark, d):
    s = scenes(spark, d).withColumns({"min_x": F.lit(-105.0), "max_x": F.lit(-104.0), "min_y": F.lit(40.0), "max_y": F.lit(41.0)})
    s = catalog.within(s, (-104.5, 40.5, -103.0, 42.0), "2024-01-03", "2024-01-20")
    return cube.dated(s).groupBy("sensor", "t").agg(F.count(F.lit(1)).alias("n"))


@query(
    "day_spine",
    f"WITH obs AS ({OBS}), b AS (SELECT min(t) AS a, max(t) AS z FROM obs), days AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS t, a FROM b), p AS (SELECT DISTINCT y, x FROM obs), "
    "g AS (SELECT y, x, t, max(RED) AS RED FROM obs GROUP BY y, x, t) SELECT p.y, p.x, days.t, CAST(days.t - CAST(days.a AS DATE) AS INTEGER) AS t_idx, g.RED FROM p CROSS JOIN days LEFT JOIN g ON g.y = p.y AND g.x = p.x AND g.t = days.t",
)
def day_spine(spark, d):
    return cube.with_days(obs(spark, d), "RED").select("y", "x", "t", "t_idx", "RED")
