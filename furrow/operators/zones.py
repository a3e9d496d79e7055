"""Pixels in polygons: zone numbers on the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A set of zones is drawn by hand; up to this many edges it is sent to every task, beyond it is joined by grid columns.
BROADCAST_EDGES = 100_000


def zones(edges: DataFrame) -> DataFrame:
    """(zone_id, ring, box) from edges (zone_id, ord, x1, y1, x2, y2)."""
    ring = F.sort_array(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2")))
    box = {"min_x": F.min(F.least("x1", "x2")), "max_x": F.max(F.greatest("x1", "x2")), "min_y": F.min(F.least("y1", "y2")), "max_y": F.max(F.greatest("y1", "y2"))}
    return edges.groupBy("zone_id").agg(ring.alias("ring"), *[c.alias(n) for n, c in box.items()])


def assigned(pixels: DataFrame, edges: DataFrame, fill: int = 0, order: str = "zone_id") -> DataFrame:
    """``pixels`` (x, y and more) with zone: the zone whose polygon holds the pixel's centre, the last one by ``order`` where several do,
    ``fill`` outside. Distinct pixels are tested, by their zones' boxes first, then by the even-odd rule."""
    z = zones(edges)
    if edges.count() <= BROADCAST_EDGES:
        z = F.broadcast(z)
        on = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    else:
        z = z.withColumn("column", F.explode(F.sequence(F.ceil("min_x").cast("int"), F.floor("max_x").cast("int"))))
        on = (F.col("x") == F.col("column")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    places = pixels.select("x", "y").distinct()

    def crosses(e):
        up = (e["y1"] > F.col("y")) != (e["y2"] > F.col("y"))
        at = e["x1"] + (F.col("y") - e["y1"]) * F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"])
        return F.when(up & (F.col("x") < at), 1).otherwise(0)

    inside = places.join(z, on).where(F.aggregate("ring", F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1)
    found = inside.groupBy("x", "y").agg(F.max_by("zone_id", order).alias("zone"))
    return pixels.join(found, ["x", "y"], "left").withColumn("zone", F.coalesce("zone", F.lit(fill)))
