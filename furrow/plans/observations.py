"""Queries on single observations: bands, indices, quality masks, dates, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import qa, scalars
from furrow.functions.bands import ASSETS, BANDS, NEEDED, band
from furrow.functions.indices import CENTRES, INDICES, TASSELLED, with_features
from furrow.operators import cube
from furrow.plans.registry import query
from furrow.plans.views import OBS, obs

WITH = f"WITH obs AS ({OBS})"
#: The bands as SQL, nodata as NULL, and as reflectance.
N = {b: f"nullif({b}, -9999)" for b in BANDS}
S = {b: f"(nullif({b}, -9999) * 0.0001e0)" for b in BANDS}


def _norm(a: str, b: str) -> str:
    return f"(({N[a]} - {N[b]}) / nullif({N[a]} + {N[b]}, 0))"


def _open(e: str) -> str:
    return f"CASE WHEN {e} < 1 AND {e} > -1 THEN {e} END"


def _angle(p: str, q: str) -> str:
    x1, x2 = (CENTRES[q] - CENTRES[p]) / 2500, (CENTRES["SWIR2"] - CENTRES[q]) / 2500
    e = f"(180e0 - atan((({N[q]} - {N[p]}) * 0.0001e0) / {x1!r}e0) * 57.2958e0 + atan((({N['SWIR2']} - {N[q]}) * 0.0001e0) / {x2!r}e0) * 57.2958e0)"
    return f"CASE WHEN {e} > 0 THEN {e} END"


def _cap(name: str) -> str:
    return "(" + " + ".join(f"{S[b]} * {w!r}e0" for b, w in zip(BANDS, TASSELLED[name], strict=True)) + ")"


INDEX_SQL = {
    "NDVI": _open(_norm("NIR1", "RED")),
    "DFI": f"100e0 * (1e0 - {N['SWIR2']} / nullif({N['SWIR1']}, 0)) * ({N['RED']} / nullif({N['NIR1']}, 0))",
    "NDTI": _open(_norm("SWIR1", "SWIR2")),
    "SAVI": f"({S['NIR1']} - {S['RED']}) / nullif({S['NIR1']} + {S['RED']} + 0.5e0, 0) * 1.5e0",
    "SATVI": f"({S['SWIR1']} - {S['RED']}) / nullif({S['SWIR1']} + {S['RED']} + 0.5e0, 0) * 1.5e0 - {S['SWIR2']} / 2",
    "NDII7": _norm("NIR1", "SWIR2"),
    "NDWI": _norm("NIR1", "SWIR1"),
    "EVI": f"2.5e0 * (({S['NIR1']} - {S['RED']}) / nullif({S['NIR1']} + {S['RED']} * 6 - {S['BLUE']} * 7.5e0 + 1, 0))",
    "TCBI": _cap("TCBI"),
    "TCGI": _cap("TCGI"),
    "TCWI": _cap("TCWI"),
    "PSRI": f"({N['RED']} - {N['GREEN']}) / nullif({N['NIR1']}, 0)",
    "MTVI1": f"(({S['NIR1']} - {S['GREEN']}) * 1.2e0 - ({S['RED']} - {S['GREEN']}) * 2.5e0) * 1.2e0",
    "NCI": _norm("SWIR1", "GREEN"),
    "NDCI": _norm("SWIR1", "RED"),
    "RDVI": f"({N['NIR1']} - {N['RED']}) / nullif(sqrt(CASE WHEN {N['NIR1']} + {N['RED']} >= 0 THEN {N['NIR1']} + {N['RED']} END), 0)",
    "BAI_126": _angle("BLUE", "GREEN"),
    "BAI_136": _angle("BLUE", "RED"),
    "BAI_146": _angle("BLUE", "NIR1"),
    "BAI_236": _angle("GREEN", "RED"),
    "BAI_246": _angle("GREEN", "NIR1"),
    "BAI_346": _angle("RED", "NIR1"),
}


#: Places to round to: weights and scales of four places make exact halves at the sixth.
PLACES = {n: 9 if n in ("SAVI", *TASSELLED) else 6 for n in INDEX_SQL}


def _one(name: str) -> None:
    f = INDICES[name]

    @query(f"idx_{name.lower()}", f"{WITH} SELECT y, x, t, sensor, round({INDEX_SQL[name]}, {PLACES[name]}) AS value FROM obs")
    def run(spark, d):
        return obs(spark, d).select("y", "x", "t", "sensor", F.round(f(), PLACES[name]).alias("value"))


def _band(name: str) -> None:
    @query(f"band_{name.lower()}", f"{WITH} SELECT y, x, t, sensor, {N[name]} AS value FROM obs")
    def run(spark, d):
        return obs(spark, d).select("y", "x", "t", "sensor", band(name).alias("value"))


for _n in INDICES:
    _one(_n)
for _n in BANDS:
    _band(_n)


@query("indices_all", f"{WITH} SELECT y, x, t, sensor, " + ", ".join(f"round({e}, {PLACES[n]}) AS {n}" for n, e in INDEX_SQL.items()) + " FROM obs")
def indices_all(spark, d):
    o = with_features(obs(spark, d), list(INDICES))
    return o.select("y", "x", "t", "sensor", *[F.round(n, PLACES[n]).alias(n) for n in INDICES])


def _bit(b: int) -> str:
    return f"((FMASK >> {b}) & 1)"


QA_SQL = {n: _bit(b) for n, b in qa.BITS.items()} | {n: f"CASE WHEN {_bit(6)} = {a} AND {_bit(7)} = {b} THEN 1 ELSE 0 END" for n, (a, b) in qa.AEROSOL.items()}
QA_SQL["any_aerosol"] = f"greatest({', '.join(QA_SQL[n] for n in qa.AEROSOL)})"
ALL_SQL = f"greatest({', '.join(QA_SQL[n] for n in qa.ALL)})"


def _mask(name: str, names: list[str], sql: str) -> None:
    @query(f"qa_{name}", f"{WITH} SELECT y, x, t, sensor, CAST({sql} AS INTEGER) AS mask FROM obs")
    def run(spark, d):
        return obs(spark, d).select("y", "x", "t", "sensor", qa.masked(names).cast("int").alias("mask"))


for _n in qa.NAMES:
    _mask(_n, [_n], QA_SQL[_n])
_mask("all", ["all"], ALL_SQL)
_mask("cloud_or_shadow", ["cloud", "shadow"], f"greatest({QA_SQL['cloud']}, {QA_SQL['shadow']})")


@query(
    "flagship_ndvi_by_month",
    f"{WITH} SELECT sensor, CAST(month(t) AS INTEGER) AS month, CAST(year(t) AS INTEGER) AS year, round(avg({INDEX_SQL['NDVI']}), 6) AS ndvi, count(*) AS n FROM obs WHERE {ALL_SQL} = 0 GROUP BY ALL",
)
def flagship(spark, d):
    """Mean NDVI of clear observations by sensor and month."""
    clear = obs(spark, d).where(qa.masked(["all"]) == 0).select("sensor", F.month("t").alias("month"), F.year("t").alias("year"), INDICES["NDVI"]().alias("v"))
    return clear.groupBy("sensor", "month", "year").agg(F.round(F.avg("v"), 6).alias("ndvi"), F.count(F.lit(1)).alias("n"))




@query("band_harmonize_pivot", f"{WITH} SELECT sensor, y, x, t, {', '.join(f'CAST(max({b}) AS DOUBLE) AS {b}' for b in NEEDED)} FROM obs GROUP BY sensor, y, x, t")
def harmonise(spark, d):
    """Long rows under each sensor's own asset names, and back to one column a band."""
    return cube.harmonised(cube.to_long(obs(spark, d)))


@query("asset_projection", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{a}', '{b}')" for s, m in ASSETS.items() for a, b in m.items() if b in NEEDED) + ") v(sensor, asset, band)")
def assets(spark, d):
    return cube.band_table(spark).where(F.col("band").isin(*NEEDED))


@query("sensor_union", f"{WITH} SELECT sensor, t, count(*) AS n FROM (SELECT * FROM obs WHERE sensor = 'S30' UNION ALL SELECT * FROM obs WHERE sensor = 'L30') GROUP BY sensor, t")
def union(spark, d):
    o = obs(spark, d)
    return cube.united(spark, o.where("sensor = 'S30'"), None, o.where("sensor = 'L30'")).groupBy("sensor", "t").agg(F.count(F.lit(1)).alias("n"))




@query("composite_mean", f"{WITH} SELECT y, x, t, " + ", ".join(f"round(avg({N[b]}), 6) AS {b}" for b in BANDS) + " FROM obs GROUP BY y, x, t")
def composite_mean(spark, d):
    o = obs(spark, d).withColumns({b: band(b) for b in BANDS})
    return cube.composite(o, BANDS).select("y", "x", "t", *[F.round(b, 6).alias(b) for b in BANDS])


@query("composite_first", f"{WITH} SELECT y, x, t, BLUE, RED FROM (SELECT *, row_number() OVER (PARTITION BY y, x, t ORDER BY sensor, BLUE, RED) AS k FROM obs) WHERE k = 1")
def composite_first(spark, d):
    return cube.composite(obs(spark, d), ["BLUE", "RED"], "first")


#: Whole dates lose the near infrared or get snow, so that there is something to drop.
SPARSE = f"""{WITH}, s AS (SELECT y, x, t, BLUE, CASE WHEN day(t) % 5 = 0 THEN NULL ELSE {N['NIR1']} END AS NIR1,
  CASE WHEN day(t) % 7 = 0 THEN 16 ELSE FMASK END AS FMASK FROM obs)"""


def _sparse(spark, d):
    o = obs(spark, d)
    return o.withColumns({"NIR1": F.when(F.day("t") % 5 != 0, band("NIR1")), "FMASK": F.when(F.day("t") % 7 == 0, 16).otherwise(F.col("FMASK"))})


@query("drop_null_dates", f"{SPARSE} SELECT t, count(*) AS n FROM s WHERE t IN (SELECT t FROM s GROUP BY t HAVING count(NIR1) > 0) GROUP BY t")
def drop_null_dates(spark, d):
    return cube.without_empty_dates(_sparse(spark, d)).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


@query("drop_snow_dates", f"{SPARSE} SELECT t, count(*) AS n FROM s WHERE t NOT IN (SELECT t FROM s GROUP BY t HAVING bool_and({_bit(4)} = 1)) GROUP BY t")
def drop_snow_dates(spark, d):
    return cube.without_snow_dates(_sparse(spark, d)).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


@query("null_snow_pixels", f"{WITH} SELECT y, x, t, sensor, FMASK, " + ", ".join(f"CASE WHEN {_bit(4)} = 0 THEN {b} END AS {b}" for b in BANDS) + " FROM obs")
def null_snow_pixels(spark, d):
    return cube.without_snow_pixels(obs(spark, d)).select("y", "x", "t", "sensor", "FMASK", *BANDS)


@query("always_water", f"{WITH} SELECT y, x, CAST(max(w) AS INTEGER) AS water FROM (SELECT y, x, CASE WHEN bool_and({_bit(5)} = 1) OVER (PARTITION BY y, x) THEN 1 ELSE 0 END AS w FROM obs) GROUP BY y, x")
def always_water(spark, d):
    return cube.always_water(obs(spark, d)).groupBy("y", "x").agg(F.max("water").alias("water"))


@query(
    "global_stats",
    f"{WITH} SELECT round(avg({N['BLUE']}), 6) AS mean, round(stddev_pop({N['BLUE']}), 6) AS sd, min({N['BLUE']}) AS low, max({N['BLUE']}) AS high FROM obs WHERE {QA_SQL['cloud']} = 1",
)
def global_stats(spark, d):
    b = band("BLUE")
    return obs(spark, d).where(qa.mask("cloud") == 1).agg(F.round(F.avg(b), 6).alias("mean"), F.round(F.stddev_pop(b), 6).alias("sd"), F.min(b).alias("low"), F.max(b).alias("high"))


@query("counts_by_date", f"{WITH} SELECT t, count_if({ALL_SQL} = 0) AS clear, min({N['BLUE']}) AS low, max({N['BLUE']}) AS high FROM obs GROUP BY t")
def counts_by_date(spark, d):
    return obs(spark, d).groupBy("t").agg(F.count_if(qa.masked(["all"]) == 0).alias("clear"), F.min(band("BLUE")).alias("low"), F.max(band("BLUE")).alias("high"))


@query("counts_by_pixel", f"{WITH} SELECT y, x, count_if({ALL_SQL} = 0) AS clear FROM obs GROUP BY y, x")
def counts_by_pixel(spark, d):
    return obs(spark, d).groupBy("y", "x").agg(F.count_if(qa.masked(["all"]) == 0).alias("clear"))


@query(
    "scalar_functions",
    f"""{WITH} SELECT y, x, t, CASE WHEN RED > 0 THEN sqrt(RED) ELSE 0 END AS root, CASE WHEN RED > 0 THEN RED * RED ELSE 0 END AS square,
  round(radians(SZA * 0.01e0), 9) AS sza, CASE WHEN NIR1 < 500 THEN 1 WHEN NIR1 < 1000 THEN 2 WHEN NIR1 < 1500 THEN 3 ELSE 4 END AS level,
  round(abs(BLUE * 1.5e0 - RED + 20) / sqrt(3.25e0), 6) AS hot, least(greatest(RED / 2000, 0), 1) AS share,
  CAST(CASE WHEN abs(RED * 20) < 32768 THEN trunc(RED * 20) END AS INTEGER) AS small FROM obs""",
)
def scalar_functions(spark, d):
    red = F.col("RED")
    return obs(spark, d).select(
        "y", "x", "t", scalars.root(red).alias("root"), scalars.square(red).alias("square"), F.round(scalars.radians100(F.col("SZA")), 9).alias("sza"), scalars.gauge_level(F.col("NIR1")).alias("level"),
        F.round(scalars.haze_distance(F.col("BLUE"), red, F.lit(1.5), F.lit(20.0)), 6).alias("hot"), scalars.clipped(red / 2000).alias("share"), scalars.small_int(red * 20).cast("int").alias("small"),
    )


_A = scalars.ERF_A
CDF_SQL = (
    "CASE WHEN z >= 0 THEN 1 - {t} ELSE {t} END".replace("{t}", "(((((({a5}*k + {a4})*k) + {a3})*k + {a2})*k + {a1})*k * exp(-z*z/2) / 2)")
    .replace("{a5}", f"{_A[4]}e0").replace("{a4}", f"{_A[3]}e0").replace("{a3}", f"{_A[2]}e0").replace("{a2}", f"{_A[1]}e0").replace("{a1}", f"{_A[0]}e0")
)


@query("normal_cdf", f"{WITH}, z AS (SELECT DISTINCT (RED - 1500) / 500 AS z FROM obs WHERE RED > 0), k AS (SELECT z, 1e0 / (1e0 + {scalars.ERF_P}e0 * abs(z) / sqrt(2e0)) AS k FROM z) SELECT round(z, 6) AS z, round({CDF_SQL}, 6) AS p FROM k")
def normal_cdf(spark, d):
    z = obs(spark, d).where("RED > 0").select(((F.col("RED") - 1500) / 500).alias("z")).distinct()
    return z.select(F.round("z", 6).alias("z"), F.round(scalars.normal_cdf(F.col("z")), 6).alias("p"))
