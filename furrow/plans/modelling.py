"""Queries on haze lines, clusters, samples, gains and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions.bands import band
from furrow.operators import gains, haze, models, stats
from furrow.plans.observations import INDEX_SQL, N, QA_SQL
from furrow.plans.registry import query
from furrow.plans.views import BIOMASS, BOOTSTRAP, DAILY, OBS, daily, obs

WITH = f"WITH obs AS ({OBS})"


def _number(w: float) -> str:
    return repr(float(w)) if "e" in repr(float(w)) else f"{float(w)!r}e0"


def _linear(model: dict) -> str:
    terms = [f"({INDEX_SQL.get(n, N.get(n))}) * {_number(w)}" for n, w in model["coef"].items()]
    return f"({_number(model['intercept'])} + " + " + ".join(terms) + ")"


BM = f"CAST(CASE WHEN abs({_linear(BIOMASS)}) < 32768 THEN trunc({_linear(BIOMASS)}) END AS INTEGER)"
_BOOT = ", ".join(_linear(m) for m in BOOTSTRAP)
SE = f"(list_aggregate([{_BOOT}], 'stddev_samp') + {models.SPREAD}e0)"


@query("biomass_score", f"{WITH} SELECT y, x, t, sensor, {BM} AS biomass FROM obs")
def biomass_score(spark, d):
    return obs(spark, d).select("y", "x", "t", "sensor", models.biomass(BIOMASS).cast("int").alias("biomass"))


@query("biomass_se", f"{WITH} SELECT y, x, t, sensor, round(CASE WHEN {_linear(BIOMASS)} IS NOT NULL THEN {SE} END, 6) AS se FROM obs")
def biomass_se(spark, d):
    return models.with_error(obs(spark, d), BOOTSTRAP).select("y", "x", "t", "sensor", F.round("se", 6).alias("se"))


def _prob(p: str) -> str:
    from furrow.plans.observations import CDF_SQL, scalars

    return f"b AS (SELECT *, (1500e0 - {BM}) / {SE} AS z FROM obs WHERE {_linear(BIOMASS)} IS NOT NULL), k AS (SELECT *, 1e0 / (1e0 + {scalars.ERF_P}e0 * abs(z) / sqrt(2e0)) AS k FROM b) SELECT y, x, t, sensor, round({CDF_SQL}, 6) AS {p} FROM k"


@query("biomass_prob", f"{WITH}, {_prob('p')}")
def biomass_prob(spark, d):
    o = models.with_error(obs(spark, d).where(models.linear(BIOMASS).isNotNull()), BOOTSTRAP)
    o = o.withColumn("bm", models.biomass(BIOMASS).cast("double"))
    return o.select("y", "x", "t", "sensor", F.round(models.below(F.col("bm"), F.col("se"), 1500), 6).alias("p"))


#: Invented: four models over the features of the cover model.
COVER_DEMO = {
    out: {"name": f"cover_{out}", "intercept": 0.2 + 0.1 * k, "coef": {f: (0.4 if f == "NDVI" else 0.001 if f.startswith("BAI") else 1e-5 if f.isupper() and "_" not in f and f in N else 0.01) * (-1) ** (i + k) for i, f in enumerate(models.COVER_FEATURES)}}
    for k, out in enumerate(models.COVER)
}


@query("cover_score", f"{WITH} SELECT y, x, t, sensor, " + ", ".join(f"round(CASE WHEN {_linear(m)} IS NOT NULL THEN least(greatest({_linear(m)}, 0), 1) END, 6) AS {out}" for out, m in COVER_DEMO.items()) + " FROM obs")
def cover_score(spark, d):
    return models.with_cover(obs(spark, d), COVER_DEMO).select("y", "x", "t", "sensor", *[F.round(n, 6).alias(n) for n in models.COVER])


@query("bootstrap_sample", "SELECT name, intercept FROM (SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(p_retailprice AS DOUBLE) AS intercept FROM part) ORDER BY md5('7:' || name), name LIMIT 100")
def bootstrap_sample(spark, d):
    """A hundred models drawn with a seed; the parts stand for models."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_retailprice").cast("double").alias("intercept"))
    return models.sampled(p, 100, 7)


# Haze lines: a date here is a year, so that bins fill.
LOW, HIGH, BINS = 200.0, 2000.0, 50
_HAZE = f"""{WITH}, h AS (SELECT CAST(year(t) AS INTEGER) AS t, {N['BLUE']} AS b, {N['RED']} AS r FROM obs WHERE {N['BLUE']} IS NOT NULL AND {N['RED']} IS NOT NULL),
i AS (SELECT *, CAST(floor((b - {LOW}) / (({HIGH} - {LOW}) / {BINS})) AS INTEGER) AS bin FROM h),
j AS (SELECT *, count(*) OVER w AS n, avg(r) OVER w AS m, stddev_pop(r) OVER w AS s FROM i WHERE bin >= 0 AND bin < {BINS} WINDOW w AS (PARTITION BY t, bin)),
k AS (SELECT *, count(*) OVER (PARTITION BY t, bin) AS good, row_number() OVER (PARTITION BY t, bin ORDER BY r DESC, b) AS rank FROM j WHERE n >= 20 AND round(r, 6) <= round(m + 3 * s, 6)),
p AS (SELECT t, bin, avg(b) AS mx, avg(r) AS my FROM k WHERE rank <= least(20, ceil(good * 0.01e0)) GROUP BY t, bin)"""
_LINE = f"""{_HAZE}, c AS (SELECT a.t, (b.my - a.my) / (b.mx - a.mx) AS s, a.my - (b.my - a.my) / (b.mx - a.mx) * a.mx AS i FROM p a JOIN p b ON a.t = b.t AND a.mx < b.mx),
o AS (SELECT c.t, c.s, c.i, round(sum(abs(p.my - c.i - c.s * p.mx)), 6) AS off FROM c JOIN p ON p.t = c.t GROUP BY c.t, c.s, c.i),
best AS (SELECT t, round(s, 9) AS slope, round(i, 6) AS intercept FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY off, round(s, 9), round(i, 6)) AS rn FROM o) WHERE rn = 1),
flat AS (SELECT t, count(*) AS n, avg(mx) AS ax, avg(my) AS ay FROM p GROUP BY t),
l AS (SELECT flat.t, CASE WHEN n >= 25 AND slope > 1.5 THEN slope ELSE 1.5 END AS slope, CASE WHEN n >= 25 AND slope > 1.5 THEN intercept ELSE round(ay - ax * 1.5e0, 6) END AS intercept,
      CASE WHEN n >= 25 AND slope > 1.5 THEN 1 ELSE 0 END AS fitted FROM flat LEFT JOIN best ON best.t = flat.t)"""


def _years(spark, d):
    o = obs(spark, d).select(F.year("t").alias("t"), band("BLUE").alias("b"), band("RED").alias("r")).where("b is not null and r is not null")
    return o.withColumn("low", F.lit(LOW))


@query("hot_bins_topk", f"{_HAZE} SELECT t, bin, round(mx, 6) AS mx, round(my, 6) AS my FROM p")
def hot_bins(spark, d):
    p = stats.brightest(_years(spark, d), "t", "b", "r", F.lit(LOW), F.lit(HIGH), BINS)
    return p.select("t", "bin", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"))


@query("hot_lad_line", f"{_LINE} SELECT t, round(slope, 6) AS slope, round(intercept, 4) AS intercept, fitted FROM l")
def hot_line(spark, d):
    got = haze.lines(_years(spark, d), "b", "r", "low", HIGH, BINS)
    return got.select("t", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "fitted")


@query("hot_distance", f"{_LINE} SELECT h.t, h.b, h.r, round(abs(h.b * l.slope - h.r + l.intercept) / sqrt(l.slope * l.slope + 1e0), 4) AS hot FROM h LEFT JOIN l ON l.t = h.t")
def hot_distance(spark, d):
    y = _years(spark, d)
    line = haze.lines(y, "b", "r", "low", HIGH, BINS).drop("fitted")
    return haze.distances(y, line, "b", "r").select("t", "b", "r", F.round("hot", 4).alias("hot"))


@query(
    "lad_line_by_pixel",
    f"""WITH ts AS ({DAILY}), p AS (SELECT pix, CAST(t_idx AS DOUBLE) AS x, v FROM ts WHERE v IS NOT NULL),
c AS (SELECT a.pix, round((b.v - a.v) / (b.x - a.x), 9) AS slope, round(a.v - (b.v - a.v) / (b.x - a.x) * a.x, 6) AS intercept, (b.v - a.v) / (b.x - a.x) AS s, a.v - (b.v - a.v) / (b.x - a.x) * a.x AS i FROM p a JOIN p b ON a.pix = b.pix AND a.x < b.x),
o AS (SELECT c.pix, slope, intercept, round(sum(abs(p.v - c.i - c.s * p.x)), 6) AS off FROM c JOIN p ON p.pix = c.pix GROUP BY c.pix, slope, intercept, s, i)
SELECT pix, round(slope, 6) AS slope, round(intercept, 5) AS intercept FROM (SELECT *, row_number() OVER (PARTITION BY pix ORDER BY off, slope, intercept) AS k FROM o) WHERE k = 1""",
)
def lad_line(spark, d):
    p = daily(spark, d).where("v is not null").withColumn("xx", F.col("t_idx").cast("double"))
    return stats.median_line(p, "pix", "xx", "v").select("pix", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


_SAMPLE = f"""{WITH}, r AS (SELECT {N['BLUE']} AS v, row_number() OVER (ORDER BY y, x, t, sensor, BLUE, RED, NIR1, SWIR1) - 1 AS rn, count(*) OVER () AS n FROM obs WHERE {N['BLUE']} IS NOT NULL)"""
_STEP = "greatest(n // 5000, 1)"
_ORDER = ["y", "x", "t", "sensor", "BLUE", "RED", "NIR1", "SWIR1"]


@query("systematic_sample", f"{_SAMPLE} SELECT v, count(*) AS n FROM (SELECT v FROM r WHERE rn % {_STEP} = 0 AND rn // {_STEP} < 5000) GROUP BY v")
def systematic_sample(spark, d):
    o = obs(spark, d).withColumn("v", band("BLUE")).where("v is not null")
    return stats.every_nth(o, _ORDER).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query(
    "kmeans_1d",
    f"""{_SAMPLE}, s AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT v FROM r WHERE rn % {_STEP} = 0 AND rn // {_STEP} < 5000)),
p AS (SELECT i, sum(v) OVER (ORDER BY i) AS s, sum(v * v) OVER (ORDER BY i) AS q, count(*) OVER () AS n, sum(v) OVER () AS st, sum(v * v) OVER () AS qt FROM s),
c AS (SELECT a.s / a.i AS c0, (b.s - a.s) / (b.i - a.i) AS c1, (b.st - b.s) / (b.n - b.i) AS c2,
        a.q - a.s * a.s / a.i + (b.q - a.q) - (b.s - a.s) * (b.s - a.s) / (b.i - a.i) + (b.qt - b.q) - (b.st - b.s) * (b.st - b.s) / (b.n - b.i) AS cost
      FROM p a JOIN p b ON a.i < b.i AND b.i < b.n)
SELECT unnest([0, 1, 2]) AS k, round(unnest([c0, c1, c2]), 4) AS centre FROM (SELECT * FROM c ORDER BY cost LIMIT 1)""",
)
def kmeans(spark, d):
    o = obs(spark, d).withColumn("v", band("BLUE")).where("v is not null")
    found = stats.kmeans3(stats.every_nth(o, _ORDER), "v")
    return spark.createDataFrame([(k, round(c, 4)) for k, c in enumerate(found or [])], "k int, centre double")


_MASKED = f"{WITH}, m AS (SELECT CAST(year(t) * 12 + month(t) AS INTEGER) AS t, y, x, CASE WHEN {QA_SQL['cloud']} = 1 THEN 2 ELSE 1 END AS mask, CASE WHEN {QA_SQL['water']} = 1 THEN 1 ELSE 0 END AS water, {N['NIR1']} AS nir FROM obs)"
_BEST = "best AS (SELECT t FROM m GROUP BY t ORDER BY count_if(mask = 1) DESC, t LIMIT 1)"


def _masked(spark, d):
    bit = lambda b: F.shiftright("FMASK", b).bitwiseAND(1)
    return obs(spark, d).select((F.year("t") * 12 + F.month("t")).alias("t"), "y", "x", (1 + bit(1)).alias("mask"), bit(5).alias("water"), band("NIR1").alias("nir"))


@query("clearest_date", f"{_MASKED} SELECT t, count_if(mask = 1) AS n FROM m GROUP BY t ORDER BY n DESC, t LIMIT 1")
def clearest_date(spark, d):
    return gains.clearest(_masked(spark, d))


@query(
    "gain_bias",
    f"""{_MASKED}, {_BEST}, c AS (SELECT * FROM m WHERE mask = 1 AND water = 0), top AS (SELECT y, x, nir AS top FROM c WHERE t = (SELECT t FROM best)),
s AS (SELECT c.t, count(*) AS n, stddev_pop(top) AS sd, avg(top) AS mean FROM c JOIN top USING (y, x) GROUP BY c.t), w AS (SELECT t, stddev_pop(nir) AS asd, avg(nir) AS amean FROM m GROUP BY t)
SELECT w.t, round(CASE WHEN n > 100 THEN sd / nullif(asd, 0) ELSE 1 END, 6) AS gain, round(CASE WHEN n > 100 THEN mean / nullif(amean, 0) ELSE 0 END, 6) AS bias FROM w LEFT JOIN s ON s.t = w.t""",
)
def gain_bias(spark, d):
    m = _masked(spark, d)
    return gains.gains(m, "nir", gains.clearest(m)).select("t", F.round("gain", 6).alias("gain"), F.round("bias", 6).alias("bias"))
