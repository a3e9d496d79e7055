"""Queries on pixel series: neighbours, despiking, filling, sequential masks, smoothing, phenology."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from furrow.operators import folds, phenology, series, smoothing
from furrow.plans.registry import query
from furrow.plans.views import DAILY, PROTEIN, SEASON, daily, season

WITH = f"WITH ts AS ({DAILY})"
W = "(PARTITION BY pix ORDER BY t_idx"
PRE, POST = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"{W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
KT = "CASE WHEN v IS NOT NULL THEN t_idx END"
NEIGHBOURS = f"""SELECT pix, t_idx, v, last_value(v IGNORE NULLS) OVER {PRE} AS pre, last_value({KT} IGNORE NULLS) OVER {PRE} AS pre_t,
  first_value(v IGNORE NULLS) OVER {POST} AS post, first_value({KT} IGNORE NULLS) OVER {POST} AS post_t FROM """
LINE = "(pre + (post - pre) * (CAST(t_idx - pre_t AS DOUBLE) / (post_t - pre_t)))"


@query("prev_next_valid", f"{WITH} {NEIGHBOURS} ts")
def prev_next_valid(spark, d):
    return series.neighbours(daily(spark, d))


DEPTH, DAYS = 20.0, 10
_SPIKE = f"post_t - pre_t < {DAYS} AND round(abs({LINE} - v), 9) > {DEPTH} AND round(abs(({LINE} - v) / nullif(post - pre, 0)), 9) > 2"


def _sweep(n: int) -> str:
    src, parts = "ts", []
    for k in range(n):
        parts.append(f"n{k} AS ({NEIGHBOURS} {src}), s{k} AS (SELECT pix, t_idx, CASE WHEN {_SPIKE} THEN NULL ELSE v END AS v FROM n{k})")
        src = f"s{k}"
    return ", ".join(parts)


@query("despike_jacobi", f"{WITH}, {_sweep(2)} SELECT * FROM s1")
def despike_jacobi(spark, d):
    return series.despiked(daily(spark, d), DEPTH, DAYS).select("pix", "t_idx", "v")


_Z = f"""{WITH}, m AS (SELECT *, median(v) OVER (PARTITION BY pix) AS med FROM ts),
a AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY pix) AS mad FROM m), z AS (SELECT *, 0.6745e0 * (v - med) / nullif(mad, 0) AS z FROM a)"""


@query("mad_zscore", f"{_Z} SELECT pix, t_idx, round(med, 9) AS med, round(mad, 9) AS mad, round(z, 9) AS z FROM z")
def mad_zscore(spark, d):
    return series.z_scores(daily(spark, d)).select("pix", "t_idx", *[F.round(c, 9).alias(c) for c in ("med", "mad", "z")])


@query("mask_outliers", f"{_Z} SELECT pix, t_idx, CASE WHEN round(abs(z), 9) > 2 THEN NULL ELSE v END AS v FROM z")
def mask_outliers(spark, d):
    return series.without_outliers(daily(spark, d), 2.0).select("pix", "t_idx", "v")


def _fill(limit: int | None, edges: bool) -> str:
    inner = LINE if limit is None else f"CASE WHEN t_idx - pre_t <= {limit} THEN {LINE} END"
    ends = "WHEN pre IS NULL THEN post WHEN post IS NULL THEN pre" if edges else ""
    return f"CASE WHEN v IS NOT NULL THEN v WHEN pre IS NOT NULL AND post IS NOT NULL THEN {inner} {ends} END"


def _filled(name: str, limit: int | None, edges: bool) -> None:
    @query(name, f"{WITH}, n AS ({NEIGHBOURS} ts) SELECT pix, t_idx, round({_fill(limit, edges)}, 9) AS v FROM n")
    def run(spark, d):
        return series.filled(daily(spark, d), limit, edges).select("pix", "t_idx", F.round("v", 9).alias("v"))


_filled("gap_fill_limit", 1, False)
_filled("gap_fill_and_edges", 2, True)
_filled("edge_fill", None, True)


@query("rolling_mean_centred", f"{WITH} SELECT pix, t_idx, round(CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END, 9) AS v FROM ts WINDOW w AS {W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def rolling_mean(spark, d):
    return daily(spark, d).select("pix", "t_idx", F.round(series.rolling_mean(width=7), 9).alias("v"))


@query("conv_same", f"{WITH} SELECT pix, t_idx, round(sum(v) OVER w / 7, 9) AS v FROM ts WINDOW w AS {W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def conv_same(spark, d):
    return daily(spark, d).select("pix", "t_idx", F.round(series.convolved(width=7), 9).alias("v"))


@query("trailing_mean", f"{WITH} SELECT pix, t_idx, round(CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END, 9) AS v FROM ts WINDOW w AS {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def trailing_mean(spark, d):
    return daily(spark, d).select("pix", "t_idx", F.round(series.trailing_mean(width=3), 9).alias("v"))


@query(
    "adaptive_class",
    f"""{WITH}, g AS (SELECT pix, count(*) AS n, count(v) AS valid, round(max(v) - min(v), 9) AS spread, CAST(count(*) AS DOUBLE) / nullif(count(v), 0) AS gap FROM ts GROUP BY pix)
SELECT pix, n, valid, spread, round(gap, 9) AS gap, CASE WHEN valid = 0 THEN 'none' WHEN gap > 10 THEN 'over10' WHEN gap > 7 THEN 'over7' WHEN gap > 5 THEN 'over5' ELSE 'dense' END AS class,
  coalesce(gap <= 15, false) AS despike FROM g""",
)
def adaptive_class(spark, d):
    return series.density(daily(spark, d)).select("pix", "n", "valid", F.round("spread", 9).alias("spread"), F.round("gap", 9).alias("gap"), "class", "despike")


# Sequential masks: recursive SQL over the observations of a series, one at a time.
_OBS = f"o AS (SELECT pix, t_idx, v * 5 AS v, row_number() OVER (PARTITION BY pix ORDER BY t_idx) AS k, count(*) OVER (PARTITION BY pix) AS n FROM ts WHERE v IS NOT NULL)"
_CLOUD = f"""{_OBS}, r AS (
  SELECT pix, k, t_idx, v, 0 AS flag, t_idx AS last_t, v AS last_v FROM o WHERE k = 1
  UNION ALL
  SELECT pix, k, t_idx, v, flag, CASE WHEN flag = 1 THEN last_t ELSE t_idx END, CASE WHEN flag = 1 THEN last_v ELSE v END
  FROM (SELECT o.pix, o.k, o.t_idx, o.v, r.last_t, r.last_v, CASE WHEN (o.v - r.last_v) / 10000e0 > 0.03e0 * (1 + (o.t_idx - r.last_t) / 30e0) THEN 1 ELSE 0 END AS flag
        FROM r JOIN o ON o.pix = r.pix AND o.k = r.k + 1))"""
_SHADOW = f"""{_OBS}, p AS (SELECT *, lead(v) OVER {W}) AS nv, lead(t_idx) OVER {W}) AS nt FROM o), r AS (
  SELECT pix, k, t_idx, v, 0 AS flag, t_idx AS t1, v AS v1, CAST(NULL AS INTEGER) AS t2, CAST(NULL AS DOUBLE) AS v2 FROM p WHERE k = 1
  UNION ALL
  SELECT pix, k, t_idx, v, flag, CASE WHEN flag = 1 THEN t1 ELSE t_idx END, CASE WHEN flag = 1 THEN v1 ELSE v END, CASE WHEN flag = 1 THEN t2 ELSE t1 END, CASE WHEN flag = 1 THEN v2 ELSE v1 END
  FROM (SELECT p.pix, p.k, p.t_idx, p.v, r.t1, r.v1, r.t2, r.v2,
          CASE WHEN p.nt IS NOT NULL AND p.nv <> r.v1 AND p.nt - r.t1 < 45 AND r.v1 + (p.nv - r.v1) * (p.t_idx - r.t1) / (p.nt - r.t1) - p.v > {{depth}}
                 AND abs((r.v1 + (p.nv - r.v1) * (p.t_idx - r.t1) / (p.nt - r.t1) - p.v) / (p.nv - r.v1)) > 2 THEN 1
               WHEN p.nt IS NULL AND r.t2 IS NOT NULL AND r.v1 <> r.v2 AND p.t_idx - r.t2 < 45 AND r.v1 + (r.v1 - r.v2) * (p.t_idx - r.t1) / (r.t1 - r.t2) - p.v > {{depth}}
                 AND abs((r.v1 + (r.v1 - r.v2) * (p.t_idx - r.t1) / (r.t1 - r.t2) - p.v) / (r.v1 - r.v2)) > 2 THEN 1 ELSE 0 END AS flag
        FROM r JOIN p ON p.pix = r.pix AND p.k = r.k + 1))"""
_FLAGS = "SELECT ts.pix, ts.t_idx, CAST(coalesce(r.flag, 0) AS INTEGER) AS flag FROM ts LEFT JOIN r ON r.pix = ts.pix AND r.t_idx = ts.t_idx"
RECURSIVE = WITH.replace("WITH", "WITH RECURSIVE")


def _five(spark, d):
    return daily(spark, d).withColumn("v", F.col("v") * 5)


@query("bolton_cloud", f"{RECURSIVE}, {_CLOUD} {_FLAGS}")
def bolton_cloud(spark, d):
    return folds.over_arrays(_five(spark, d), ["v"], folds.cloud_flags)


@query("bolton_shadow", f"{RECURSIVE}, {_SHADOW.format(depth=500)} {_FLAGS}")
def bolton_shadow(spark, d):
    """On the series times 5, whose range is about 500, few flags; see bolton_shadow_deep."""
    return folds.over_arrays(_five(spark, d), ["v"], folds.shadow_flags)


@query("bolton_shadow_deep", f"{RECURSIVE}, {_SHADOW.format(depth=50)} {_FLAGS}")
def bolton_shadow_deep(spark, d):
    return folds.over_arrays(_five(spark, d), ["v"], lambda v: folds.shadow_flags(v, depth=50.0))


_LATER = _CLOUD.replace(_OBS, "o AS (SELECT pix, t_idx, v, row_number() OVER (PARTITION BY pix ORDER BY t_idx) AS k FROM sr WHERE flag = 0)").replace(" r AS (", " c AS (").replace("FROM r JOIN o ON o.pix = r.pix AND o.k = r.k + 1", "FROM c JOIN o ON o.pix = c.pix AND o.k = c.k + 1").replace("r.last", "c.last")
_SR = _SHADOW.format(depth=50).replace(" r AS (", " sr AS (").replace("FROM r JOIN p ON p.pix = r.pix AND p.k = r.k + 1", "FROM sr r JOIN p ON p.pix = r.pix AND p.k = r.k + 1").replace("o AS (", "o0 AS (").replace("FROM o)", "FROM o0)")


@query(
    "bolton_mask",
    f"{RECURSIVE}, {_SR}, {_LATER} SELECT ts.pix, ts.t_idx, CAST(greatest(coalesce(sr.flag, 0), coalesce(c.flag, 0)) AS INTEGER) AS flag FROM ts LEFT JOIN sr ON sr.pix = ts.pix AND sr.t_idx = ts.t_idx LEFT JOIN c ON c.pix = ts.pix AND c.t_idx = ts.t_idx",
)
def bolton_mask(spark, d):
    def both(v):
        shadow = folds.shadow_flags(v, depth=50.0)
        cloud = folds.cloud_flags([None if s else b for b, s in zip(v, shadow, strict=True)])
        return [max(p) for p in zip(shadow, cloud, strict=True)]

    return folds.over_arrays(_five(spark, d), ["v"], both)


_SWEEP = f"""o AS (SELECT pix, t_idx, v, row_number() OVER {W}) AS k FROM ts WHERE v IS NOT NULL),
p AS (SELECT *, lead(v) OVER {W}) AS nv, lead(t_idx) OVER {W}) AS nt FROM o), r AS (
  SELECT pix, k, t_idx, v, 0 AS flag, t_idx AS t1, v AS v1 FROM p WHERE k = 1
  UNION ALL
  SELECT pix, k, t_idx, v, flag, CASE WHEN flag = 1 THEN t1 ELSE t_idx END, CASE WHEN flag = 1 THEN v1 ELSE v END
  FROM (SELECT p.pix, p.k, p.t_idx, p.v, r.t1, r.v1, CASE WHEN p.nt IS NOT NULL AND p.nv <> r.v1 AND p.nt - r.t1 < {DAYS} AND abs(r.v1 + (p.nv - r.v1) * (p.t_idx - r.t1) / (p.nt - r.t1) - p.v) > {DEPTH}
          AND abs((r.v1 + (p.nv - r.v1) * (p.t_idx - r.t1) / (p.nt - r.t1) - p.v) / (p.nv - r.v1)) > 2 THEN 1 ELSE 0 END AS flag
        FROM r JOIN p ON p.pix = r.pix AND p.k = r.k + 1))"""
#: The second sweep, over what the first has left.
_AGAIN = re.sub(r"\b([opr])\b(?= AS \(|\)|\.| JOIN|\n)", r"\g<1>2", _SWEEP).replace("FROM ts WHERE v IS NOT NULL", "FROM r WHERE flag = 0").replace("JOIN p ON", "JOIN p2 ON").replace("FROM r JOIN", "FROM r2 JOIN")


@query("despike_sequential", f"{RECURSIVE}, {_SWEEP}, {_AGAIN} SELECT ts.pix, ts.t_idx, CASE WHEN r2.flag = 0 THEN ts.v END AS v FROM ts LEFT JOIN r2 ON r2.pix = ts.pix AND r2.t_idx = ts.t_idx")
def despike_sequential(spark, d):
    """Two sweeps, as by default."""
    return folds.over_arrays(daily(spark, d), ["v"], lambda v: folds.despiked(v, DEPTH, DAYS), "double", out="v")


_TAPS = smoothing.weights(7, 2)[3]
_SG = " + ".join(f"{float(c)!r}e0 * {'v' if k == 3 else ('lag' if k < 3 else 'lead') + f'(v, {abs(k - 3)}) OVER w'}" for k, c in enumerate(_TAPS)).replace("e-", "E-").replace("e0", "")


@query("savgol_uniform_interior", f"WITH ts AS ({SEASON}) SELECT pix, t_idx, round({_SG}, 9) AS smooth FROM ts WINDOW w AS {W})")
def savgol_interior(spark, d):
    return season(spark, d).select("pix", "t_idx", F.round(smoothing.taps("v", 7, 2), 9).alias("smooth"))


_FILLED = f"WITH ts AS ({SEASON}), n AS ({NEIGHBOURS} ts), f AS (SELECT pix, t_idx, {_fill(None, True)} AS v FROM n)"


def _season_filled(spark, d):
    return series.filled(season(spark, d), None)


def _end(row: int, first: str) -> str:
    """SQL: the value that weights of the end window give, which begins at place ``first`` of the list."""
    return " + ".join(f"{float(c)!r} * l[{first} + {k}]" for k, c in enumerate(smoothing.weights(7, 2)[row])).replace("e-", "E-")


_ENDS = " ".join([f"WHEN t_idx = {i} THEN {_end(i, '1')}" for i in range(3)] + [f"WHEN t_idx = n - {3 - i} THEN {_end(4 + i, 'n - 6')}" for i in range(3)])


@query(
    "savgol_uniform",
    f"""{_FILLED}, s AS (SELECT pix, t_idx, {_SG} AS inner_v FROM f WINDOW w AS {W})), e AS (SELECT pix, list(v ORDER BY t_idx) AS l, count(*) AS n FROM f GROUP BY pix)
SELECT s.pix, s.t_idx, round(CASE WHEN n < 7 THEN NULL {_ENDS} ELSE inner_v END, 6) AS smooth FROM s JOIN e ON e.pix = s.pix""",
)
def savgol_uniform(spark, d):
    """The matrix form on filled series, ends and all."""
    return smoothing.smoothed(_season_filled(spark, d), "uniform", window=7, degree=2).select("pix", "t_idx", F.round("smooth", 6).alias("smooth"))


@query("savgol_irregular")
def savgol_irregular(spark, d):
    return smoothing.smoothed(daily(spark, d), "observed", window=7, degree=2).select("pix", "t_idx", F.round("smooth", 6).alias("smooth"))


@query("double_savgol")
def double_savgol(spark, d):
    return smoothing.smoothed(season(spark, d), "twice").select("pix", "t_idx", F.round("smooth", 6).alias("smooth"))


@query("adapt_smooth")
def adapt_smooth(spark, d):
    return smoothing.smoothed(season(spark, d), "adaptive").select("pix", "t_idx", F.round("smooth", 6).alias("smooth"))


_SOS = f"""{{src}}, d AS (SELECT *, CASE WHEN t_idx > 0 THEN v - lag(v) OVER {W}) WHEN v IS NOT NULL THEN 0e0 END AS d1 FROM f),
q AS (SELECT pix AS qp, count(*) AS n, count(v) AS valid, quantile_cont(v, 0.40) FILTER (WHERE t_idx BETWEEN 91 AND 200) AS thresh1,
      avg(v) FILTER (WHERE t_idx BETWEEN 10 AND 74) AS base, count(v) FILTER (WHERE t_idx BETWEEN 10 AND 74) AS early FROM f GROUP BY pix),
e AS (SELECT d.*, q.thresh1, q.base, q.n - q.valid < 0.5e0 * q.n AND q.early > 0 AS ok,
      CASE WHEN t_idx >= 25 THEN sum(coalesce(d1, 0)) OVER {W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) / 25 END AS dndvi FROM d JOIN q ON q.qp = d.pix),
g AS (SELECT *, min(CASE WHEN t_idx > 30 AND round(v, 9) > round(thresh1, 9) THEN t_idx END) OVER (PARTITION BY pix) AS date1 FROM e),
h AS (SELECT pix AS hp, quantile_cont(dndvi, 0.35) AS thresh2 FROM g WHERE t_idx < date1 AND round(dndvi, 9) > 0 GROUP BY pix),
i AS (SELECT g.*, h.thresh2, CASE WHEN ok THEN max(CASE WHEN t_idx < date1 AND round(dndvi, 9) < round(thresh2, 9) THEN t_idx END) OVER (PARTITION BY pix) END AS sos FROM g LEFT JOIN h ON h.hp = g.pix)"""
_RAW = f"WITH f AS ({SEASON})"


@query("pheno_sos", f"{_SOS.format(src=_RAW)} SELECT pix, max(sos) AS sos, max(date1) AS date1, round(max(thresh1), 8) AS thresh1, round(max(thresh2), 8) AS thresh2, round(max(base), 8) AS base FROM i GROUP BY pix")
def pheno_sos(spark, d):
    s = phenology.start_of_season(season(spark, d))
    return s.groupBy("pix").agg(F.max("sos").alias("sos"), F.max("date1").alias("date1"), *[F.round(F.max(c), 8).alias(c) for c in ("thresh1", "thresh2", "base")])


def _features(old: bool) -> str:
    upto = f"{W} ROWS UNBOUNDED PRECEDING)" if not old else PRE
    d30 = f"CASE WHEN t_idx >= 30 THEN coalesce(sum(d1) OVER {W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) ELSE 0 END" if old else f"sum(d1) OVER {W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
    return f"""{_SOS.format(src=_FILLED)}, j AS (SELECT *, {d30} AS d30, coalesce(sum(CASE WHEN t_idx >= sos THEN v - base END) OVER {W} ROWS UNBOUNDED PRECEDING), 0) AS total, max(v) OVER {upto} AS top FROM i),
k AS (SELECT *, CASE WHEN t_idx >= sos AND d1 < 0 AND {"top IS NOT NULL" if old else "top > 0"} THEN -d1 / nullif(top, 0) * total ELSE 0 END AS dry FROM j),
l AS (SELECT *, CASE WHEN t_idx >= sos THEN coalesce(sum(dry) OVER {upto}, 0) ELSE 0 END AS dries FROM k)"""


_OUT = """SELECT pix, t_idx, round(v, 8) + 0e0 AS NDVI, round(d30, 8) + 0e0 AS NDVI_d30, round(total, 8) + 0e0 AS iNDVI, t_idx - sos AS t_SOS, round(dries, 8) + 0e0 AS iNDVI_dry,
  round(CASE WHEN t_idx >= sos THEN total / (t_idx - sos + 1) ELSE 0 END, 8) + 0e0 AS NDVI_rate, round(CASE WHEN round(total, 9) <> 0 THEN dries / total ELSE 0 END, 8) + 0e0 AS iNDVI_dry_pct, sos AS SOS_doy FROM l"""
_COLUMNS = ("NDVI", "NDVI_d30", "iNDVI", "iNDVI_dry", "NDVI_rate", "iNDVI_dry_pct")


@query("pheno_features", f"{_features(False)} {_OUT}")
def pheno_features(spark, d):
    f = phenology.features(_season_filled(spark, d))
    return f.select("pix", "t_idx", "t_SOS", "SOS_doy", *[(F.round(c, 8) + 0.0).alias(c) for c in _COLUMNS])


@query("pheno_features_legacy", f"{_features(True)} {_OUT}")
def pheno_features_legacy(spark, d):
    f = phenology.features(_season_filled(spark, d), variant="legacy")
    return f.select("pix", "t_idx", "t_SOS", "SOS_doy", *[(F.round(c, 8) + 0.0).alias(c) for c in _COLUMNS])


_C = PROTEIN["coef"]


@query(
    "protein_score",
    f"""{_features(False)}, m AS (SELECT pix, t_idx, sos, {PROTEIN['intercept']}e0 + v * {_C['NDVI']}e0 + d30 * {_C['NDVI_d30']}e0 + total * {_C['iNDVI']}e0 + (t_idx - sos) * {_C['t_SOS']}e0 + dries * {_C['iNDVI_dry']}e0 AS p FROM l)
SELECT pix, t_idx, round(CASE WHEN t_idx >= sos AND count(p) OVER w = 7 THEN avg(p) OVER w END, 6) AS cp FROM m WINDOW w AS {W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def protein_score(spark, d):
    return phenology.protein(_season_filled(spark, d), PROTEIN).select("pix", "t_idx", F.round("cp", 6).alias("cp"))
