"""Start of season and growth features of one year of daily NDVI per pixel, and crude protein from them.

Everything is a window over one partitioning by pixel. A series qualifies if fewer than half of its days are missing and days 10 to 74 hold
a value; others keep their rows with NULL features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.models import linear
from furrow.operators.series import trailing_mean

FEATURES = ("NDVI", "NDVI_d30", "iNDVI", "t_SOS", "iNDVI_dry")


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def start_of_season(df: DataFrame, value: str = "v", key: str = "pix") -> DataFrame:
    """Adds thresh1, date1, dndvi, thresh2, sos and base to (key, t_idx, value).

    thresh1: 40th percentile of days 91 to 200; date1: first day after 30 above it; dndvi: mean change of the 25 days
    before; thresh2: 35th percentile of positive dndvi before date1; sos: last day before date1 with dndvi below
    thresh2; base: mean of days 10 to 74. Compared values are rounded to 9 places."""
    p = Window.partitionBy(key)
    w = p.orderBy("t_idx")
    t, v = F.col("t_idx"), F.col(value)
    df = df.withColumn("_ok", (F.count(F.when(v.isNull(), 1)).over(p) < 0.5 * F.count(F.lit(1)).over(p)) & (F.count(F.when(t.between(10, 74), v)).over(p) > 0))
    df = df.withColumns({"d1": F.when(t > 0, v - F.lag(v).over(w)).when(v.isNotNull(), F.lit(0.0)), "thresh1": F.percentile(F.when(t.between(91, 200), v), 0.40).over(p), "base": F.avg(F.when(t.between(10, 74), v)).over(p)})
    df = df.withColumns({"date1": F.min(F.when((t > 30) & (_r(v) > _r("thresh1")), t)).over(p), "dndvi": F.when(t >= 25, F.sum(F.coalesce("d1", F.lit(0.0))).over(w.rowsBetween(-24, 0)) / 25)})
    early = t < F.col("date1")
    df = df.withColumn("thresh2", F.percentile(F.when(early & (_r("dndvi") > 0), F.col("dndvi")), 0.35).over(p))
    df = df.withColumn("sos", F.max(F.when(early & (_r("dndvi") < _r("thresh2")), t)).over(p))
    return df.withColumn("sos", F.when(F.col("_ok"), F.col("sos"))).drop("_ok")


def features(df: DataFrame, value: str = "v", key: str = "pix", variant: str = "current") -> DataFrame:
    """(key, t_idx, NDVI, NDVI_d30, iNDVI, t_SOS, iNDVI_dry, NDVI_rate, iNDVI_dry_pct, SOS_doy).

    variant 'legacy' sums the 30 changes before a day (none before day 30), divides the drying by the highest value
    before the day and sums drying up to the day before."""
    if variant not in ("current", "legacy"):
        raise ValueError("the variant is current or legacy")
    old = variant == "legacy"
    w = Window.partitionBy(key).orderBy("t_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    df = start_of_season(df, value, key)
    t, v, sos = F.col("t_idx"), F.col(value), F.col("sos")
    some = F.when(sos.isNotNull(), F.lit(0.0))
    if old:
        d30 = F.when(t >= 30, F.coalesce(F.sum("d1").over(w.rowsBetween(-30, -1)), F.lit(0.0))).otherwise(F.lit(0.0))
    else:
        d30 = F.coalesce(F.sum("d1").over(w.rowsBetween(-29, 0)), F.lit(0.0))
    total = F.coalesce(F.sum(F.when(t >= sos, v - F.col("base"))).over(upto), F.lit(0.0))
    df = df.withColumns({"NDVI_d30": F.when(F.col("d1").isNotNull() & sos.isNotNull(), d30), "iNDVI": some + total, "_top": F.max(v).over(ahead if old else upto)})
    falling = (t >= sos) & (F.col("d1") < 0) & (F.col("_top").isNotNull() if old else F.col("_top") > 0)
    df = df.withColumn("_dry", F.when(falling, F.try_divide(-F.col("d1"), F.col("_top")) * F.col("iNDVI")).otherwise(F.lit(0.0)))
    dry = F.coalesce(F.sum("_dry").over(ahead if old else upto), F.lit(0.0))
    df = df.withColumn("iNDVI_dry", some + F.when(t >= sos, dry).otherwise(F.lit(0.0)))
    pct = F.when(_r("iNDVI") != 0, F.try_divide(F.col("iNDVI_dry"), F.col("iNDVI"))).otherwise(F.lit(0.0))
    df = df.withColumns({"NDVI": v, "t_SOS": t - sos, "SOS_doy": sos, "NDVI_rate": some + F.when(t >= sos, F.col("iNDVI") / (t - sos + 1)).otherwise(F.lit(0.0)), "iNDVI_dry_pct": some + pct})
    return df.select(key, "t_idx", *FEATURES, "NDVI_rate", "iNDVI_dry_pct", "SOS_doy")


def protein(df: DataFrame, model: dict, value: str = "v", key: str = "pix", variant: str = "current") -> DataFrame:
    """(key, t_idx, cp): the model's prediction as the mean of 7 days, NULL before the season and for the first 6 days.
    A series with any missing feature has none."""
    f = features(df, value, key, variant)
    whole = F.lit(True)
    for n in FEATURES:
        whole = whole & F.col(n).isNotNull()
    f = f.withColumn("_all", F.bool_and(whole).over(Window.partitionBy(key)))
    f = f.withColumn("_p", F.when(F.col("_all"), linear(model, {n: F.col(n).cast("double") for n in FEATURES})))
    return f.withColumn("cp", F.when(F.col("t_SOS") >= 0, trailing_mean("_p", 7, key))).select(key, "t_idx", "cp")
