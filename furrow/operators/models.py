"""Models as data: linear models in JSON, scored as columns.

A model is {name, intercept, coef: {feature: weight}} and, if its target was transformed, transform: sqrt. Models are
read from JSON, never unpickled.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.indices import feature, with_features
from furrow.functions.scalars import clipped, finite, normal_cdf, small_int, square

SPREAD = 144.61
# The features of the cover model.
COVER_FEATURES = ("NDVI", "DFI", "NDTI", "SATVI", "NDII7", "BAI_126", "BAI_136", "BAI_146", "BAI_236", "BAI_246", "BAI_346", "BLUE", "GREEN", "RED", "NIR1", "SWIR1", "SWIR2")
COVER = ("BARE", "SD", "GREEN", "LITT")


#: Models that a set may have: each is an expression of a plan.
MOST = 10_000


def load(spark: SparkSession, path: str) -> list[dict]:
    """The models of a JSON-lines file or folder, by name: ``MOST`` of them at most, read by the driver."""
    rows = spark.read.text(path).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"{path} holds more than {MOST} models")
    return sorted((json.loads(r.value) for r in rows if r.value.strip()), key=lambda m: m["name"])


def save(spark: SparkSession, models: Sequence[dict], path: str) -> None:
    spark.createDataFrame([(json.dumps(m),) for m in models], "value string").coalesce(1).write.mode("overwrite").text(path)


def get(models: Sequence[dict], name: str) -> dict:
    for m in models:
        if m["name"] == name:
            return m
    raise KeyError(f"no model is called {name}")


def linear(model: Mapping, given: Mapping[str, Column] | None = None) -> Column:
    """The prediction; NULL where any feature is missing or beyond a 4-byte float."""
    out = F.lit(float(model["intercept"]))
    for name, weight in model["coef"].items():
        x = given[name] if given is not None else feature(name)
        out = out + finite(x) * float(weight)
    return square(out) if model.get("transform") == "sqrt" else out


def biomass(model: Mapping) -> Column:
    """Biomass in kg/ha as a 2-byte number, truncated; NULL where it can't be told or doesn't fit."""
    return small_int(linear(model))


def sampled(models: DataFrame, n: int, seed: int = 0, name: str = "name") -> DataFrame:
    """``n`` rows of a table of models without replacement, the same for a seed: those whose hash of seed and name is lowest."""
    return models.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string"))), name).limit(n)


def biomass_error(models: Sequence[dict], spread: float = SPREAD, given: Mapping[str, Column] | None = None) -> Column:
    """Standard error: the sample standard deviation of the models' predictions, plus ``spread``.

    Give features as columns where there are many models: each is then computed once a row. One pass over the predictions
    keeps count, mean and squares, as Welford does."""
    p = F.array(*[linear(m, given) for m in models])
    if len(models) < 2:
        return F.lit(None).cast("double")

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["sq"] + (x - s["mean"]) * (x - mean)).alias("sq"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sq"))
    sd = F.aggregate(p, start, add, lambda s: F.sqrt(s["sq"] / (s["n"] - 1)))
    return finite(sd + spread)


def with_error(df: DataFrame, models: Sequence[dict], out: str = "se", spread: float = SPREAD) -> DataFrame:
    """``df`` with the standard error of many models: features, predictions, their mean and the error are columns of
    their own, so each is computed once a row and all of it is compiled."""
    names = sorted({n for m in models for n in m["coef"]})
    kept, n = df.columns, len(models)
    df = with_features(df, names, "_f_")
    given = {f: F.col(f"_f_{f}") for f in names}
    df = df.withColumns({f"_p_{i}": linear(m, given) for i, m in enumerate(models)})
    p = [F.col(f"_p_{i}") for i in range(n)]
    df = df.withColumn("_mean", sum(p[1:], p[0]) / n)
    off = [(x - F.col("_mean")) * (x - F.col("_mean")) for x in p]
    error = finite(F.sqrt(sum(off[1:], off[0]) / (n - 1)) + spread) if n > 1 else F.lit(None).cast("double")
    return df.withColumn(out, error).select(*kept, out)


def below(biomass_column: Column, error: Column, threshold: float) -> Column:
    """Probability that the biomass is at most ``threshold``."""
    return normal_cdf(F.try_divide(F.lit(float(threshold)) - biomass_column, error))


def with_cover(df: DataFrame, models: Mapping[str, Mapping]) -> DataFrame:
    """``df`` with the shares of cover(); features are columns first, so each is computed once for the four models."""
    kept = [c for c in df.columns if c not in COVER]
    df = with_features(df, COVER_FEATURES, "_f_")
    return df.select(*kept, *[c.alias(n) for n, c in cover(models, {f: F.col(f"_f_{f}") for f in COVER_FEATURES}).items()])


def cover(models: Mapping[str, Mapping], given: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """Shares of bare ground, standing dead, green and litter, each within 0 and 1; they need not add up to 1.

    Features are bound by name; each model has exactly those of the cover model."""
    out = {}
    for name in COVER:
        if set(models[name]["coef"]) != set(COVER_FEATURES):
            raise ValueError(f"the model of {name} has other features than the cover model")
        out[name] = clipped(linear(models[name], given))
    return out
