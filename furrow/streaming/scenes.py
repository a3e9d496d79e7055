"""Observations as they arrive: clear-sky indices, duplicates within a watermark, composites of periods, and cloud flags with
state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from furrow.functions.indices import feature
from furrow.functions.qa import masked

LATE = "16 days"


def clear_indices(df: DataFrame, names: Sequence[str] = ("NDVI",)) -> DataFrame:
    """Indices of pixels that no mask covers; without state."""
    clear = df.where(masked(["all"]) == 0)
    return clear.select("y", "x", F.col("t").cast("timestamp").alias("t"), "sensor", *[feature(n).alias(n) for n in names])


def once(df: DataFrame, late: str = LATE) -> DataFrame:
    """Each pixel, date and sensor once, however often it is delivered within the watermark."""
    return df.withWatermark("t", late).dropDuplicatesWithinWatermark(["y", "x", "t", "sensor"])


def composites(df: DataFrame, value: str = "NDVI", period: str = LATE, late: str = LATE) -> DataFrame:
    """Mean and count of each pixel and period; later data than the watermark is dropped by Spark."""
    g = df.withWatermark("t", late).groupBy(F.window("t", period).alias("w"), "y", "x").agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return g.select(F.col("w.start").alias("start"), "y", "x", value, "n")


def cloud_flags(df: DataFrame, rise: float = 0.03, days: float = 30.0, top: float = 10000.0) -> DataFrame:
    """(pix, t_idx, flag) of (pix, t_idx, v): the sequential cloud mask, with the last clear observation as state. Rows of a
    pixel must arrive in order of days."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last = state.get if state.exists else (None, None)
        for part in parts:
            part = part.sort_values("t_idx")
            flags = []
            for i, v in zip(part["t_idx"], part["v"], strict=True):
                flag = 0
                if v == v and v is not None:
                    if at is not None and (v - last) / top > rise * (1 + (i - at) / days):
                        flag = 1
                    else:
                        at, last = int(i), float(v)
                flags.append(flag)
            yield pd.DataFrame({"pix": part["pix"], "t_idx": part["t_idx"], "flag": flags})
        if at is not None:
            state.update((at, last))

    return df.groupBy("pix").applyInPandasWithState(run, "pix long, t_idx int, flag int", "at int, last double", "append", GroupStateTimeout.NoTimeout)
