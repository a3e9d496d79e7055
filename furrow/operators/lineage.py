"""Cutting the lineage of staged plans, and joining what there is one row of for each date."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table with a row a date that are broadcast: more than a century of days.
BROADCAST_DATES = 40_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder of ``spark.checkpoint.dir``; a local session without one (tests) gets a
    temporary one, a cluster an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="furrow-"))
    return df.checkpoint()


def per_date(df: DataFrame, dates: DataFrame, how: str = "left") -> DataFrame:
    """``df`` joined on t with a table that has one row a date. It is computed once, and broadcast if it has at most
    ``BROADCAST_DATES`` rows, so that no date's pixels go to one task; beyond that Spark chooses."""
    dates = cut(dates)
    few = dates.limit(BROADCAST_DATES + 1).count() <= BROADCAST_DATES
    return df.join(F.broadcast(dates) if few else dates, "t", how)
