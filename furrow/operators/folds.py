"""Sequential masks of pixel series: what is flagged at one observation changes what the next is compared with.

The functions on arrays are plain Python over one series' observations; a series is one array in a row, so whole
partitions stream through mapInArrow, and no series is more than its days.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Series = list[float | None]


def cloud_flags(blue: Series, rise: float = 0.03, days: float = 30.0, top: float = 10000.0) -> list[int]:
    """1 where blue rises by more than ``rise`` * (1 + gap / ``days``) over the last observation not
    flagged; missing days and the first observation are 0."""
    out, at = [0] * len(blue), None
    for i, v in enumerate(blue):
        if v is None:
            continue
        if at is not None and (v - blue[at]) / top > rise * (1 + (i - at) / days):
            out[i] = 1
        else:
            at = i
    return out


def shadow_flags(swir2: Series, days: int = 45, depth: float = 500.0, ratio: float = 2.0) -> list[int]:
    """1 where the short-wave infrared lies more than ``depth`` below the line between the last observation not
    flagged and the next one, and by more than ``ratio`` times their difference; the last observation is
    held against the line through the two before it. The first is 0, and so is what a zero difference leaves open."""
    clear = [i for i, v in enumerate(swir2) if v is not None]
    out, kept = [0] * len(swir2), clear[:1]
    for n in range(1, len(clear)):
        i = clear[n]
        v, a = swir2[i], kept[-1]
        if n + 1 < len(clear):
            b = clear[n + 1]
            base, span = swir2[b] - swir2[a], b - a
            line = swir2[a] + base * (i - a) / span
        elif len(kept) > 1:
            b = kept[-2]
            base, span = swir2[a] - swir2[b], i - b
            line = swir2[a] + base * (i - a) / (a - b)
        else:
            kept.append(i)
            continue
        below = line - v
        if base != 0 and span < days and below > depth and abs(below / base) > ratio:
            out[i] = 1
        else:
            kept.append(i)
    return out


def despiked(v: Series, depth: float, days: int, sweeps: int = 2) -> Series:
    """Like the windowed despiking, but a dropped observation is gone for the next within the same sweep."""
    v = list(v)
    for _ in range(sweeps):
        clear = [i for i, x in enumerate(v) if x is not None]
        kept = clear[:1]
        for n in range(1, len(clear) - 1):
            i, a, b = clear[n], kept[-1], clear[n + 1]
            base = v[b] - v[a]
            off = v[a] + base * (i - a) / (b - a) - v[i]
            if base != 0 and b - a < days and abs(off) > depth and abs(off / base) > 2:
                v[i] = None
            else:
                kept.append(i)
    return v


def outlier_mask(blue: Series, swir2: Series) -> list[int]:
    """Shadow flags, then cloud flags of what they leave."""
    shadow = shadow_flags(swir2)
    cloud = cloud_flags([None if s else b for b, s in zip(blue, shadow, strict=True)])
    return [max(p) for p in zip(shadow, cloud, strict=True)]


def as_arrays(df: DataFrame, values: list[str], key: str = "pix", t: str = "t_idx") -> DataFrame:
    """(key, one array a value): the series in order of ``t``, one row a day. A series is bounded by its days."""
    packed = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(t, *values))).alias("s"))
    return packed.select(key, F.col(f"s.{t}").alias(t), *[F.col(f"s.{v}").alias(v) for v in values])


def over_arrays(df: DataFrame, values: list[str], f: Callable[..., list], kind: str = "int", key: str = "pix", t: str = "t_idx", out: str = "flag") -> DataFrame:
    """(key, t, out): ``f`` applied to the named arrays of each series, and its result a row a day."""
    arrays = as_arrays(df, values, key, t)
    arrow = {"int": pa.int32(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [f(*(c.as_py() for c in row)) for row in zip(*(b.column(v) for v in values), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(t), pa.array(got, pa.list_(arrow))], names=[key, t, out])

    types = dict(arrays.dtypes)
    made = arrays.mapInArrow(run, f"{key} {types[key]}, {t} {types[t]}, {out} array<{kind}>")
    return made.select(key, F.inline(F.arrays_zip(t, out)))


def numbers(v: Series) -> np.ndarray:
    return np.array([np.nan if x is None else x for x in v], float)
