"""Savitzky-Golay smoothing of pixel series: uniform, over irregular observations, and the staged and adaptive forms.

Smoothing is linear, so the uniform filter is one constant banded matrix and a batch of series is one product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.folds import as_arrays, despiked
from furrow.operators.series import over

#: Days between observations above which series are smoothed alike: (first window at most, second window), twice smoothed but the last.
CLASSES = ((10, 7, 31), (7, 5, 41), (5, 5, 51))
DENSE_WINDOW, LIMIT = 51, 91


@lru_cache(maxsize=64)
def weights(window: int, degree: int) -> np.ndarray:
    """Row i fits a polynomial to ``window`` equally spaced values and evaluates it at value i."""
    x = np.arange(window) - window // 2
    v = np.vander(x, degree + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def uniform(v: np.ndarray, window: int, degree: int) -> np.ndarray:
    """Filters the rows of ``v``; the first and last half windows come from the end windows' polynomials."""
    h, n = window // 2, v.shape[1]
    s = weights(window, degree)
    views = np.lib.stride_tricks.sliding_window_view(v, window, axis=1)
    out = np.empty_like(v)
    out[:, h : n - h] = views @ s[h]
    out[:, :h] = v[:, :window] @ s[:h].T
    out[:, n - h :] = v[:, n - window :] @ s[h + 1 :].T
    return out


def taps(value: str, window: int, degree: int, key: str = "pix") -> Column:
    """The uniform filter's interior as a column: NULL where the window isn't whole."""
    h, row = window // 2, weights(window, degree)[window // 2]
    w = over(key)
    shifted = lambda k: F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else F.col(value)
    out = F.lit(0.0)
    for k in range(-h, h + 1):
        out = out + shifted(k) * F.lit(float(row[k + h]))
    return out


def check_window(n: int, window: int, degree: int) -> None:
    if not isinstance(window, int) or not isinstance(degree, int):
        raise TypeError("window and degree are whole numbers")
    if window % 2 == 0:
        raise ValueError("the window is odd")
    if degree >= window:
        raise ValueError("the degree is below the window")
    if n < window:
        raise ValueError("there are fewer values than the window holds")


def irregular(x: np.ndarray, y: np.ndarray, window: int, degree: int) -> np.ndarray:
    """Fits a polynomial to the ``window`` observations around each, however they are spaced, and takes its
    value there; the ends are values of the first and last window's polynomials."""
    if len(x) != len(y):
        raise ValueError("x and y have different lengths")
    check_window(len(x), window, degree)
    h = window // 2
    views = np.lib.stride_tricks.sliding_window_view(np.arange(len(x)), window)
    centre = x[h : len(x) - h]
    d = x[views] - centre[:, None]
    scale = np.abs(d).max(1)
    scale[scale == 0] = 1
    a = (d / scale[:, None])[:, :, None] ** np.arange(degree + 1)
    normal = a.transpose(0, 2, 1)
    c = np.linalg.solve(normal @ a, normal @ y[views][:, :, None])[:, :, 0]
    out = np.empty(len(x))
    out[h : len(x) - h] = c[:, 0]
    powers = np.arange(degree + 1)
    out[:h] = (((x[:h] - centre[0]) / scale[0])[:, None] ** powers) @ c[0]
    out[len(x) - h :] = (((x[len(x) - h :] - centre[-1]) / scale[-1])[:, None] ** powers) @ c[-1]
    return out


def interpolated(v: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Gaps as straight lines, the first ``limit`` of each; the ends take the nearest value."""
    ok = np.flatnonzero(~np.isnan(v))
    if not len(ok) or len(ok) == len(v):
        return v
    at = np.arange(len(v))
    out = np.interp(at, ok, v[ok])
    if limit is not None:
        last = np.maximum.accumulate(np.where(np.isnan(v), -1, at))
        out[(last >= 0) & (at < ok[-1]) & (at - last > limit)] = np.nan
    return out


def rolling(v: np.ndarray, width: int = 21) -> np.ndarray:
    out = np.full(len(v), np.nan)
    if len(v) >= width:
        h = width // 2
        out[h : len(v) - h] = np.lib.stride_tricks.sliding_window_view(v, width).mean(1)
    return out


def twice(v: np.ndarray, double: bool = True, least: int = 11, most: int = 21, second: int = 59, degree1: int = 3, degree2: int = 3, limit: int | None = 61) -> np.ndarray:
    """Smooths the observations, if there are more than ``least``, fills the gaps, and smooths the days; where the
    second window doesn't fit, by a rolling mean of 21 days. Days whose window holds a gap are missing."""
    ok = np.flatnonzero(~np.isnan(v))
    if not len(ok):
        return v
    v = v.copy()
    first = min(max(7, len(ok) // 4 // 2 * 2 + 1), most)
    if double and len(ok) > least and len(ok) >= first:
        v[ok] = irregular(ok.astype(float), v[ok], first, degree1 if degree1 < first else first - 1)
    v = interpolated(v, limit)
    return uniform(v[None], second, degree2)[0] if second < len(v) else rolling(v)


def adaptive(v: np.ndarray, despike: bool = True, depth: float | None = None, days: int = 45) -> np.ndarray:
    """Despikes, unless observations are over 15 days apart, by a tenth of the range if no depth is given; then
    smooths as the days for each observation ask for."""
    ok = ~np.isnan(v)
    if not ok.any():
        return v
    gap = len(v) / ok.sum()
    if despike and gap <= 15:
        depth = depth if depth is not None else 0.1 * float(np.nanmax(v) - np.nanmin(v))
        got = despiked([None if np.isnan(x) else float(x) for x in v], depth, days)
        v = np.array([np.nan if x is None else x for x in got])
    for above, most, second in CLASSES:
        if gap > above:
            return twice(v, True, most=most, second=second, limit=LIMIT)
    return twice(v, False, second=DENSE_WINDOW, limit=LIMIT)


def observed(v: np.ndarray, window: int, degree: int) -> np.ndarray:
    """Smooths the observations of a series where they are; series with fewer than the window stay as they are."""
    ok = np.flatnonzero(~np.isnan(v))
    if len(ok) < window:
        return v
    out = v.copy()
    out[ok] = irregular(ok.astype(float), v[ok], window, degree)
    return out


def smoothed(df: DataFrame, how: str = "twice", value: str = "v", key: str = "pix", **options: object) -> DataFrame:
    """(key, t_idx, smooth) of every day; how: uniform, observed, twice or adaptive, with that function's options."""
    kinds = {"twice": twice, "adaptive": adaptive, "observed": observed, "uniform": lambda v, window, degree: uniform(v[None], window, degree)[0] if window <= len(v) else np.full(len(v), np.nan)}
    if how not in kinds:
        raise ValueError(f"how is one of {', '.join(kinds)}")
    if how in ("uniform", "observed"):
        check_window(int(options["window"]), options["window"], options["degree"])
    f = kinds[how]
    arrays = as_arrays(df, [value], key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.column(value):
                v = row.values.to_numpy(zero_copy_only=False).astype(float)
                got = f(v, **options)
                out.append([None if np.isnan(x) else x for x in got.tolist()])
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("t_idx"), pa.array(out, pa.list_(pa.float64()))], names=[key, "t_idx", "smooth"])

    types = dict(arrays.dtypes)
    made = arrays.mapInArrow(run, f"{key} {types[key]}, t_idx {types['t_idx']}, smooth array<double>")
    return made.select(key, F.inline(F.arrays_zip("t_idx", "smooth")))
