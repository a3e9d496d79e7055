import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import folds, phenology, series, smoothing


def frame(spark, *lists):
    return spark.createDataFrame([(p, i, None if v is None else float(v)) for p, vs in enumerate(lists) for i, v in enumerate(vs)], "pix int, t_idx int, v double")


def back(df, n, value="v"):
    out = {}
    for r in df.collect():
        out.setdefault(r.pix, {})[r.t_idx] = r[value]
    return [[out[p][i] for i in sorted(out[p])] for p in range(n)]


def test_fill_and_edges(spark):
    d = frame(spark, [None, 1.0, None, None, None, None, 6.0, None], [None] * 3, [2.0])
    assert back(series.filled(d, 2), 3) == [[1, 1, 2, 3, None, None, 6, 6], [None] * 3, [2.0]]
    assert back(series.filled(d, None, edges=False), 3)[0] == [None, 1, 2, 3, 4, 5, 6, None]


def test_despiking_keeps_ends_and_outliers_need_spread(spark):
    d = frame(spark, [99.0, 1, 1.1, 50, 1.2, 1, 99], [5.0, 5, 5, 80, 5, 5, 5])
    assert back(series.despiked(d, 5, 10), 2)[0] == [99.0, 1, 1.1, None, 1.2, 1, 99]
    assert back(series.without_outliers(d), 2)[1] == [5.0, 5, 5, 80, 5, 5, 5]
    r = random.Random(1)
    noisy = [r.random() for _ in range(40)]
    assert back(series.despiked(frame(spark, noisy), 0.2, 10, 12), 1) == back(series.despiked(frame(spark, noisy), 0.2, 10, 13), 1)


def test_sequential_flags():
    assert folds.cloud_flags([500.0, 900.0]) == [0, 1]
    assert folds.cloud_flags([500.0, 900.0, 880.0]) == [0, 1, 1]
    assert folds.cloud_flags([None, 500.0, None, 505.0]) == [0, 0, 0, 0] and folds.cloud_flags([]) == []
    assert folds.shadow_flags([2000.0, 1000.0, 2100.0]) == [0, 1, 0]
    assert folds.shadow_flags([2000.0, 1000.0, 2000.0]) == [0, 0, 0]
    assert folds.shadow_flags([2000.0, 2050.0, 1000.0]) == [0, 0, 1]
    assert folds.shadow_flags([2000.0, 1000.0]) == [0, 0] and folds.shadow_flags([None, 7.0, None]) == [0, 0, 0]
    assert folds.outlier_mask([500.0, 900.0, 500.0], [2000.0, 2000.0, 2100.0]) == [0, 1, 0]
    assert folds.despiked([1.0, 50.0, 1.2], 5, 10) == [1.0, None, 1.2]


def test_polynomials_pass_unchanged():
    x = np.arange(40.0)
    y = 1 + 0.2 * x - 0.03 * x**2 + 0.001 * x**3
    assert np.allclose(smoothing.uniform(y[None], 11, 3)[0], y)
    at = np.sort(np.random.default_rng(2).choice(200, 30, replace=False)).astype(float)
    assert np.allclose(smoothing.irregular(at, 2 + at - 0.01 * at**2, 7, 3), 2 + at - 0.01 * at**2)
    assert np.allclose(smoothing.weights(5, 2)[2] * 35, [-3, 12, 17, 12, -3])
    assert np.allclose(smoothing.irregular(x, np.sin(x), 7, 2), smoothing.uniform(np.sin(x)[None], 7, 2)[0])


def test_window_errors():
    x = np.arange(9.0)
    for bad, kind in (((4, 2), ValueError), ((5, 5), ValueError), ((11, 2), ValueError), ((5.0, 2), TypeError), ((5, 1.5), TypeError)):
        with pytest.raises(kind):
            smoothing.irregular(x, x, *bad)
    with pytest.raises(ValueError):
        smoothing.irregular(x, x[1:], 5, 2)


def test_smoothing_of_sparse_series():
    assert np.isnan(smoothing.adaptive(np.full(30, np.nan))).all()
    v = np.full(120, np.nan)
    v[::8] = np.sin(np.arange(15))
    assert np.isfinite(smoothing.adaptive(v)).all()
    assert len(smoothing.twice(v[:18])) == 18 and np.isfinite(smoothing.twice(v[:40])[10:20]).all()
    assert smoothing.interpolated(np.array([np.nan, 1, np.nan, np.nan, np.nan, np.nan, 6, np.nan]), 2).tolist()[:4] == [1, 1, 2, 3]


def test_smoothing_classes(spark):
    sparse = [float(i) if i % 10 == 0 else None for i in range(20)]
    assert series.density(frame(spark, sparse)).first()["class"] == "over7"
    assert series.density(frame(spark, [None, None])).first()["class"] == "none"


def test_season(spark):
    year = [0.2 + 0.4 * max(0.0, min((i - 100) / 60, 1 - (i - 200) / 120)) for i in range(365)]
    d = frame(spark, year, [None] * 365, [0.2 if i % 3 == 0 else None for i in range(365)])
    got = {r.pix: r for r in phenology.start_of_season(d).groupBy("pix").agg(F.max("sos").alias("sos"), F.max("base").alias("base")).collect()}
    assert 98 <= got[0].sos <= 115 and abs(got[0].base - 0.2) < 1e-9 and got[1].sos is None and got[2].sos is None
    with pytest.raises(ValueError):
        phenology.features(d, variant="other")
