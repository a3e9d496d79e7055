import math

import pytest
from pyspark.sql import functions as F

from furrow.functions import bands, indices, qa, scalars


def rows(spark, **cols):
    n = max(len(v) for v in cols.values())
    names = (*bands.BANDS, "FMASK")
    data = [tuple(float(cols[c][i]) if c in cols and cols[c][i] is not None else None if c in cols else 1000.0 for c in names[:-1]) + (cols.get("FMASK", [0] * n)[i],) for i in range(n)]
    return spark.createDataFrame(data, ", ".join(f"{b} double" for b in names[:-1]) + ", FMASK int")


def test_ndvi(spark):
    d = rows(spark, RED=[1000, 0, -9999, None, 0], NIR1=[3000, 3000, 3000, 3000, 0])
    assert [r[0] for r in d.select(indices.ndvi()).collect()] == [0.5, None, None, None, None]


def test_every_index_is_null_without_bands_and_finite_with_them(spark):
    d = rows(spark, RED=[None, 900], NIR1=[None, 2500], BLUE=[None, 500], GREEN=[None, 700], SWIR1=[None, 2100], SWIR2=[None, 1200])
    got = d.select(*[indices.feature(n).alias(n) for n in indices.FEATURES]).collect()
    assert all(got[0][n] is None for n in indices.FEATURES) and all(math.isfinite(got[1][n]) for n in indices.FEATURES)
    assert len(indices.INDICES) == 22 and len(indices.FEATURES) == 28
    with pytest.raises(KeyError):
        indices.feature("NOPE")


def test_quality_bits(spark):
    d = rows(spark, FMASK=[200, 64, 128, 0, 255, None])
    got = d.select(*[qa.mask(n).alias(n) for n in qa.NAMES], qa.masked().alias("all"), qa.masked(["cloud"]).alias("one")).collect()
    on = lambda r: {n for n in (*qa.NAMES, "all") if r[n] == 1}
    assert on(got[0]) == {"shadow", "high_aerosol", "any_aerosol", "all"}
    assert on(got[1]) == {"mod_aerosol", "any_aerosol"} and on(got[2]) == {"low_aerosol", "any_aerosol"} and on(got[3]) == set()
    assert on(got[4]) == {*qa.BITS, "high_aerosol", "any_aerosol", "all"}
    assert all(got[5][n] is None for n in qa.NAMES)
    with pytest.raises(ValueError):
        qa.masked([])
    with pytest.raises(KeyError):
        qa.masked(["fog"])


def test_scalars(spark):
    d = spark.createDataFrame([(-4.0,), (0.0,), (9.0,), (None,), (float("nan"),), (40000.9,), (-5.7,)], "y double")
    got = d.select(scalars.root(F.col("y")), scalars.square(F.col("y")), scalars.finite(F.col("y")), scalars.small_int(F.col("y"))).collect()
    assert [r[0] for r in got][:4] == [0.0, 0.0, 3.0, None] and [r[1] for r in got][:4] == [0.0, 0.0, 81.0, None]
    assert got[4][2] is None and [got[i][3] for i in (0, 5, 6)] == [-4, None, -5]
    z = spark.createDataFrame([(x / 4,) for x in range(-20, 21)], "z double").select(scalars.normal_cdf(F.col("z"))).collect()
    want = [0.5 * math.erfc(-x / 4 / math.sqrt(2)) for x in range(-20, 21)]
    assert max(abs(a[0] - b) for a, b in zip(z, want, strict=True)) < 2e-7 and abs(z[20][0] - 0.5) < 1e-8
    assert all(a[0] <= b[0] for a, b in zip(z, z[1:], strict=False))
