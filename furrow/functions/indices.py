"""Spectral indices as columns of an observation; a NULL band or a zero denominator gives NULL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.bands import BANDS, band, given, scaled

# Band centres in nanometres, and degrees per radian as the angle indices use it.
CENTRES = {"BLUE": 480, "GREEN": 560, "RED": 655, "NIR1": 865, "SWIR1": 1610, "SWIR2": 2200}
DEGREES = 57.2958

# Tasselled-cap weights of blue, green, red, near infrared and the two short-wave bands.
TASSELLED = {
    "TCBI": (0.2043, 0.4158, 0.5524, 0.5741, 0.3124, 0.2303),
    "TCGI": (-0.1603, -0.2819, -0.4934, 0.7940, -0.0002, -0.1446),
    "TCWI": (0.0315, 0.2021, 0.3102, 0.1594, -0.6806, -0.6109),
}

Index = Callable[[], Column]


def _open(v: Column) -> Column:
    return F.when((v < 1) & (v > -1), v)


def _normalised(a: str, b: str) -> Column:
    return F.try_divide(band(a) - band(b), band(a) + band(b))


def ndvi() -> Column:
    return _open(_normalised("NIR1", "RED"))


def ndti() -> Column:
    return _open(_normalised("SWIR1", "SWIR2"))


def ndii7() -> Column:
    return _normalised("NIR1", "SWIR2")


def ndwi() -> Column:
    return _normalised("NIR1", "SWIR1")


def nci() -> Column:
    return _normalised("SWIR1", "GREEN")


def ndci() -> Column:
    return _normalised("SWIR1", "RED")


def dfi() -> Column:
    return F.lit(100.0) * (F.lit(1.0) - F.try_divide(band("SWIR2"), band("SWIR1"))) * F.try_divide(band("RED"), band("NIR1"))


def savi() -> Column:
    n, r = scaled("NIR1"), scaled("RED")
    return F.try_divide(n - r, n + r + 0.5) * 1.5


def satvi() -> Column:
    s, r = scaled("SWIR1"), scaled("RED")
    return F.try_divide(s - r, s + r + 0.5) * 1.5 - scaled("SWIR2") / 2


def evi() -> Column:
    b, r, n = scaled("BLUE"), scaled("RED"), scaled("NIR1")
    return F.lit(2.5) * F.try_divide(n - r, n + r * 6 - b * 7.5 + 1)


def psri() -> Column:
    return F.try_divide(band("RED") - band("GREEN"), band("NIR1"))


def mtvi1() -> Column:
    g, r, n = scaled("GREEN"), scaled("RED"), scaled("NIR1")
    return ((n - g) * 1.2 - (r - g) * 2.5) * 1.2


def rdvi() -> Column:
    n, r = band("NIR1"), band("RED")
    return F.try_divide(n - r, F.when(n + r >= 0, F.sqrt(n + r)))


def tasselled(name: str) -> Column:
    bands = ("BLUE", "GREEN", "RED", "NIR1", "SWIR1", "SWIR2")
    out = None
    for w, b in zip(TASSELLED[name], bands, strict=True):
        term = scaled(b) * w
        out = term if out is None else out + term
    return out


def angle(p: str, q: str, s: str = "SWIR2") -> Column:
    """Angle in degrees at band ``q`` of the spectrum through ``p``, ``q`` and ``s``; only positive ones."""
    x1, x2 = (CENTRES[q] - CENTRES[p]) / 2500, (CENTRES[s] - CENTRES[q]) / 2500
    y1, y2 = (band(q) - band(p)) * 0.0001, (band(s) - band(q)) * 0.0001
    v = F.lit(180.0) - F.atan(y1 / x1) * DEGREES + F.atan(y2 / x2) * DEGREES
    return F.when(v > 0, v)


INDICES: dict[str, Index] = {
    "NDVI": ndvi, "DFI": dfi, "NDTI": ndti, "SAVI": savi, "SATVI": satvi, "NDII7": ndii7, "NDWI": ndwi, "EVI": evi,
    "TCBI": lambda: tasselled("TCBI"), "TCGI": lambda: tasselled("TCGI"), "TCWI": lambda: tasselled("TCWI"),
    "PSRI": psri, "MTVI1": mtvi1, "NCI": nci, "NDCI": ndci, "RDVI": rdvi,
    "BAI_126": lambda: angle("BLUE", "GREEN"), "BAI_136": lambda: angle("BLUE", "RED"), "BAI_146": lambda: angle("BLUE", "NIR1"),
    "BAI_236": lambda: angle("GREEN", "RED"), "BAI_246": lambda: angle("GREEN", "NIR1"), "BAI_346": lambda: angle("RED", "NIR1"),
}


def feature(name: str) -> Column:
    """A band or index by its name."""
    if name in INDICES:
        return INDICES[name]()
    if name in CENTRES:
        return band(name)
    raise KeyError(f"no feature is called {name}")


FEATURES = (*CENTRES, *INDICES)


def with_features(df: DataFrame, names: Sequence[str], prefix: str = "") -> DataFrame:
    """Adds bands and indices as columns ``prefix`` + name.

    Bands come first, in a projection of their own: each is then computed once a row, and the generated methods stay small
    enough to be compiled."""
    kept = [c for c in df.columns if c not in {prefix + n for n in names}]
    df = df.withColumns({f"_b_{b}": band(b) for b in BANDS})
    with given({b: F.col(f"_b_{b}") for b in BANDS}):
        return df.select(*kept, *[feature(n).alias(prefix + n) for n in names])
