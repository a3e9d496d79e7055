"""Bands of an observation as columns; missing is NULL."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999
SCALE = 0.0001
BANDS = ("BLUE", "GREEN", "RED", "NIR1", "SWIR1", "SWIR2")
ANGLES = ("SZA", "SAA", "VZA", "VAA")
NEEDED = (*BANDS, "FMASK", *ANGLES)

# Asset names of the two sensors and the common names of their bands.
ASSETS = {
    "S30": {
        "B01": "COASTAL-AEROSOL", "B02": "BLUE", "B03": "GREEN", "B04": "RED", "B05": "RED-EDGE1", "B06": "RED-EDGE2", "B07": "RED-EDGE3", "B08": "NIR-Broad", "B8A": "NIR1",
        "B09": "WATER-VAPOR", "B10": "CIRRUS", "B11": "SWIR1", "B12": "SWIR2", "Fmask": "FMASK", "VZA": "VZA", "VAA": "VAA", "SZA": "SZA", "SAA": "SAA",
    },
    "L30": {
        "B01": "COASTAL-AEROSOL", "B02": "BLUE", "B03": "GREEN", "B04": "RED", "B05": "NIR1", "B06": "SWIR1", "B07": "SWIR2", "B09": "CIRRUS", "B10": "TIR1", "B11": "TIR2",
        "Fmask": "FMASK", "VZA": "VZA", "VAA": "VAA", "SZA": "SZA", "SAA": "SAA",
    },
}


_given: ContextVar[Mapping[str, Column]] = ContextVar("given", default={})


@contextmanager
def given(columns: Mapping[str, Column]) -> Iterator[None]:
    """Within it, band() takes these columns, in which nodata is NULL already."""
    token = _given.set(columns)
    try:
        yield
    finally:
        _given.reset(token)


def band(name: str) -> Column:
    """A band with the nodata value as NULL."""
    if name in _given.get():
        return _given.get()[name]
    return F.nullif(F.col(name).cast("double"), F.lit(float(NODATA)))


def scaled(name: str) -> Column:
    """A band as reflectance."""
    return band(name) * F.lit(SCALE)
