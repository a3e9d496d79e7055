"""Masks from the bits of the quality word: 1 where the condition holds, 0 where not, NULL where the word is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit numbers; the aerosol levels are pairs of bits 6 and 7.
BITS = {"cirrus": 0, "cloud": 1, "cloud_adj": 2, "shadow": 3, "snow": 4, "water": 5}
AEROSOL = {"low_aerosol": (0, 1), "mod_aerosol": (1, 0), "high_aerosol": (1, 1)}
ALL = ("cirrus", "cloud", "cloud_adj", "shadow", "snow", "water", "high_aerosol")
NAMES = (*BITS, *AEROSOL, "any_aerosol")


def mask(name: str, word: str = "FMASK") -> Column:
    q = F.col(word).cast("int")
    bit = lambda b: F.shiftright(q, b).bitwiseAND(1)
    if name in BITS:
        return bit(BITS[name]).cast("byte")
    if name in AEROSOL:
        six, seven = AEROSOL[name]
        return ((bit(6) == six) & (bit(7) == seven)).cast("byte")
    if name == "any_aerosol":
        return F.greatest(*(mask(n, word) for n in AEROSOL))
    raise KeyError(f"no mask is called {name}")


def masked(names: Sequence[str] = ("all",), word: str = "FMASK") -> Column:
    """1 where any of the named masks holds; 'all' stands for those of ALL."""
    if not names:
        raise ValueError("name at least one mask")
    chosen = ALL if "all" in names else tuple(names)
    columns = [mask(n, word) for n in chosen]
    return columns[0] if len(columns) == 1 else F.greatest(*columns)
