"""Chip arrays as columns. A chip is ``px``, row-major over (channel, y, x),
next to its sizes ``c, h, w``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from furrow.functions.hashing import uniform

NDVI_EPSILON = 1e-3
NDVI_SCALE = 5000.0
REFLECTANCE_SCALE = 10_000.0


def plane() -> Column:
    """Pixels per channel."""
    return F.col("h") * F.col("w")


def channel(px: Column, i: int) -> Column:
    """One channel of a chip."""
    return F.slice(px, plane() * i + 1, plane())


def ndvi(b08: Column, b04: Column) -> Column:
    """Vegetation index of two channels, element by element, on raw values."""

    def index(n, r):
        n, r = n.cast("double"), r.cast("double")
        return (n - r) / (n + r + F.lit(NDVI_EPSILON))

    return F.zip_with(b08, b04, index)


def ndvi_as_dn(values: Column) -> Column:
    """Vegetation index -> the value range of the other channels."""
    return F.transform(values, lambda v: (v + 1.0) * NDVI_SCALE)


def argmax(values: Column) -> Column:
    """Position of the largest value, the lowest on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def zero_chip(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), n.cast("int"))


def coin(id_col: Column, seed: int, op: str, p: float) -> Column:
    """True with probability ``p``, the same for a row under any layout."""
    return uniform(id_col, seed, op) < F.lit(float(p))


def quarter_turns(id_col: Column, seed: int, op: str = "rot90") -> Column:
    """0..3 with equal chance."""
    return F.floor(uniform(id_col, seed, op) * 4).cast("int")
