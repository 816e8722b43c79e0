"""Filters on fields and pixel windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from furrow.functions.geometry import bbox_error, bounds_of, is_polygon_wkt, numbers_of, wkt_words
from furrow.operators.columns import with_computed

COARSE_RES = 0.00015


def filter_region(df: DataFrame, viloyat: str = "", tuman: str = "") -> DataFrame:
    """Case-insensitive regular-expression search on region and district name."""
    for name, pattern in (("viloyat", viloyat), ("tuman", tuman)):
        if pattern:
            df = df.where(F.col(name).rlike(f"(?i){pattern}"))
    return df


def filter_tuman(df: DataFrame, code: int = 0, exclude: Sequence[int] = ()) -> DataFrame:
    """District equality, or an exclusion list that replaces it when both are
    given. Exclusion keeps rows without a code."""
    if exclude:
        return df.where(~F.col("tuman_code").isin(*exclude) | F.col("tuman_code").isNull())
    return df.where(F.col("tuman_code") == code) if code else df


def limit_fields(df: DataFrame, n: int = 0, id_col: str = "field_id") -> DataFrame:
    """The first ``n`` rows by id (0 = all), taken before any other skipping."""
    return df.orderBy(id_col).limit(n) if n else df


def with_bounds(df: DataFrame, geom_col: str = "geom_2") -> DataFrame:
    """Add ``x0, y0, x1, y1``; null where the geometry is missing, unparseable or empty."""
    # One projection per step: each result is used several times by the next.
    words = df.withColumn("_words", F.when(is_polygon_wkt(F.col(geom_col)), wkt_words(F.col(geom_col))))
    numbers = words.withColumn("_numbers", numbers_of(F.col("_words")))
    parsed = with_computed(numbers, {"_b": bounds_of(F.col("_numbers"))})
    return parsed.select(*df.columns, "_b.x0", "_b.y0", "_b.x1", "_b.y1")


def valid_geometry(df: DataFrame) -> DataFrame:
    return df.where(F.col("x0").isNotNull())


def filter_min_pixels(windows: DataFrame, min_px: int = 4, keys: Sequence[str] = ("field_id", "window_idx")) -> DataFrame:
    """Keys whose bands all have at least ``min_px`` rows and columns."""
    return _all_bands(windows, (F.col("h") >= min_px) & (F.col("w") >= min_px), keys)


def filter_min_pixels_multires(
    windows: DataFrame,
    min_px: int = 4,
    keys: Sequence[str] = ("field_id", "window_idx"),
    coarse_res: float = COARSE_RES,
) -> DataFrame:
    """As above, but bands coarser than ``coarse_res`` only need one pixel."""
    return _all_bands(windows, large_enough(min_px, coarse_res), keys)


def large_enough(min_px: int, coarse_res: float = COARSE_RES) -> Column:
    fine = (F.col("h") >= min_px) & (F.col("w") >= min_px)
    return (F.col("h") >= 1) & (F.col("w") >= 1) & ((F.col("res") > coarse_res) | fine)


def _all_bands(windows: DataFrame, ok: Column, keys: Sequence[str]) -> DataFrame:
    return (
        windows.groupBy(*keys)
        .agg(F.bool_and(ok).alias("_ok"), F.count(F.lit(1)).alias("bands"))
        .where("_ok")
        .drop("_ok")
    )


def bbox_check(df: DataFrame, lon_min="lon_min", lat_min="lat_min", lon_max="lon_max", lat_max="lat_max") -> DataFrame:
    """Add ``error``: the first rule the box breaks, null when valid."""
    return df.withColumn("error", bbox_error(F.col(lon_min), F.col(lat_min), F.col(lon_max), F.col(lat_max)))
