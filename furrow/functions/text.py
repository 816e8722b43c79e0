"""Small argument formats: lists, boxes, date windows and asset names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: a band suffix at the end of a file stem, e.g. ``_B02`` or ``_B8A``.
BAND_SUFFIX = r"_B\d+[a-zA-Z]?$"


def parse_list(col: Column) -> Column:
    """Comma list -> trimmed, non-empty items."""
    return F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_bbox(col: Column) -> Column:
    """``lon_min,lat_min,lon_max,lat_max`` -> array of four doubles, or null
    when the text has another number of parts or a part is not a number."""
    parts = F.transform(F.split(col, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull()), parts)


def parse_windows(col: Column) -> Column:
    """``start:end`` pairs -> array<struct<pair,d0,d1,error>>; blank pairs are
    skipped and a pair without exactly two parts carries an error."""

    def one(pair: Column) -> Column:
        parts = F.transform(F.split(pair, ":"), lambda x: F.trim(x))
        good = F.size(parts) == 2
        return F.struct(
            pair.alias("pair"),
            F.when(good, parts[0].try_cast("date")).alias("d0"),
            F.when(good, parts[1].try_cast("date")).alias("d1"),
            F.when(~good, F.lit("expected start:end")).alias("error"),
        )

    return F.transform(parse_list(col), one)


def asset_name(scene_id: Column, band: Column) -> Column:
    return F.concat(scene_id, F.lit("_"), band, F.lit(".tif"))


def asset_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def asset_scene(path: Column) -> Column:
    """Scene part of an asset name: the stem without its band suffix."""
    return F.regexp_replace(asset_stem(path), BAND_SUFFIX, "")


def asset_band(path: Column) -> Column:
    """Band part of an asset name, or null where there is none."""
    band = F.regexp_extract(asset_stem(path), r"_(B\d+[a-zA-Z]?)$", 1)
    return F.when(band != "", band)
