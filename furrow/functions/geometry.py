"""Boxes, footprints and pixel windows as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Text patterns of polygon WKT.
_HEAD = r"(?i)^\s*(?:MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*"
_POLYGON = _HEAD + r"(?:EMPTY|\(+[-+.\deE,\s()]*\d[-+.\deE,\s()]*\))\s*$"


def is_polygon_wkt(wkt: Column) -> Column:
    """True for polygon text whose rings have four points or more and are closed,
    and for EMPTY ones; null stays null."""
    texts = F.filter(F.split(wkt, r"\)"), lambda t: t.rlike(r"\d"))
    # Split once per ring: what a later step names twice is computed twice.
    rings = F.transform(texts, lambda ring: F.split(F.regexp_replace(ring, r"^[^(]*\(+", ""), ","))

    def point(text: Column) -> Column:
        return F.transform(F.slice(F.split(F.trim(text), r"\s+"), 1, 2), lambda v: v.try_cast("double"))

    def closed(points: Column) -> Column:
        first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
        # Equal texts are equal points; most rings end as they begin.
        return (F.size(points) >= 4) & ((F.trim(first) == F.trim(last)) | (point(first) == point(last)))

    return F.when(wkt.isNotNull(), wkt.rlike(_POLYGON) & F.coalesce(F.forall(rings, closed), F.lit(False)))


def wkt_words(wkt: Column) -> Column:
    """WKT text as its words: the type first, then the numbers."""
    return F.split(F.trim(wkt), r"[\s,()]+")


def numbers_of(words: Column) -> Column:
    """Words of a WKT polygon -> its x and y values in turn; null when it is no
    polygon text or has none. Higher dimensions are left out."""
    tag = F.upper(F.get(words, 1))
    extra = F.when(tag.isin("Z", "M", "ZM"), F.length(tag)).otherwise(0)
    head = F.when(extra > 0, 2).otherwise(1)
    numbers = F.transform(F.slice(words, head + 1, F.greatest(F.size(words) - head - 1, F.lit(0))), lambda v: v.try_cast("double"))
    polygon = F.upper(F.get(words, 0)).isin("POLYGON", "MULTIPOLYGON") & (F.size(words) > 3)
    flat = F.when(extra > 0, F.filter(numbers, lambda _, i: i % (2 + extra) < 2)).otherwise(numbers)
    return F.when(polygon, flat)


def bounds_of(numbers: Column) -> Column:
    """Bounds of x and y values given in turn; null when a value is missing."""

    def of(parity: int) -> Column:
        return F.filter(numbers, lambda _, i: i % 2 == parity)

    def box(v: Column) -> Column:
        return F.struct(F.array_min(v["x"]).alias("x0"), F.array_min(v["y"]).alias("y0"), F.array_max(v["x"]).alias("x1"), F.array_max(v["y"]).alias("y1"))

    # As an array of one, so that the values are taken apart once.
    boxes = F.transform(F.array(F.struct(of(0).alias("x"), of(1).alias("y"))), box)
    return F.when((F.size(numbers) > 0) & ~F.exists(numbers, lambda v: v.isNull()), boxes[0])


def wkt_bounds(wkt: Column) -> Column:
    """WKT polygon -> struct<x0,y0,x1,y1>; null when unparseable or empty."""
    return F.when(is_polygon_wkt(wkt), bounds_of(numbers_of(wkt_words(wkt))))


def wkt_coordinates(wkt: Column) -> Column:
    """WKT polygon -> GeoJSON MultiPolygon coordinates (polygons, rings, points).

    Text splits at ``)), ((`` between polygons and at ``), (`` between rings.
    """
    body = F.regexp_replace(wkt, _HEAD + r"\(+|\)+\s*$", "")
    polygons = F.split(body, r"\)\s*\)\s*,\s*\(\s*\(")

    def ring(text: Column) -> Column:
        return F.transform(
            F.split(F.trim(text), r"\s*,\s*"),
            lambda pt: F.transform(F.slice(F.split(F.trim(pt), r"\s+"), 1, 2), lambda v: v.cast("double")),
        )

    coords = F.transform(polygons, lambda poly: F.transform(F.split(poly, r"\)\s*,\s*\("), ring))
    empty = F.expr("cast(array() as array<array<array<array<double>>>>)")
    return F.when(~is_polygon_wkt(wkt), F.lit(None)).when(wkt.rlike(r"\d"), coords).otherwise(empty)


def bbox_ring(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    """Closed five-point ring, counter-clockwise from the lower left corner."""
    return F.array(
        F.array(lon_min, lat_min),
        F.array(lon_max, lat_min),
        F.array(lon_max, lat_max),
        F.array(lon_min, lat_max),
        F.array(lon_min, lat_min),
    )


def bbox_error(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    """First rule a box breaks, or null for a valid one."""
    sides = (lon_min, lat_min, lon_max, lat_max)
    error = F.when(reduce(lambda a, b: a | b, [v.isNull() for v in sides]), "missing coordinate")
    for message, broken in BOX_RULES:
        error = error.when(broken(*sides), message)
    return error


# Rules of a box, in the order they are reported; each works on numbers and on columns.
BOX_RULES = (
    ("empty in longitude", lambda x0, y0, x1, y1: x0 >= x1),
    ("empty in latitude", lambda x0, y0, x1, y1: y0 >= y1),
    ("longitude out of range", lambda x0, y0, x1, y1: (x0 < -180) | (x1 > 180)),
    ("latitude out of range", lambda x0, y0, x1, y1: (y0 < -90) | (y1 > 90)),
)


def footprint(geometry: Column, bbox: Column) -> Column:
    """Scene footprint struct: bounds of a Polygon's exterior ring, else the
    declared bbox, else null."""
    ring = geometry["coordinates"][0]

    def bound(pick, axis: int) -> Column:
        return pick(F.transform(ring, lambda pt: pt[axis]))

    from_ring = F.struct(
        bound(F.array_min, 0).alias("lon_min"),
        bound(F.array_min, 1).alias("lat_min"),
        bound(F.array_max, 0).alias("lon_max"),
        bound(F.array_max, 1).alias("lat_max"),
    )
    from_bbox = F.struct(
        bbox[0].alias("lon_min"), bbox[1].alias("lat_min"), bbox[2].alias("lon_max"), bbox[3].alias("lat_max")
    )
    return F.when(geometry["type"] == "Polygon", from_ring).when(bbox.isNotNull(), from_bbox)


def boxes_touch(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Closed intersection of two boxes: a shared edge counts."""
    return (ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)


def clip_bounds(x0, y0, x1, y1, left, bottom, right, top) -> Column:
    """Part of a box inside an extent, or null without positive area."""
    cx0, cy0 = F.greatest(x0, left), F.greatest(y0, bottom)
    cx1, cy1 = F.least(x1, right), F.least(y1, top)
    return F.when(
        (cx0 < cx1) & (cy0 < cy1),
        F.struct(cx0.alias("x0"), cy0.alias("y0"), cx1.alias("x1"), cy1.alias("y1")),
    )


def pixel_window(x0, y0, x1, y1, origin_x, origin_y, res, width, height) -> Column:
    """Integer pixel window of a box in a north-up grid, clamped to the grid:
    from floor(offset) to ceil(end). Sizes are zero where they do not meet."""

    def clamp(v: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.least(v, hi.cast("bigint")))

    col0 = clamp(F.floor((x0 - origin_x) / res), width)
    col1 = clamp(F.ceil((x1 - origin_x) / res), width)
    row0 = clamp(F.floor((origin_y - y1) / res), height)
    row1 = clamp(F.ceil((origin_y - y0) / res), height)
    return F.struct(
        col0.cast("int").alias("col_off"),
        row0.cast("int").alias("row_off"),
        F.greatest(col1 - col0, F.lit(0)).cast("int").alias("width"),
        F.greatest(row1 - row0, F.lit(0)).cast("int").alias("height"),
    )
