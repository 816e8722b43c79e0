"""Chip assembly: long and array form, clipping, resizing, stacking, NDVI."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from furrow.functions.arrays import channel, ndvi, ndvi_as_dn, zero_chip
from furrow.functions.geometry import pixel_window
from furrow.operators.columns import with_computed
from furrow.operators.filters import COARSE_RES, large_enough
from furrow.session import checkpointed, ship_package, spread


def explode_chips(chips: DataFrame, value: str = "dn") -> DataFrame:
    """Array form -> one row per pixel, with its channel, row and column."""
    others = [c for c in chips.columns if c not in ("c", "h", "w", "px")]
    return (
        chips.select(*others, "h", "w", F.posexplode("px").alias("_i", value))
        .withColumns(
            {
                "c": F.expr("cast(_i div (h * w) as int)"),
                "y": F.expr("cast((_i div w) % h as int)"),
                "x": F.expr("cast(_i % w as int)"),
            }
        )
        .select(*others, "c", "y", "x", value)
    )


def collect_chips(pixels: DataFrame, keys: Sequence[str] = ("chip_id",), value: str = "dn") -> DataFrame:
    """Long form -> array form. A group is one chip, whose size is fixed."""
    return (
        pixels.groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.struct("c", "y", "x", F.col(value).alias("v")))).alias("_p"),
            (F.max("c") + 1).alias("c"),
            (F.max("y") + 1).alias("h"),
            (F.max("x") + 1).alias("w"),
        )
        .select(*keys, "c", "h", "w", F.transform("_p", lambda p: p["v"]).alias("px"))
    )


def stack_bands(windows: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("field_id", "window_idx")) -> DataFrame:
    """Band windows -> one chip per key, channels in the order of ``bands``. Keys
    that lack or repeat a band, or whose windows differ in size, are dropped."""
    place = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col("band"))
    return (
        windows.where(F.col("band").isin(*bands))
        .groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.struct(place.alias("i"), F.col("px").alias("px")))).alias("_b"),
            F.max("h").alias("h"),
            F.max("w").alias("w"),
            ((F.max("h") == F.min("h")) & (F.max("w") == F.min("w"))).alias("_even"),
        )
        .where((F.size("_b") == len(bands)) & (F.size(F.array_distinct(F.transform("_b", lambda b: b["i"]))) == len(bands)) & F.col("_even"))
        .select(*keys, F.lit(len(bands)).alias("c"), "h", "w", F.flatten(F.transform("_b", lambda b: b["px"])).alias("px"))
    )


def add_ndvi(chips: DataFrame, bands: Sequence[str], red: str = "B04", nir: str = "B08") -> DataFrame:
    """Append the vegetation index as a last channel, when both bands exist."""
    bands = list(bands)
    if red not in bands or nir not in bands:
        return chips
    index = ndvi(channel(F.col("px"), bands.index(nir)), channel(F.col("px"), bands.index(red)))
    px = F.concat(F.transform("px", lambda v: v.cast("double")), ndvi_as_dn(index))
    return chips.withColumns({"px": px, "c": F.col("c") + 1})


def _lists(array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list column."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    offsets = array.offsets.to_numpy()
    values = array.values.to_numpy(zero_copy_only=False)
    return values, offsets


def _list_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.float64()))


def _axis(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-pixel-centre positions along one axis: lower, upper, weight of upper."""
    at = np.maximum((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0.0)
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, n_in - 1), at - low


def _resize(values: np.ndarray, start: np.ndarray, h: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """Resize planes of mixed sizes, one array operation per input size.

    Plane k has ``h[k] * w[k]`` values from ``start[k]``; returns one row of
    ``size * size`` values per plane.
    """
    out = np.empty((len(h), size * size), np.float64)
    shapes = np.stack([h, w], axis=1)
    for hh, ww in np.unique(shapes, axis=0):
        rows = np.flatnonzero((shapes == (hh, ww)).all(axis=1))
        img = values[start[rows][:, None] + np.arange(hh * ww)].astype(np.float64).reshape(-1, hh, ww)
        y0, y1, wy = _axis(int(hh), size)
        x0, x1, wx = _axis(int(ww), size)
        upper, lower = img[:, y0], img[:, y1]
        top = (1 - wx) * upper[:, :, x0] + wx * upper[:, :, x1]
        low = (1 - wx) * lower[:, :, x0] + wx * lower[:, :, x1]
        wy = wy[:, None]
        out[rows] = ((1 - wy) * top + wy * low).reshape(len(rows), -1)
    return out


# Bytes of resized planes that are held at once.
OUTPUT_BYTES = 64 << 20


def _bounded(per_row: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose resized planes stay within ``OUTPUT_BYTES``, or single rows."""
    ends = np.cumsum(per_row)
    at, room = 0, OUTPUT_BYTES // (8 * size * size)
    while at < len(per_row):
        done = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + room, "right")))
        yield at, end
        at = end


def row_slices(lists: pa.Array, values: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a list column that hold at most so many values, or single rows."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    at, n = 0, len(lists)
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + values, "right")) - 1)
        yield at, end
        at = end


def _with_double_px(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == "px" else f.dataType, f.nullable) for f in schema]
    )


def resize_bilinear(chips: DataFrame, size: int) -> DataFrame:
    """Resize every channel of ``h, w, px`` rows to ``size`` x ``size``
    (half-pixel centres, edges clamped).

    Runs on Arrow batches: as column functions this would be four array
    lookups and a dozen interpreted operations per output pixel.
    """
    names = chips.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in names}
            h, w = cols["h"].to_numpy(), cols["w"].to_numpy()
            values, offsets = _lists(cols["px"])
            per_row = (offsets[1:] - offsets[:-1]) // (h * w)
            for lo, hi in _bounded(per_row, size):
                many = per_row[lo:hi]
                row = np.repeat(np.arange(lo, hi), many)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = offsets[:-1].astype(np.int64)[row] + nth * (h * w)[row]
                out = _resize(values, start, h[row], w[row], size)
                part = {n: cols[n].slice(lo, hi - lo) for n in names}
                part["px"] = _list_column(out.ravel(), np.concatenate([[0], np.cumsum(many)]) * size * size)
                for side in ("h", "w"):
                    part[side] = pa.array(np.full(hi - lo, size), cols[side].type)
                yield pa.RecordBatch.from_arrays([part[n] for n in names], names=names)

    ship_package(chips.sparkSession)
    return chips.mapInArrow(run, _with_double_px(chips.schema))


def resize_planes(df: DataFrame, size: int, planes: str = "planes") -> DataFrame:
    """Replace ``planes``, an array<struct<h,w,px>> of mixed sizes, by ``px``:
    the planes resized to ``size`` x ``size``, in order."""
    names = [c for c in df.columns if c != planes]
    schema = T.StructType([*[df.schema[n] for n in names], T.StructField("px", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(planes)
            ends = column.offsets.to_numpy().astype(np.int64)
            items = column.values
            h, w = items.field("h").to_numpy(), items.field("w").to_numpy()
            values, offsets = _lists(items.field("px"))
            for lo, hi in _bounded(np.diff(ends), size):
                a, b = ends[lo], ends[hi]
                out = _resize(values, offsets[:-1].astype(np.int64)[a:b], h[a:b], w[a:b], size)
                px = _list_column(out.ravel(), (ends[lo : hi + 1] - a) * size * size)
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(lo, hi - lo) for n in names], px], names=[*names, "px"])

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def apply_transform(chips: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Run a user function ``(c, h, w) array -> (c, h, w) array`` on every chip."""
    names = chips.columns

    def finish(batch: pa.RecordBatch, lo: int, hi: int, results: list[np.ndarray]) -> pa.RecordBatch:
        cols = {n: batch.column(n).slice(lo, hi - lo) for n in names}
        cols["px"] = _list_column(np.concatenate([r.ravel() for r in results]), np.concatenate([[0], np.cumsum([r.size for r in results])]))
        for k, name in enumerate(("c", "h", "w")):
            cols[name] = pa.array([r.shape[k] for r in results], cols[name].type)
        return pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.stack([batch.column(k).to_numpy() for k in ("c", "h", "w")], axis=1)
            values, offsets = _lists(batch.column("px"))
            lo, held, results = 0, 0, []
            for i, (a, b, shape) in enumerate(zip(offsets[:-1], offsets[1:], map(tuple, sizes))):
                results.append(np.asarray(fn(values[a:b].astype(np.float64).reshape(shape)), np.float64))
                held += results[-1].nbytes
                if held >= OUTPUT_BYTES:
                    yield finish(batch, lo, i + 1, results)
                    lo, held, results = i + 1, 0, []
            if results:
                yield finish(batch, lo, batch.num_rows, results)

    ship_package(chips.sparkSession)
    return chips.mapInArrow(run, _with_double_px(chips.schema))


def multitemporal_chips(
    obs: DataFrame,
    bands: Sequence[str],
    n_windows: int,
    size: int,
    min_px: int = 4,
    max_missing: int = 1,
    ndvi_channel: bool = True,
    coarse_res: float = COARSE_RES,
    labels: DataFrame | None = None,
    usable: DataFrame | None = None,
) -> DataFrame:
    """Native band windows -> one multi-window chip per field.

    Size check, per-band resize, band stack, NDVI, window stack. ``labels``
    (one row per field) is joined on, ``usable`` (field and window) restricts
    the windows that count.

    The pixels are shuffled once, by field and at native size; the joins use
    the same layout, and everything that makes the rows larger comes after. A
    group is one field, so it never holds more than windows x bands rows.
    """
    bands = list(bands)
    place = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col("band"))
    plane = F.struct(
        F.col("window_idx").alias("t"),
        place.alias("i"),
        large_enough(min_px, coarse_res).alias("ok"),
        F.col("h").alias("h"),
        F.col("w").alias("w"),
        F.col("px").alias("px"),
    )
    per_field = (
        obs.where(F.col("band").isin(*bands)).groupBy("field_id").agg(F.array_sort(F.collect_list(plane)).alias("_p"))
    )
    if usable is not None:
        allowed = usable.groupBy("field_id").agg(F.collect_set("window_idx").alias("_t"))
        per_field = per_field.join(allowed, "field_id").withColumn(
            "_p", F.filter("_p", lambda p: F.array_contains(F.col("_t"), p["t"]))
        ).drop("_t")

    def complete(t: Column) -> Column:
        planes = F.filter("_p", lambda p: p["t"] == t)
        distinct = F.array_distinct(F.transform(planes, lambda p: p["i"]))
        return (F.size(planes) == len(bands)) & (F.size(distinct) == len(bands)) & F.forall(planes, lambda p: p["ok"])

    present = F.filter(F.sequence(F.lit(0), F.lit(n_windows - 1)), complete)
    per_field = with_computed(per_field, {"present": present}).where(
        (F.size("present") > 0) & (n_windows - F.size("present") <= max_missing)
    )
    if labels is not None:
        per_field = per_field.join(labels, "field_id")
    kept = F.filter("_p", lambda p: F.array_contains(F.col("present"), p["t"]))
    per_field = per_field.withColumn(
        "planes", F.transform(kept, lambda p: F.struct(p["h"].alias("h"), p["w"].alias("w"), p["px"].alias("px")))
    ).drop("_p")
    chips = resize_planes(per_field, size)

    area = size * size
    block = len(bands) * area
    with_index = ndvi_channel and {"B04", "B08"} <= set(bands)
    channels = len(bands) + int(with_index)

    def window(i: Column) -> Column:
        at = F.array_position("present", i)
        px = F.slice("px", (at - 1).cast("int") * block + 1, block)
        if with_index:
            nir, red = (F.slice(px, bands.index(b) * area + 1, area) for b in ("B08", "B04"))
            px = F.concat(px, ndvi_as_dn(ndvi(nir, red)))
        return F.when(at > 0, px).otherwise(zero_chip(F.lit(channels * area)))

    return chips.select(
        *[c for c in chips.columns if c not in ("present", "px")],
        (n_windows - F.size("present")).alias("missing"),
        F.lit(channels * n_windows).alias("c"),
        F.lit(size).alias("h"),
        F.lit(size).alias("w"),
        F.concat(*[window(F.lit(i)) for i in range(n_windows)]).alias("px"),
    )


def to_blocks(rasters: DataFrame, size: int, keys: Sequence[str] = ("scene_id", "band")) -> DataFrame:
    """Rasters (``h, w, px``) -> square blocks of ``size`` pixels, smaller at the
    right and lower edge: ``br, bc, bh, bw, px``."""
    last = lambda side: F.floor((F.col(side) - 1) / size).cast("int")
    rows = rasters.withColumn("br", F.explode(F.sequence(F.lit(0), last("h")))).withColumn("bc", F.explode(F.sequence(F.lit(0), last("w"))))
    rows = rows.withColumns({"bh": F.least(F.lit(size), F.col("h") - F.col("br") * size), "bw": F.least(F.lit(size), F.col("w") - F.col("bc") * size)})
    top = F.col("br") * size
    lines = F.transform(F.sequence(top, top + F.col("bh") - 1), lambda y: F.slice("px", y * F.col("w") + F.col("bc") * size + 1, F.col("bw")))
    return rows.select(*keys, "br", "bc", "bh", "bw", F.flatten(lines).alias("px"))


# Windows that share one copy of a block, and the most copies of a block.
WINDOWS_PER_COPY = 64
COPY_SALTS = 1024


Blocks = DataFrame | Callable[[DataFrame], DataFrame]


def block_pieces(windows: DataFrame, blocks: Blocks, size: int, keys: Sequence[str]) -> DataFrame:
    """Each window next to every block it meets. ``blocks`` may be a reader: a function
    from the places wanted (``scene_id``, ``band`` if windows have one, ``br, bc``, each
    once) to the blocks there, so that rasters no window meets are never unpacked.

    A block under very many windows would be a hot key of the join, so its windows
    are dealt over copies of it, one for every ``WINDOWS_PER_COPY``. The counts are
    joined to the windows by block and salt, so no step has the hot key alone.
    """
    span = lambda off, n: F.explode(F.sequence(F.floor(F.col(off) / size).cast("int"), F.floor((F.col(off) + F.col(n) - 1) / size).cast("int")))
    place = ["scene_id", *(c for c in ("band",) if c in windows.columns), "br", "bc"]
    wanted = windows.where((F.col("width") > 0) & (F.col("height") > 0)).withColumn("br", span("row_off", "height")).withColumn("bc", span("col_off", "width"))
    wanted = wanted.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(COPY_SALTS)))
    counts = wanted.groupBy(*place, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    copies = F.ceil(F.sum("_n").over(Window.partitionBy(*place)) / WINDOWS_PER_COPY)
    parts = counts.select(*place, "_salt", (F.col("_salt") % F.least(copies, F.lit(COPY_SALTS))).alias("_part"))
    blocks = blocks(counts.select(*place).distinct()) if callable(blocks) else blocks
    copied = blocks.join(parts.select(*place, "_part").distinct(), place)
    return wanted.join(parts, [*place, "_salt"]).join(copied, [*place, "_part"]).drop("_salt", "_part")


# Rows that share one copy of a window's pixels.
ROWS_PER_COPY = 10_000


def cut_windows(windows: DataFrame, blocks: Blocks, size: int, keys: Sequence[str] = ("field_id",)) -> DataFrame:
    """Pixels of each window: ``keys, scene_id, band, h, w, px``.

    ``windows`` has ``keys, scene_id, col_off, row_off, width, height`` inside the
    scene's grid and is cut from every band of its scene, or from one if it has a
    column ``band``. ``blocks`` are rasters stored in blocks of ``size``.

    Rows with one window share its pixels: each window is cut once, or once for every
    ``ROWS_PER_COPY`` of its rows, and joined back to them. It names the few blocks it
    meets and is joined to those by key. Only the pixels inside the windows are
    shuffled on, and a group is one window with its bands.
    """
    spark = windows.sparkSession
    window = ["scene_id", *(c for c in ("band",) if c in windows.columns), "row_off", "col_off", "height", "width"]
    rows = checkpointed(windows.select(*dict.fromkeys([*keys, *window])), spark, "windows")  # read for the windows and for their rows
    counts = rows.groupBy(*window).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_COPY).cast("int").alias("_copies"))
    distinct = checkpointed(counts.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))), spark, "distinct-windows")
    cut = _cut_distinct(spread(distinct.select(*window, "_copy"), *window, "_copy"), blocks, size, [*window, "_copy"])
    # At most one in ``ROWS_PER_COPY`` rows has a window with several copies: few, and of known size.
    copies = distinct.where((F.col("_copies") > 1) & (F.col("_copy") == 0)).select(*window, "_copies")
    dealt = rows.join(copies, window, "left").withColumn("_copy", F.coalesce(F.pmod(F.xxhash64(*keys), F.col("_copies")), F.lit(0)).cast("int"))
    found = dealt.drop("_copies").join(cut, [*window, "_copy"])
    return found.select(*keys, "scene_id", "band", F.col("height").alias("h"), F.col("width").alias("w"), "px")


def _cut_distinct(windows: DataFrame, blocks: Blocks, size: int, keys: Sequence[str]) -> DataFrame:
    """``keys, band, px`` of windows that differ in ``keys``, their place among them."""
    pieces = block_pieces(windows, blocks, size, keys)
    top, left = F.col("br") * size, F.col("bc") * size
    y0, y1 = F.greatest(F.col("row_off"), top), F.least(F.col("row_off") + F.col("height"), top + F.col("bh"))
    x0, x1 = F.greatest(F.col("col_off"), left), F.least(F.col("col_off") + F.col("width"), left + F.col("bw"))
    # One row per window and block moves on, with the pixels inside the window of all bands.
    inside = (F.col("_y") - top) * F.col("bw") + F.col("_x") - left
    pixel = lambda k: F.get("px", (inside + F.floor(k / F.col("_n")) * F.col("bw") + k % F.col("_n")).cast("int"))
    placed = pieces.withColumns({"_y": y0, "_x": x0, "_n": x1 - x0, "_lines": y1 - y0})
    cut = F.struct(
        "band", F.col("_y").alias("y"), F.col("_x").alias("x"), F.col("_n").alias("n"), F.transform(F.sequence(F.lit(0), F.col("_n") * F.col("_lines") - 1), pixel).alias("px")
    )
    whole = placed.select(*keys, cut.alias("p")).groupBy(*keys).agg(F.collect_list("p").alias("_all"))
    if "band" in keys:
        whole = whole.withColumnRenamed("_all", "_p")
    else:
        whole = whole.withColumn("band", F.explode(F.array_distinct("_all.band"))).withColumn("_p", F.filter("_all", lambda p: p["band"].eqNullSafe(F.col("band"))))
    lines = lambda p: F.transform(
        F.sequence(F.lit(0), (F.size(p["px"]) / p["n"]).cast("int") - 1),
        lambda i: F.struct((p["y"] + i).alias("y"), p["x"].alias("x"), F.slice(p["px"], (i * p["n"] + 1).cast("int"), p["n"].cast("int")).alias("px")),
    )
    sorted_lines = F.sort_array(F.flatten(F.transform("_p", lines)))
    return whole.select(*dict.fromkeys([*keys, "band"]), F.flatten(F.transform(sorted_lines, lambda v: v["px"])).alias("px"))


def clip_tiles(tiles: DataFrame, bbox: Sequence[float]) -> DataFrame:
    """Crop each raster to a box; see ``with_clip_window`` for those that miss it."""
    hit = with_clip_window(tiles, bbox).where(F.col("status") == "ok")
    rows = F.transform(
        F.sequence(F.col("_w.row_off"), F.col("_w.row_off") + F.col("_w.height") - 1),
        lambda y: F.slice("px", y * F.col("w") + F.col("_w.col_off") + 1, F.col("_w.width")),
    )
    return hit.withColumn("px", F.flatten(rows)).select(
        "scene_id",
        (F.col("origin_x") + F.col("_w.col_off") * F.col("res")).alias("origin_x"),
        (F.col("origin_y") - F.col("_w.row_off") * F.col("res")).alias("origin_y"),
        "res",
        F.col("_w.row_off").alias("row_off"),
        F.col("_w.col_off").alias("col_off"),
        F.lit(1).alias("c"),
        F.col("_w.height").alias("h"),
        F.col("_w.width").alias("w"),
        "px",
    )


def with_clip_window(tiles: DataFrame, bbox: Sequence[float]) -> DataFrame:
    """Add the clip window ``_w`` and ``status``: ``ok`` or ``disjoint``."""
    x0, y0, x1, y1 = (F.lit(float(v)) for v in bbox)
    window = pixel_window(x0, y0, x1, y1, F.col("origin_x"), F.col("origin_y"), F.col("res"), F.col("w"), F.col("h"))
    hit = (F.col("_w.width") > 0) & (F.col("_w.height") > 0)
    return tiles.withColumn("_w", window).withColumn("status", F.when(hit, "ok").otherwise("disjoint"))


def window_report(
    obs: DataFrame, fields: DataFrame, bands: Sequence[str], n_windows: int, min_px: int = 4, coarse_res: float = COARSE_RES
) -> DataFrame:
    """Per date window: chips extracted, fields without a scene, and fields
    whose native window is too small (or lacks or repeats a band)."""
    place = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col("band"))
    seen = F.collect_list(place)  # one number per band row of a window
    complete = (F.size(seen) == len(bands)) & (F.size(F.array_distinct(seen)) == len(bands))
    per_key = (
        obs.where(F.col("band").isin(*bands))
        .groupBy("window_idx", "field_id")
        .agg((F.bool_and(large_enough(min_px, coarse_res)) & complete).alias("ok"))
    )
    counts = per_key.groupBy("window_idx").agg(F.count_if("ok").alias("chips"), F.count_if(~F.col("ok")).alias("too_small"))
    total = fields.agg(F.count(F.lit(1)).alias("n"))
    windows = obs.sparkSession.range(n_windows).select(F.col("id").cast("int").alias("window_idx"))
    return (
        windows.join(counts, "window_idx", "left")
        .na.fill(0, ["chips", "too_small"])
        .withColumn("no_scene", total.scalar() - F.col("chips") - F.col("too_small"))
    )


def series_to_grid(series: DataFrame) -> DataFrame:
    """Time series (t, c) -> square grid per channel, row-major, zero padded.

    Stays in long form: step t goes to (t div S, t mod S) with S the ceiling of
    the square root of the length. Only the padding, at most 2*S cells per
    sample and channel, is generated, from the per-sample counts.
    """
    lengths = series.groupBy("sample_id", "c").agg((F.max("t") + 1).alias("n")).withColumn(
        "side", F.ceil(F.sqrt(F.col("n").cast("double"))).cast("int")
    )
    side = F.col("side")

    def placed(df: DataFrame) -> DataFrame:
        return df.select(
            "sample_id", "c", "side", F.expr("cast(t div side as int)").alias("y"), (F.col("t") % side).alias("x"), "v"
        )

    body = placed(series.join(lengths.select("sample_id", "c", "side"), ["sample_id", "c"]))
    last = side * side - 1
    pad = lengths.where(F.col("n") <= last).select(
        "sample_id", "c", "side", F.explode(F.sequence(F.col("n"), last)).alias("t"), F.lit(0).cast("bigint").alias("v")
    )
    return body.unionByName(placed(pad))


def select_task(tasks: DataFrame, name: str) -> DataFrame:
    """The rows of the task whose id contains ``name``; running it fails when
    there is none."""
    found = tasks.where(F.contains(F.col("task_id"), F.lit(name)))
    first = found.agg(F.min("task_id").alias("_t")).select(
        F.when(F.col("_t").isNull(), F.raise_error(F.lit(f"no task with {name!r} in its id"))).otherwise(F.col("_t")).alias("task_id")
    )
    return found.join(first, "task_id")
