"""Registered queries: one per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from furrow import fixtures as fx
from furrow.functions import arrays, geometry, labels, text
from furrow.functions.projection import bounds_to_utm
from furrow.operators import assign, chips as chip_ops, filters, ml, regions, scoring, splits, stats, transforms
from furrow.plans import build
from furrow.plans.build import labelled_fields, train_and_score
from furrow.session import checkpointed, scratch_path
from furrow.sources import chips as chip_io, fields as field_io, rasters, scenes as scene_io
from furrow.streaming.intake import intake, read_intake, scene_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters shared with the checking SQL.
SEARCH_BOX = (62.0, 39.0, 70.0, 43.0)
SEARCH_DATES = ("2025-05-01", "2025-07-31")
DATE_WINDOWS = [(d0, d1) for _, d0, d1 in fx.WINDOWS]
OBS_BANDS = [b for _, b, _ in fx.OBS_BANDS]
CHIP_BANDS = ["B02", "B03", "B04", "B08"]
MEAN, STD = [0.48, 0.5, 0.51, 0.52], [0.05, 0.06, 0.07, 0.08]
K = 3
SEED = 7
DEGREE_RES, DEGREE_SIDE = 0.0001, 33000


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(col: str | Column, places: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, places)


def joined(px: Column, scale: int = 1) -> Column:
    """Array as text of whole numbers, so that engines compare it exactly."""
    whole = (lambda v: F.floor(v.cast("double") * scale + 0.5)) if scale > 1 else (lambda v: v)
    return F.array_join(F.transform(px, lambda v: whole(v).cast("string")), ",")


def long_values(chips: DataFrame, value: str = "v") -> DataFrame:
    return chip_ops.explode_chips(chips.select("chip_id", "c", "h", "w", "px"), value).withColumn(value, r(F.col(value).cast("double")))


def bounded(spark: SparkSession, d: str) -> DataFrame:
    return filters.with_bounds(fx.fields(spark, d))


def footed(spark: SparkSession, d: str) -> DataFrame:
    return scene_io.footprints(fx.scenes(spark, d))


def exported(spark: SparkSession, d: str) -> DataFrame:
    return field_io.exportable(fx.fields(spark, d))


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """Exported fields with their class, through a stored class table. The labels are
    stored once: the geometry test of an export is costly, and both sides need it."""
    rows = checkpointed(exported(spark, d).select("field_id", "crop_type"), spark, "labels")
    return regions.with_class_idx(rows, checkpointed(regions.class_index(rows), spark, "classes"))


# --- fields: scan, filters, labels, regions ---------------------------------------------


@query
def fields_scan(spark, d):
    return field_io.labelled(fx.fields(spark, d), keep=("field_id",))


@query
def geojson_features(spark, d):
    feats = field_io.to_geojson_features(fx.fields(spark, d), properties=("field_id",))
    return feats.select(
        F.col("properties")["field_id"].cast("bigint").alias("field_id"),
        F.col("properties")["crop_type"].alias("crop_type"),
        F.col("geometry.type").alias("kind"),
        F.posexplode_outer(F.flatten(F.flatten("geometry.coordinates"))).alias("i", "pt"),
    ).select("field_id", "crop_type", "kind", "i", F.col("pt")[0].alias("lon"), F.col("pt")[1].alias("lat"))


@query
def geojson_roundtrip(spark, d):
    path = scratch_path(spark, "geojson")
    field_io.write_geojson(field_io.to_geojson_features(fx.fields(spark, d), properties=("field_id",)), path)
    points = F.flatten(F.flatten("geometry.coordinates"))
    return field_io.read_geojson(spark, path).select(
        F.col("properties")["field_id"].cast("bigint").alias("field_id"),
        "crop_type",
        F.col("geometry.type").alias("kind"),
        F.size(points).alias("points"),
        F.get(points, 0)[0].alias("lon0"),
        F.get(points, 2)[1].alias("lat2"),
    )


@query
def geojson_collection(spark, d):
    """Large collections, read in byte ranges that cut features anywhere."""
    path = scratch_path(spark, "collection")
    features = field_io.to_geojson_features(fx.fields(spark, d), properties=("field_id",))
    field_io.write_geojson(features, path, collection=True)
    points = F.flatten(F.flatten("geometry.coordinates"))
    return field_io.read_geojson(spark, path, collection=True, split_bytes=1 << 16).select(
        F.col("properties")["field_id"].cast("bigint").alias("field_id"),
        "crop_type",
        F.col("geometry.type").alias("kind"),
        F.size(points).alias("points"),
        F.get(points, 0)[0].alias("lon0"),
        F.get(points, 2)[1].alias("lat2"),
    )


@query
def fields_by_region(spark, d):
    return filters.filter_region(fx.fields(spark, d), "asia|europe", "nation_1").select("field_id", "viloyat", "tuman")


@query
def fields_exclude_tuman(spark, d):
    return filters.filter_tuman(fx.fields(spark, d), 1700203, [1700205, 1700207]).select("field_id", "tuman_code")


@query
def fields_limit(spark, d):
    return field_io.labelled(filters.limit_fields(fx.fields(spark, d), 500), keep=("field_id",))


@query
def normalize_labels(spark, d):
    label = F.col("crop_type")
    return fx.fields(spark, d).select(
        "field_id", labels.normalize_label(label).alias("crop_type"), labels.is_unmapped_compound(label).alias("unmapped")
    )


@query
def wkt_bounds(spark, d):
    return bounded(spark, d).select("field_id", "x0", "y0", "x1", "y1")


@query
def geometry_skips(spark, d):
    return regions.geometry_skips(fx.fields(spark, d))


@query
def district_counts(spark, d):
    return regions.district_counts(fx.fields(spark, d))


@query
def top_districts(spark, d):
    return regions.top_districts(regions.district_counts(fx.fields(spark, d)), 3)


@query
def pending_districts(spark, d):
    done = fx.table(spark, d, "nation").where(F.col("n_nationkey") % 4 == 0).select(
        (F.col("n_nationkey") + 1700200).alias("tuman_code")
    )
    return regions.pending_districts(regions.top_districts(regions.district_counts(fx.fields(spark, d)), 3), done).select(
        "region", "tuman", "tuman_code", "polygons", "rank"
    )


@query
def class_distribution(spark, d):
    return regions.class_distribution(exported(spark, d)).withColumn("pct", r("pct"))


@query
def class_index(spark, d):
    return indexed(spark, d).select("field_id", "crop_type", "class_idx")


@query
def sample_per_class(spark, d):
    return regions.sample_per_class(exported(spark, d), 50, SEED).select("field_id", "crop_type")


@query
def extent(spark, d):
    return regions.extent(bounded(spark, d))


@query
def bbox_quality(spark, d):
    k = F.col("field_id") % 6
    rows = filters.valid_geometry(bounded(spark, d)).select(
        "field_id",
        F.when(k == 1, F.col("x1")).when(k == 3, F.col("x0") - 400).otherwise(F.col("x0")).alias("lon_min"),
        F.when(k == 2, F.col("y1")).when(k == 4, F.col("y0") - 200).otherwise(F.col("y0")).alias("lat_min"),
        F.when(k == 1, F.col("x0")).otherwise(F.col("x1")).alias("lon_max"),
        F.when(k == 2, F.col("y0")).when(k == 5, None).otherwise(F.col("y1")).alias("lat_max"),
    )
    return filters.bbox_check(rows).select("field_id", "error")


# --- scenes: catalogue, footprints, files -------------------------------------------------


@query
def scene_footprints(spark, d):
    return footed(spark, d).select("scene_id", "lon_min", "lat_min", "lon_max", "lat_max")


@query
def bbox_ring(spark, d):
    box = [F.col(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")]
    return (
        footed(spark, d)
        .select("scene_id", F.posexplode(geometry.bbox_ring(*box)).alias("i", "pt"))
        .select("scene_id", "i", F.col("pt")[0].alias("lon"), F.col("pt")[1].alias("lat"))
    )


@query
def scene_search(spark, d):
    return scene_io.search_scenes(footed(spark, d), SEARCH_BOX, *SEARCH_DATES).select("scene_id", "cloud_cover", "acq_date")


@query
def search_summary(spark, d):
    return scene_io.search_summary(scene_io.search_scenes(footed(spark, d), SEARCH_BOX, *SEARCH_DATES), CHIP_BANDS)


@query
def rank_scenes(spark, d):
    return scene_io.rank_scenes(fx.scenes(spark, d), 20).select("scene_id", "cloud_cover")


@query
def aoi_scenes(spark, d):
    return scene_io.scenes_per_aoi(footed(spark, d), {"custom": scene_io.resolve_aoi(bbox="62,39,70,43")})


@query
def complete_scenes(spark, d):
    return scene_io.complete_scenes(fx.scenes(spark, d), fx.BANDS).select("scene_id")


@query
def missing_bands(spark, d):
    return scene_io.missing_bands(fx.scenes(spark, d), ["B02", "B09", "B12"])


@query
def scene_groups(spark, d):
    return scene_io.group_assets(fx.assets(spark, d).select("path")).select(
        "scene_id", "n_files", F.array_join("paths", ";").alias("paths")
    )


@query
def download_plan(spark, d):
    return scene_io.download_plan(fx.scenes(spark, d), fx.BANDS, fx.manifest(spark, d))


@query
def download_summary(spark, d):
    return scene_io.download_summary(fx.scenes(spark, d), fx.BANDS, fx.manifest(spark, d), fx.fetch_results(spark, d))


@query
def parse_windows(spark, d):
    return fx.window_specs(spark, d).select("spec_id", F.posexplode(text.parse_windows(F.col("spec"))).alias("i", "w")).select(
        "spec_id", "i", "w.*"
    )


@query
def bounds_to_utm_query(spark, d):
    rows = filters.valid_geometry(bounded(spark, d)).withColumn("epsg", (F.lit(32601) + F.floor((F.col("x0") + 180) / 6)).cast("int"))
    utm = bounds_to_utm(rows, "x0", "y0", "x1", "y1", "epsg")
    return utm.select("field_id", "epsg", *[r(c, 3).alias(c) for c in ("ux0", "uy0", "ux1", "uy1")])


QUERIES["bounds_to_utm"] = QUERIES.pop("bounds_to_utm_query")


def indexed_scenes(spark: SparkSession, d: str) -> DataFrame:
    return assign.scene_index(assign.native_extents(footed(spark, d).select("scene_id", "epsg", "res", *assign._BOX)))


@query
def scene_index_wgs84(spark, d):
    return indexed_scenes(spark, d).select("scene_id", "epsg", "nx0", "ny1", *[r(c).alias(c) for c in assign._BOX])


# --- assignment ---------------------------------------------------------------------------


@query
def assign_best_scene(spark, d):
    return assign.assign_best_scene(bounded(spark, d), footed(spark, d))


@query
def assign_best_scene_windows(spark, d):
    return assign.assign_best_scene_windows(bounded(spark, d), footed(spark, d), DATE_WINDOWS)


@query
def coverage_report(spark, d):
    return assign.coverage_report(assign.assign_best_scene(bounded(spark, d), footed(spark, d), unassigned=True))


@query
def fields_by_scene(spark, d):
    return assign.fields_by_scene(assign.assign_best_scene(bounded(spark, d), footed(spark, d)), chunk=50).select(
        "scene_id", "part", "n_fields", F.array_join(F.transform("field_ids", lambda v: v.cast("string")), ",").alias("field_ids")
    )


@query
def assign_first_yielding(spark, d):
    return assign.assign_first_yielding(bounded(spark, d), indexed_scenes(spark, d), min_px=60)


@query
def assignment_report(spark, d):
    found = assign.assign_first_yielding(
        bounded(spark, d), indexed_scenes(spark, d), min_px=60, unassigned=True, keep=["crop_type"]
    )
    return assign.assignment_report(found, label_col="crop_type")


def best_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Fields next to the scene they are assigned to, whose columns the assignment carries."""
    box = ["lon_min", "lat_min", "lon_max", "lat_max"]
    return assign.assign_best_scene(bounded(spark, d), footed(spark, d), keep=["x0", "y0", "x1", "y1"], extra=[*box, "epsg", "res"])


@query
def clip_bounds(spark, d):
    pairs = bounds_to_utm(assign.native_extents(best_pairs(spark, d)), "x0", "y0", "x1", "y1", "epsg", "p")
    clip = geometry.clip_bounds(*[F.col(c) for c in ("px0", "py0", "px1", "py1", "nx0", "ny0", "nx1", "ny1")])
    return pairs.withColumn("c", clip).select(
        "field_id", "scene_id", *[r(F.col("c")[k], 3).alias(f"c{k}") for k in ("x0", "y0", "x1", "y1")]
    )


@query
def pixel_windows(spark, d):
    win = geometry.pixel_window(
        *[F.col(c) for c in ("x0", "y0", "x1", "y1")],
        F.col("lon_min"), F.col("lat_max"), F.lit(DEGREE_RES), F.lit(DEGREE_SIDE), F.lit(DEGREE_SIDE),
    )
    return best_pairs(spark, d).withColumn("w", win).select("field_id", "scene_id", "w.*")


# --- chips ----------------------------------------------------------------------------------


@query
def min_pixels(spark, d):
    return filters.filter_min_pixels(fx.obs(spark, d), 3)


@query
def min_pixels_multires(spark, d):
    return filters.filter_min_pixels_multires(fx.obs(spark, d), 3)


@query
def window_report(spark, d):
    return chip_ops.window_report(fx.obs(spark, d), fx.fields(spark, d), OBS_BANDS, len(DATE_WINDOWS), min_px=2)


@query
def stack_bands(spark, d):
    return chip_ops.stack_bands(fx.obs(spark, d), ["B04", "B08"]).withColumn("px", joined(F.col("px")))


@query
def resize_bilinear(spark, d):
    small = chip_ops.resize_bilinear(fx.obs(spark, d).select("field_id", "window_idx", "band", "h", "w", "px"), 4)
    return small.select("field_id", "window_idx", "band", joined(F.col("px"), 10000).alias("px"))


@query
def multitemporal_stack(spark, d):
    labelled = indexed(spark, d).select("field_id", "class_idx")
    chips = chip_ops.multitemporal_chips(
        fx.obs(spark, d), OBS_BANDS, len(DATE_WINDOWS), size=4, min_px=2, labels=labelled
    )
    return chips.withColumn("px", joined(F.col("px"), 10000))


@query
def clip_tiles(spark, d):
    clipped = chip_ops.clip_tiles(fx.tiles(spark, d), scene_io.AOI_PRESETS["fergana"])
    return chip_ops.explode_chips(clipped.select("scene_id", "row_off", "col_off", "c", "h", "w", "px")).select(
        "scene_id", (F.col("y") + F.col("row_off")).alias("y"), (F.col("x") + F.col("col_off")).alias("x"), "dn"
    )


WINDOW_MARGIN, BLOCK_SIZE = 0.3, 5


@query
def field_windows(spark, d):
    """Assigned fields with a margin, cut from two-band scene rasters stored as blocks."""
    pairs = best_pairs(spark, d)
    grown = [F.col(c) + s * WINDOW_MARGIN for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))]
    side = F.lit(fx.TILE_SIZE)
    window = geometry.pixel_window(*grown, F.col("lon_min"), F.col("lat_max"), F.lit(fx.TILE_RES), side, side)
    windows = pairs.select("field_id", "scene_id", window.alias("w")).select("field_id", "scene_id", "w.*")
    bands = F.array(
        F.struct(F.lit("B04").alias("band"), F.col("px").alias("px")),
        F.struct(F.lit("B08").alias("band"), F.transform("px", lambda v: v * 3 % 10000).alias("px")),
    )
    rasters = fx.tiles(spark, d).select("scene_id", "h", "w", F.inline(bands))
    cut = chip_ops.cut_windows(windows, chip_ops.to_blocks(rasters, BLOCK_SIZE), BLOCK_SIZE)
    return cut.withColumn("px", joined(F.col("px")))


PER_CLASS, BUILD_SIZE, BUILD_COARSE = 500, 4, 0.015
SINGLE_BANDS, WINDOW_BANDS = ["B04", "B08", "B12"], ["B04", "B08", "B11"]


def resolutions(bands: list[str]) -> dict[str, float]:
    return {b: res for _, b, res in fx.RASTER_BANDS if b in bands}


def stored_blocks(spark: SparkSession, d: str, bands: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A reader of the scenes' rasters: the blocks at the places wanted, stored and read
    back by key. All rasters would be gigabytes per thousand scenes, of which windows meet few."""

    def read(places: DataFrame) -> DataFrame:
        path = scratch_path(spark, "blocks")
        rasters.write_blocks(fx.raster_blocks(spark, d, bands, places), path)
        return rasters.read_blocks(spark, path, bands)

    return read


@query
def build_chips_single(spark, d):
    """Districts, sample, best scene, complete scenes, windows cut from blocks, one joint resize."""
    rows = labelled_fields(fx.fields(spark, d), n_per_region=3, per_class=PER_CLASS, seed=SEED)
    chips = build.build_chips_single(
        rows, footed(spark, d), stored_blocks(spark, d, SINGLE_BANDS), resolutions(SINGLE_BANDS), BUILD_SIZE, fx.RASTER_BLOCK, min_px=2
    )
    return chips.withColumn("px", joined(F.col("px"), 10000))


@query
def build_chips_windows(spark, d):
    """Districts, sample, best scene per date window, complete scenes, windows cut from blocks, stack."""
    rows = labelled_fields(fx.fields(spark, d), n_per_region=3, per_class=PER_CLASS, seed=SEED)
    chips = build.build_chips_windows(
        rows, footed(spark, d), stored_blocks(spark, d, WINDOW_BANDS), resolutions(WINDOW_BANDS), DATE_WINDOWS, BUILD_SIZE, fx.RASTER_BLOCK,
        min_px=2, max_missing=2, coarse_res=BUILD_COARSE,
    )
    return chips.withColumn("px", joined(F.col("px"), 10000))


@query
def build_resumed(spark, d):
    """The single-window build, stopped after some districts and resumed."""
    path = scratch_path(spark, "districts")
    rows = checkpointed(labelled_fields(fx.fields(spark, d), n_per_region=3, per_class=PER_CLASS, seed=SEED), spark, "labelled")
    blocks, scenes = stored_blocks(spark, d, SINGLE_BANDS), footed(spark, d)

    def make(some: DataFrame) -> DataFrame:
        return build.build_chips_single(some, scenes, blocks, resolutions(SINGLE_BANDS), BUILD_SIZE, fx.RASTER_BLOCK, min_px=2)

    build.build_in_steps(rows, make, path, per_step=8, max_steps=1)
    build.build_in_steps(rows, make, path, per_step=8)
    chips = chip_io.read_finished(spark, path)
    return chips.withColumn("px", joined(F.col("px"), 10000))


@query
def band_stats_merged(spark, d):
    """Statistics from stored sums, to which the second set's districts are added later."""
    path = scratch_path(spark, "moments")
    one, two = fx.chip_sets(spark, d)
    stats.store_moments(one, path)
    return stats.merged_stats(stats.store_moments(chip_io.union_chips(one, two), path)).withColumns({"mean": r("mean"), "std": r("std")})


@query
def select_task(spark, d):
    tasks = fx.table(spark, d, "supplier").select(F.concat(F.col("s_nationkey"), F.lit("-crop")).alias("task_id"), "s_suppkey")
    return chip_ops.select_task(tasks, "1-c")


@query
def metrics_sink(spark, d):
    path = scratch_path(spark, "metrics")
    scoring.write_metrics(scoring.scores(predicted(spark, d), K), path)
    return spark.read.schema("name string, value double").json(path).withColumn("value", r("value"))


@query
def band_stats_sink(spark, d):
    path = scratch_path(spark, "band-stats")
    stats.write_band_stats(stats.band_stats(fx.chips(spark, d)), path)
    return spark.read.parquet(path).withColumns({"mean": r("mean"), "std": r("std")})


@query
def union_chips(spark, d):
    one, two = fx.chip_sets(spark, d)
    return chip_io.union_chips(one, two, one).groupBy("tuman_code").agg(F.count(F.lit(1)).alias("chips"), F.count("class_idx").alias("labelled"))


@query
def ndvi(spark, d):
    px = F.col("px")
    index = fx.chips(spark, d).withColumn("px", arrays.ndvi(arrays.channel(px, 3), arrays.channel(px, 2)))
    return long_values(index).drop("c")


@query
def ndvi_channel(spark, d):
    return long_values(chip_ops.add_ndvi(fx.chips(spark, d), CHIP_BANDS))


@query
def series_to_grid(spark, d):
    return chip_ops.series_to_grid(fx.series(spark, d))


@query
def chips_roundtrip(spark, d):
    path = scratch_path(spark, "chips")
    chip_io.write_chips(chip_io.combine_chips(*fx.chip_sets(spark, d)), path)
    pixels = chip_ops.explode_chips(chip_io.read_chips(spark, path))
    keys = ("tuman_code", "chip_id", "class_idx")
    return chip_ops.explode_chips(chip_ops.collect_chips(pixels, keys))


@query
def synthetic_chips(spark, d):
    ids = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("chip_id"))
    made = chip_io.synthetic_chips(ids, k=K, seed=SEED)
    return long_values(made).join(made.select("chip_id", "class_idx"), "chip_id")


@query
def combine_districts(spark, d):
    return chip_io.combine_chips(*fx.chip_sets(spark, d)).select(
        "tuman_code", "chip_id", "class_idx", F.aggregate("px", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("dn_sum")
    )


@query
def combine_report(spark, d):
    return regions.combine_report(chip_io.combine_chips(*fx.chip_sets(spark, d)))


@query
def chip_quality(spark, d):
    return stats.check_chips(fx.dirty_chips(spark, d), K, 4)


@query
def band_stats(spark, d):
    return stats.band_stats(fx.chips(spark, d)).withColumns({"mean": r("mean"), "std": r("std")})


@query
def band_stats_sampled(spark, d):
    return stats.band_stats_sampled(fx.chips(spark, d), 200, SEED).withColumns({"mean": r("mean"), "std": r("std")})


@query
def chip_features(spark, d):
    return stats.chip_features(fx.chips(spark, d)).select(
        "chip_id", "class_idx", F.posexplode("features").alias("i", "v")
    ).withColumn("v", r("v"))


# --- transforms -------------------------------------------------------------------------------


@query
def val_transform(spark, d):
    return long_values(fx.chips(spark, d).transform(transforms.val_transforms(MEAN, STD)))


@query
def train_transform(spark, d):
    return long_values(fx.chips(spark, d).transform(transforms.train_transforms(MEAN, STD, SEED)))


@query
def augment_flips(spark, d):
    return long_values(fx.chips(spark, d).transform(transforms.compose(transforms.hflip(0.5, SEED), transforms.vflip(0.5, SEED))), "dn")


@query
def augment_rot90(spark, d):
    return long_values(fx.chips(spark, d).transform(transforms.rot90(SEED)), "dn")


@query
def augment_jitter(spark, d):
    return long_values(fx.chips(spark, d).transform(transforms.spectral_jitter(0.1, 0.1, SEED)))


@query
def augment_noise(spark, d):
    return long_values(fx.chips(spark, d).transform(transforms.gaussian_noise(0.01, SEED)))


@query
def custom_transform(spark, d):
    return long_values(chip_ops.apply_transform(fx.chips(spark, d), lambda a: a * 2))


# --- splits and scores ------------------------------------------------------------------------


@query
def split_assign(spark, d):
    return splits.assign_split(fx.chips(spark, d), 0.15, 0.15, SEED)


@query
def split_external(spark, d):
    chips = fx.chips(spark, d).select("chip_id", fx.district_of(F.col("chip_id")).alias("tuman_code"))
    east = F.col("tuman_code") >= 1700220
    return splits.assign_split_external(chips.where(~east), chips.where(east), 0.15, SEED)


@query
def batch_plan(spark, d):
    return splits.assign_batches(splits.assign_split(fx.chips(spark, d), 0.15, 0.15, SEED), 32, SEED)


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_prediction(fx.predictions(spark, d))


@query
def predict_argmax(spark, d):
    return predicted(spark, d).select("chip_id", "label", "pred")


@query
def confusion_matrix(spark, d):
    return scoring.confusion(predicted(spark, d), K)


@query
def confusion_pct(spark, d):
    return scoring.confusion_pct(predicted(spark, d), K + 1).withColumn("share", r("share"))


@query
def accuracy(spark, d):
    return scoring.accuracy(predicted(spark, d)).withColumn("accuracy", r("accuracy"))


@query
def macro_scores(spark, d):
    return scoring.macro_scores(predicted(spark, d), K + 1).select(
        r("macro_accuracy").alias("macro_accuracy"), r("macro_f1").alias("macro_f1")
    )


@query
def ce_loss(spark, d):
    return scoring.ce_loss(predicted(spark, d), [0.5, 1.0, 2.0], 0.1).withColumn("loss", r("loss"))


@query
def class_weights(spark, d):
    return scoring.class_weights(fx.chips(spark, d), K).withColumn("weight", r("weight"))


@query
def best_epoch(spark, d):
    return scoring.best_epoch(fx.history(spark, d))


@query
def early_stop(spark, d):
    return scoring.early_stop(fx.history(spark, d), 10)


# --- model and stream ---------------------------------------------------------------------------


@query
def baseline_eval(spark, d):
    return train_and_score(spark, fx.chips(spark, d), K, seed=SEED).withColumn("value", r("value", 5))


@query
def normal_eval(spark, d):
    return train_and_score(spark, fx.chips(spark, d), K, seed=SEED, model="normal").withColumn("value", r("value", 5))


LINEAR = ([[0.002, -0.001, 0.0005, 0.0, 0.001, 0.0, -0.002, 0.001], [0.0, 0.001, 0.001, -0.001, 0.0, 0.002, 0.0, -0.001], [-0.001, 0.0, 0.0, 0.002, -0.001, 0.0, 0.001, 0.0]], [0.5, -0.25, 0.0])


@query
def predict_linear(spark, d):
    found = ml.linear_predict(stats.chip_features(fx.chips(spark, d)), *LINEAR)
    return found.select("chip_id", "label", "pred", *[r(F.col("logits")[i], 5).alias(f"z{i}") for i in range(K)])


@query
def stream_intake(spark, d):
    items = fx.scenes(spark, d).select("scene_id", "scene_k", "datetime", "cloud_cover")
    source, out, state = (scratch_path(spark, label) for label in ("arrivals", "intake", "intake-state"))
    processed = items.where(F.col("scene_k") % 5 == 0)
    # A catalogue lists its newer scenes, then a third of them again, then the
    # older ones. The second run resumes the first one's state; the last starts
    # from none over the same sink and sees every listing once more.
    newer = F.col("datetime") >= F.lit("2025-06-15").cast("timestamp")
    fresh = scratch_path(spark, "intake-state")
    for listing, at in ((items.where(newer), state), (items.where(newer & (F.col("scene_k") % 3 == 0)), state), (items.where(~newer), fresh)):
        listing.write.mode("append").parquet(source)
        intake(scene_stream(spark, source, items.schema), 20.0, processed, out, at).awaitTermination()
    return read_intake(spark, out, items.schema).select("scene_id", "cloud_cover")
