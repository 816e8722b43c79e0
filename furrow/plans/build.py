"""The two end-to-end plans: building a chip set and training on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from furrow.functions.geometry import pixel_window
from furrow.operators import assign, chips as chip_ops, filters, regions, stats
from furrow.operators.ml import class_moments, evaluate_model, gaussian_predict, linear_predict, train_baseline, train_linear
from furrow.operators.scoring import class_weights, scores
from furrow.operators.splits import assign_split
from furrow.session import checkpointed
from furrow.sources import chips as chip_io
from furrow.sources.fields import exportable
from furrow.sources.scenes import complete_scenes


def labelled_fields(
    fields: DataFrame, n_per_region: int = 3, per_class: int = 0, seed: int = 0, done: DataFrame | None = None
) -> DataFrame:
    """Fields of the chosen districts with normalised label, bounds and class.

    One plan for all districts: the district is a column, not a loop, and one
    class table serves all of them.
    """
    selected = regions.top_districts(regions.district_counts(fields), n_per_region)
    if done is not None:
        selected = regions.pending_districts(selected, done)
    rows = exportable(regions.select_districts(fields, selected))
    if per_class:
        rows = rows.withColumn("_group", F.concat_ws(":", F.col("tuman_code"), F.col("crop_type")))
        rows = regions.sample_per_class(rows, per_class, seed, label_col="_group").drop("_group")
        rows = checkpointed(rows, rows.sparkSession, "sample")  # read for its classes and for its rows
    classes = checkpointed(regions.class_index(rows), rows.sparkSession, "classes")
    return regions.with_class_idx(filters.with_bounds(rows), classes)


def build_chips(
    fields: DataFrame,
    scenes: DataFrame,
    obs: DataFrame,
    windows: Sequence[tuple[str, str]],
    bands: Sequence[str],
    size: int,
    cloud_max: float = 20.0,
    min_px: int = 4,
    max_missing: int = 1,
) -> DataFrame:
    """Labelled fields -> multi-window chips.

    ``obs`` holds the pixel windows per field and date window; only those with
    a scene that owns all bands take part.
    """
    best = assign.assign_best_scene_windows(fields, scenes, windows, cloud_max)
    owners = complete_scenes(scenes, bands).select("scene_id")
    usable = best.join(owners, "scene_id", "left_semi").select("field_id", "window_idx")
    labels = fields.select("field_id", "tuman_code", "class_idx")
    chips = chip_ops.multitemporal_chips(
        obs, bands, len(windows), size, min_px, max_missing, labels=labels, usable=usable
    )
    return chips.withColumnRenamed("field_id", "chip_id")


FIELD_BOX = ("x0", "y0", "x1", "y1")
SCENE_BOX = ("lon_min", "lat_min", "lon_max", "lat_max")


def band_windows(pairs: DataFrame, resolutions: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """Pixel window of each field in each band of its scene, on the band's own grid,
    which starts at the upper left corner of the scene's box: ``keys, scene_id, band,
    res, col_off, row_off, width, height``."""
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(float(res)).alias("res")) for b, res in resolutions.items()])
    rows = pairs.select(*keys, "scene_id", *FIELD_BOX, *SCENE_BOX, F.inline(bands))
    side = lambda lo, hi: F.round((F.col(hi) - F.col(lo)) / F.col("res"))
    window = pixel_window(
        *[F.col(c) for c in FIELD_BOX], F.col("lon_min"), F.col("lat_max"), F.col("res"), side("lon_min", "lon_max"), side("lat_min", "lat_max")
    )
    return rows.select(*keys, "scene_id", "band", "res", window.alias("_w")).select(*keys, "scene_id", "band", "res", "_w.*")


def build_chips_single(
    fields: DataFrame,
    scenes: DataFrame,
    blocks: chip_ops.Blocks,
    resolutions: dict[str, float],
    size: int,
    block_size: int,
    cloud_max: float = 20.0,
    min_px: int = 4,
) -> DataFrame:
    """Labelled fields -> one chip each, from the least cloudy scene.

    A field whose scene lacks a band is left out and not given another scene, and so
    is one whose window is under ``min_px`` in any band or differs in size between
    bands. All bands are stacked at native size and resized together. ``blocks`` are
    the stored rasters or a reader of them by place; ``resolutions`` names the bands, in channel order.
    """
    best = assign.assign_best_scene(fields, scenes, cloud_max, keep=FIELD_BOX, extra=SCENE_BOX)
    usable = best.join(complete_scenes(scenes, list(resolutions)).select("scene_id"), "scene_id", "left_semi")
    windows = band_windows(usable, resolutions, ["field_id"])
    # Windows that cannot become a chip are left before any pixel is read.
    windows = windows.where((F.col("width") >= min_px) & (F.col("height") >= min_px))
    cut = chip_ops.cut_windows(windows, blocks, block_size)
    stacked = chip_ops.stack_bands(cut, list(resolutions), ["field_id"]).join(fields.select("field_id", "tuman_code", "class_idx"), "field_id")
    chips = chip_ops.resize_bilinear(stacked, size)
    return chips.select(F.col("field_id").alias("chip_id"), "tuman_code", "class_idx", "c", "h", "w", "px")


def build_chips_windows(
    fields: DataFrame,
    scenes: DataFrame,
    blocks: chip_ops.Blocks,
    resolutions: dict[str, float],
    windows: Sequence[tuple[str, str]],
    size: int,
    block_size: int,
    cloud_max: float = 20.0,
    min_px: int = 4,
    max_missing: int = 1,
    coarse_res: float = filters.COARSE_RES,
) -> DataFrame:
    """Labelled fields -> multi-window chips, cut from the stored rasters of the least
    cloudy scene per date window. A window whose scene lacks a band counts as missing."""
    best = assign.assign_best_scene_windows(fields, scenes, windows, cloud_max, keep=FIELD_BOX, extra=SCENE_BOX)
    usable = best.join(complete_scenes(scenes, list(resolutions)).select("scene_id"), "scene_id", "left_semi")
    wanted = band_windows(usable, resolutions, ["field_id", "window_idx"])
    obs = chip_ops.cut_windows(wanted, blocks, block_size, ["field_id", "window_idx", "res"])
    labels = fields.select("field_id", "tuman_code", "class_idx")
    chips = chip_ops.multitemporal_chips(obs, list(resolutions), len(windows), size, min_px, max_missing, coarse_res=coarse_res, labels=labels)
    return chips.withColumnRenamed("field_id", "chip_id")


def build_in_steps(
    fields: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, per_step: int = 20, max_steps: int | None = None
) -> int:
    """Build the chips of all districts of labelled ``fields`` that ``path`` has not
    finished, some districts at a time, and return the number of steps taken.

    ``make`` turns fields into chips with ``tuman_code``. A build that stops, after
    ``max_steps`` or by failure, goes on where it was: finished districts are left as
    they are, and a half-written one is written anew. Classes must be those of all
    fields, not of one step.
    """
    spark = fields.sparkSession
    todo = regions.pending_districts(fields.select("tuman_code").distinct(), chip_io.finished_districts(spark, path))
    codes = sorted(r["tuman_code"] for r in todo.collect())  # one number per district
    steps = [codes[at : at + per_step] for at in range(0, len(codes), per_step)][:max_steps]
    for step in steps:
        chips = make(fields.where(F.col("tuman_code").isin(step)))
        chip_io.commit_districts(chips, path, spark.createDataFrame([(c,) for c in step], "tuman_code int"))
    return len(steps)


def train_and_score(
    spark: SparkSession, chips: DataFrame, k: int, val: float = 0.15, test: float = 0.15, seed: int = 42, model: str = "linear"
) -> DataFrame:
    """Split, train a baseline with balanced classes, score the test split.

    ``linear`` is a weighted linear model per class by a fixed number of Newton steps,
    ``normal`` a normal distribution per class and feature, and ``optimised`` a joint
    logistic regression by an optimiser.
    """
    split = assign_split(chips, val, test, seed)
    feats = stats.chip_features(stats.require_valid(chips, k)).join(split.select("chip_id", "split"), "chip_id")
    # Training reads its rows many times; features are a few numbers per chip.
    feats = checkpointed(feats, spark, "features")
    train, held = feats.where(F.col("split") == "train"), feats.where(F.col("split") == "test")
    if model == "normal":
        moments = [(r["class_idx"], r["i"], r["mean"], r["var"]) for r in class_moments(train).collect()]  # classes x features
        return scores(gaussian_predict(held, moments, k), k)
    by_class = {r["class_idx"]: r["weight"] for r in class_weights(train, k).collect()}
    weights = [by_class.get(i, 0.0) for i in range(k)]
    if model == "linear":
        return scores(linear_predict(held, *train_linear(train, k, weights)), k)
    if model != "optimised":
        raise ValueError(f"no model {model!r}")
    return evaluate_model(train_baseline(train, weights), held, k)
