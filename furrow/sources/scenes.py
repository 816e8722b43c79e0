"""Scene catalogue: search, footprints, areas of interest, band files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from furrow.functions.geometry import BOX_RULES, bbox_error, boxes_touch, footprint
from furrow.functions.text import asset_name, asset_scene, parse_bbox
from furrow.operators.columns import with_computed

# Named areas of interest, WGS-84 lon_min, lat_min, lon_max, lat_max.
AOI_PRESETS = {
    "fergana": (70.60, 40.10, 72.90, 41.40),
    "tashkent": (68.80, 40.90, 69.80, 41.60),
    "samarkand": (66.50, 39.40, 67.40, 39.90),
}
DEFAULT_CLOUD_MAX = 20.0


def footprints(scenes: DataFrame) -> DataFrame:
    """Add ``lon_min..lat_max``; scenes without a footprint are dropped."""
    found = with_computed(scenes, {"_f": footprint(F.col("geometry"), F.col("bbox"))})
    return found.where(F.col("_f").isNotNull()).select(*scenes.columns, "_f.*")


def check_bbox(bbox: Sequence[float]) -> tuple[float, float, float, float]:
    """A box argument that keeps the rules of ``bbox_error``."""
    box = tuple(float(v) for v in bbox)
    broken = ["needs four values"] if len(box) != 4 else [message for message, rule in BOX_RULES if rule(*box)]
    if broken:
        raise ValueError(f"bbox {box}: {broken[0]}")
    return box


def in_date_range(ts: Column, d0: Column, d1: Column) -> Column:
    """Closed date range on a timestamp: the end date counts to its last instant.

    Written against the bare timestamp so that the Parquet reader can use it.
    """
    return (ts >= d0.cast("timestamp")) & (ts < F.date_add(d1, 1).cast("timestamp"))


def search_scenes(
    scenes: DataFrame,
    bbox: Sequence[float],
    d0: str,
    d1: str,
    cloud_max: float = DEFAULT_CLOUD_MAX,
    limit: int | None = None,
) -> DataFrame:
    """Scenes whose footprint touches the box, acquired in the closed date
    range, with cloud cover strictly below the maximum.

    Expects ``footprints``. Ordered by cloud cover and cut when limited.
    """
    x0, y0, x1, y1 = (F.lit(v) for v in check_bbox(bbox))
    day0, day1 = F.lit(date.fromisoformat(d0)), F.lit(date.fromisoformat(d1))
    found = scenes.where(
        (F.col("cloud_cover") < cloud_max)
        & in_date_range(F.col("datetime"), day0, day1)
        & boxes_touch(F.col("lon_min"), F.col("lat_min"), F.col("lon_max"), F.col("lat_max"), x0, y0, x1, y1)
    )
    return rank_scenes(found, limit) if limit else found


def rank_scenes(scenes: DataFrame, n: int | None = None) -> DataFrame:
    """Scenes by cloud cover, least first, optionally the first ``n``."""
    ordered = scenes.orderBy("cloud_cover", "scene_id")
    return ordered.limit(n) if n else ordered


def search_summary(found: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Dry run of a search: scenes, bands, files, first and last date."""
    return found.agg(
        F.count(F.lit(1)).alias("scenes"),
        F.lit(len(bands)).alias("bands"),
        (F.count(F.lit(1)) * len(bands)).alias("files"),
        F.min(F.to_date("datetime")).alias("first_date"),
        F.max(F.to_date("datetime")).alias("last_date"),
    )


def aoi_table(spark: SparkSession, custom: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """Named areas: the presets and any custom boxes."""
    rows = [(name, *check_bbox(box)) for name, box in {**AOI_PRESETS, **(custom or {})}.items()]
    return spark.createDataFrame(rows, "aoi string, ax0 double, ay0 double, ax1 double, ay1 double")


def resolve_aoi(name: str = "fergana", bbox: str | None = None) -> tuple[float, float, float, float]:
    """A preset by name, or a custom ``lon_min,lat_min,lon_max,lat_max`` text."""
    if bbox:
        return check_bbox([float(v) for v in bbox.split(",")])
    if name not in AOI_PRESETS:
        raise ValueError(f"unknown area {name!r}; one of {sorted(AOI_PRESETS)}")
    return AOI_PRESETS[name]


def scenes_per_aoi(scenes: DataFrame, areas: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """Scenes touching each named area. The areas are arguments, so they ride
    along as a constant array and no join is needed."""
    boxes = {**AOI_PRESETS, **(areas or {})}
    constant = F.array(
        *[
            F.struct(
                F.lit(name).alias("aoi"), *[F.lit(float(v)).alias(k) for k, v in zip(("ax0", "ay0", "ax1", "ay1"), check_bbox(box))]
            )
            for name, box in boxes.items()
        ]
    )
    return (
        scenes.select("scene_id", "cloud_cover", "lon_min", "lat_min", "lon_max", "lat_max", F.inline(constant))
        .where(
            boxes_touch(
                F.col("lon_min"), F.col("lat_min"), F.col("lon_max"), F.col("lat_max"),
                F.col("ax0"), F.col("ay0"), F.col("ax1"), F.col("ay1"),
            )
        )
        .groupBy("aoi")
        .agg(F.count(F.lit(1)).alias("scenes"), F.min("cloud_cover").alias("least_cloud"))
    )


def parse_aoi(df: DataFrame, col: str) -> DataFrame:
    """Typed boxes from text, with the reason a text is not a valid box."""
    parts = parse_bbox(F.col(col))
    df = df.withColumns({f"_p{i}": parts[i] for i in range(4)})
    error = F.when(F.col("_p0").isNull(), "expected four numbers").otherwise(
        bbox_error(F.col("_p0"), F.col("_p1"), F.col("_p2"), F.col("_p3"))
    )
    return df.withColumn("error", error).withColumnsRenamed(
        {"_p0": "lon_min", "_p1": "lat_min", "_p2": "lon_max", "_p3": "lat_max"}
    )


def complete_scenes(scenes: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Scenes that own every requested band."""
    return scenes.where(F.size(absent_bands(bands)) == 0)


def absent_bands(bands: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(b) for b in bands]), F.map_keys("assets"))


def missing_bands(scenes: DataFrame, bands: Sequence[str]) -> DataFrame:
    """One row per scene and requested band it does not own."""
    return scenes.select("scene_id", F.explode(absent_bands(bands)).alias("band"))


def group_assets(assets: DataFrame) -> DataFrame:
    """Band files per scene, sorted. The group is one scene's band files, so
    its size is set by the instrument and not by the data volume."""
    return (
        assets.select(asset_scene(F.col("path")).alias("scene_id"), "path")
        .groupBy("scene_id")
        .agg(F.array_sort(F.collect_set("path")).alias("paths"))
        .withColumn("n_files", F.size("paths"))
    )


def download_plan(scenes: DataFrame, bands: Sequence[str], manifest: DataFrame) -> DataFrame:
    """Files to fetch: scenes x bands, minus files that exist, with bands a
    scene does not own marked ``missing``."""
    wanted = F.explode(F.array(*[F.lit(b) for b in bands]))
    return (
        scenes.select("scene_id", "assets", wanted.alias("band"))
        .select(
            "scene_id",
            "band",
            asset_name(F.col("scene_id"), F.col("band")).alias("path"),
            F.col("assets")[F.col("band")].alias("href"),
        )
        .join(manifest.select("path"), "path", "left_anti")
        .withColumn("status", F.when(F.col("href").isNull(), "missing").otherwise("todo"))
    )


def download_summary(scenes: DataFrame, bands: Sequence[str], manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Counters of a fetch run: files wanted, there already, without an asset,
    fetched and failed (kept apart), and not reported."""
    wanted = scenes.select("scene_id", "assets", F.explode(F.array(*[F.lit(b) for b in bands])).alias("band")).select(
        "scene_id",
        asset_name(F.col("scene_id"), F.col("band")).alias("path"),
        F.col("assets")[F.col("band")].isNotNull().alias("owned"),
    )
    # A file is one row per source; one shuffle on the path brings them together.
    facts = (
        wanted.select("path", F.lit(True).alias("wanted"), "owned", F.lit(None).cast("boolean").alias("there"), F.lit(None).cast("boolean").alias("ok"))
        .unionByName(manifest.select("path", F.lit(True).alias("there")), allowMissingColumns=True)
        .unionByName(results.select("path", "ok"), allowMissingColumns=True)
        .groupBy("path")
        .agg(
            F.bool_or("wanted").alias("wanted"),
            F.bool_or("owned").alias("owned"),
            F.coalesce(F.bool_or("there"), F.lit(False)).alias("there"),
            F.bool_or("ok").alias("ok"),
        )
        .where("wanted")
    )
    new = F.col("owned") & ~F.col("there")
    return facts.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("there")).alias("already"),
        F.count_if(~F.col("there")).alias("remaining"),
        F.count_if(~F.col("owned") & ~F.col("there")).alias("missing"),
        F.count_if(new & F.col("ok")).alias("ok"),
        F.count_if(new & ~F.col("ok")).alias("failed"),
        F.count_if(new & F.col("ok").isNull()).alias("unreported"),
    )
