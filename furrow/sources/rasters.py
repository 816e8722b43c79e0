"""Rasters stored as square blocks.

One row is one block of one band of one scene: ``scene_id, band, br, bc, bh, bw,
px`` with the block's row and column in the raster, its size and its pixels,
row-major. No row holds a whole raster, so a scene of any size is many small rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

PLACE = ("scene_id", "band", "br", "bc")


def blocks_from_strips(strips: DataFrame, size: int) -> DataFrame:
    """Strips of rasters (``scene_id, band, y0, h, w, px``: ``h`` whole lines from line
    ``y0`` on), as image files hold them, -> blocks of ``size`` pixels, smaller at the
    right and lower edge. A group is one block."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int")))
    y0, h, w = F.col("y0"), F.col("h"), F.col("w")
    pieces = strips.withColumn("br", span(y0, y0 + h - 1)).withColumn("bc", span(F.lit(0), w - 1))
    top, left = F.col("br") * size, F.col("bc") * size
    width = F.least(F.lit(size), w - left)
    line = F.transform(
        F.sequence(F.greatest(y0, top), F.least(y0 + h, top + size) - 1),
        lambda y: F.struct(y.alias("y"), F.slice("px", (y - y0) * w + left + 1, width).alias("px")),
    )
    lines = pieces.select("scene_id", "band", "br", "bc", width.alias("bw"), F.explode(line).alias("l"))
    blocks = lines.groupBy("scene_id", "band", "br", "bc", "bw").agg(F.array_sort(F.collect_list("l")).alias("_l"))
    return blocks.select(*PLACE, F.size("_l").alias("bh"), "bw", F.flatten(F.transform("_l", lambda v: v["px"])).alias("px"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Store blocks sorted by place, so that a reader of some scenes and bands skips
    the row groups of all others."""
    blocks.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).write.parquet(path)


def read_blocks(spark: SparkSession, path: str, bands: Sequence[str] = ()) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("band").isin(*bands)) if bands else rows
