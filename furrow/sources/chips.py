"""Chip sets: persist, load, combine, and synthetic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from furrow.functions.hashing import hash_int, uniform

NOISE_MAX = 3000.0
OFFSET_MAX = 6000.0


def write_chips(chips: DataFrame, path: str, by: str = "tuman_code") -> None:
    """Parquet, one folder per district. The rebalance hint gathers a
    district's rows for few files and splits a district that is large."""
    chips.hint("rebalance", by).write.partitionBy(by).parquet(path)


def commit_districts(chips: DataFrame, path: str, districts: DataFrame, by: str = "tuman_code") -> None:
    """Store the chips of some districts and, after all of them, a marker per district.

    A district's folder is replaced as a whole, so rows of an attempt that died before
    its markers were written do not stay; other districts are not touched. A district
    without chips is marked too.
    """
    chips.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/rows")
    districts.select(F.col(by).cast("int").alias(by)).distinct().write.mode("append").parquet(f"{path}/finished")


def finished_districts(spark: SparkSession, path: str, by: str = "tuman_code") -> DataFrame:
    """The marked districts; none if nothing has been stored."""
    schema = f"{by} int"
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/finished")
    return spark.read.schema(schema).parquet(f"{path}/finished").distinct()


def read_finished(spark: SparkSession, path: str, by: str = "tuman_code") -> DataFrame:
    """The chips of marked districts."""
    return spark.read.parquet(f"{path}/rows").join(finished_districts(spark, path, by), by, "left_semi")


def read_chips(spark: SparkSession, path: str) -> DataFrame:
    """Load a chip set; a missing path raises ``AnalysisException``."""
    return spark.read.parquet(path)


def combine_chips(*sets: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """The labelled chips of several sets, optionally only of the selected
    districts. Chips carry their label, so no pixel is shuffled."""
    chips = union_chips(*sets).where(F.col("class_idx").isNotNull())
    if selection is not None:
        chips = chips.join(selection.select("tuman_code").distinct(), "tuman_code", "left_semi")
    return chips


def union_chips(*sets: DataFrame) -> DataFrame:
    """Bag union of chip sets with the same columns."""
    first, *rest = sets
    for other in rest:
        first = first.unionByName(other)
    return first


def synthetic_chips(ids: DataFrame, c: int = 4, size: int = 4, k: int = 3, seed: int = 0, id_col: str = "chip_id") -> DataFrame:
    """Labelled noise chips, one per id: uniform noise below 3000 plus an
    offset that grows evenly from 0 to 6000 over the classes. Every value comes
    from the id and the seed."""
    step = OFFSET_MAX / (k - 1) if k > 1 else 0.0
    label = (hash_int(F.col(id_col), seed, "label") % k).cast("int")
    labelled = ids.select(F.col(id_col).alias("chip_id"), label.alias("class_idx"))
    offset = F.col("class_idx") * F.lit(step)
    return labelled.select(
        "chip_id",
        "class_idx",
        F.lit(c).alias("c"),
        F.lit(size).alias("h"),
        F.lit(size).alias("w"),
        F.transform(
            F.sequence(F.lit(0), F.lit(c * size * size - 1)),
            lambda i: uniform(F.col("chip_id"), seed, i) * F.lit(NOISE_MAX) + offset,
        ).alias("px"),
    )
