"""Channel statistics, dataset checks and chip features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from furrow.functions.arrays import REFLECTANCE_SCALE, plane
from furrow.functions.hashing import key_hash
from furrow.operators.chips import explode_chips
from furrow.operators.ranking import shuffled_rank


def pixel_moments(chips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, sum and sum of squares of the pixels per channel (and ``by``), as whole
    numbers: tables of them can be added up in any order. The sums are combined before
    the shuffle, which then moves one row per channel and task."""
    dn = F.col("dn").cast("bigint")
    # Squares are summed as decimals: at 1e8 per pixel a bigint holds 9e10 pixels.
    return (
        explode_chips(chips.select(*by, "c", "h", "w", "px"))
        .groupBy(*by, "c")
        .agg(F.sum(dn).alias("s"), F.sum((dn * dn).cast("decimal(18,0)")).alias("q"), F.count(F.lit(1)).alias("pixels"))
    )


def merged_stats(moments: DataFrame, scale: float = REFLECTANCE_SCALE) -> DataFrame:
    """Mean and population standard deviation per channel from ``pixel_moments``."""
    sums = moments.groupBy("c").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("pixels").alias("pixels"))
    mean = F.col("s").cast("double") / F.col("pixels")
    var = F.col("q").cast("double") / F.col("pixels") - mean * mean
    return sums.select(
        "c", "pixels", (mean / scale).alias("mean"), (F.sqrt(F.greatest(var, F.lit(0.0))) / scale).alias("std")
    )


def band_stats(chips: DataFrame, scale: float = REFLECTANCE_SCALE) -> DataFrame:
    """Mean and population standard deviation per channel, over all pixels.

    Sums integers and divides once, so the result does not depend on the order
    of addition.
    """
    return merged_stats(pixel_moments(chips), scale)


def store_moments(chips: DataFrame, path: str, by: str = "tuman_code") -> DataFrame:
    """Add the moments of the districts that ``path`` does not hold yet and return all.

    Pixels of stored districts are not read again: they are left out by the partition
    filter of the chip set. Each district is one folder that is written as a whole, so
    a run that is repeated after a failure replaces its own rows.
    """
    spark = chips.sparkSession
    schema = f"{by} int, c int, s bigint, q decimal(38,0), pixels bigint"
    empty = spark.createDataFrame([], schema)
    empty.write.mode("append").partitionBy(by).parquet(path)
    stored = lambda: spark.read.schema(schema).parquet(path)
    done = [r[by] for r in stored().select(by).distinct().collect()]  # one number per district
    fresh = chips.where(~F.col(by).isin(done) | F.col(by).isNull()) if done else chips
    sums = pixel_moments(fresh, [by]).select(F.col(by).cast("int").alias(by), F.col("c").cast("int").alias("c"), "s", F.col("q").cast("decimal(38,0)").alias("q"), "pixels")
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return stored()


def sample_chips(chips: DataFrame, n: int, seed: int) -> DataFrame:
    """min(n, N) random chips without replacement.

    Only ids are ranked, to find the last one drawn; every chip then knows from
    its own id whether it comes before that, so the pixels are read once and
    neither joined nor shuffled.
    """
    ranked = shuffled_rank(chips.select("chip_id"), "chip_id", seed, first=n).where(F.col("rank") < n)
    place = F.struct(key_hash(F.col("chip_id"), seed).alias("digest"), F.col("chip_id").alias("id"))
    last = ranked.agg(F.max(place).alias("p")).first()["p"]  # one row
    if last is None:
        return chips.limit(0)
    return chips.where(place <= F.struct(F.lit(last["digest"]).alias("digest"), F.lit(last["id"]).alias("id")))


def band_stats_sampled(chips: DataFrame, n: int = 5000, seed: int = 42, scale: float = REFLECTANCE_SCALE) -> DataFrame:
    return band_stats(sample_chips(chips, n, seed), scale)


def stats_lists(stats: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and std per channel as arguments for ``normalize``. One row per
    channel comes to the driver."""
    rows = stats.orderBy("c").select("mean", "std").collect()
    return [r["mean"] for r in rows], [r["std"] for r in rows]


def write_band_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)


def check_chips(chips: DataFrame, k: int, channels: int) -> DataFrame:
    """One row of defect counts. ``channel_mismatch`` is a warning only."""
    sized = F.size("px") == F.col("c") * F.col("h") * F.col("w")
    has_px = F.col("px").isNotNull()
    return chips.agg(
        F.count(F.lit(1)).alias("chips"),
        F.count_if(~has_px).alias("no_image"),
        F.count_if(F.col("class_idx").isNull()).alias("no_label"),
        F.count_if(has_px & ~sized).alias("bad_shape"),
        F.count_if(F.col("class_idx") >= k).alias("label_too_large"),
        F.count_if(F.col("class_idx") < 0).alias("label_negative"),
        F.count_if(F.col("c") != channels).alias("channel_mismatch"),
    )


def require_valid(chips: DataFrame, k: int) -> DataFrame:
    """Chips unchanged; running it fails on the first chip that breaks a check."""
    good = (
        F.col("px").isNotNull()
        & F.col("class_idx").isNotNull()
        & (F.size("px") == F.col("c") * F.col("h") * F.col("w"))
        & F.col("class_idx").between(0, k - 1)
    )
    message = F.concat(F.lit("invalid chip "), F.col("chip_id").cast("string"))
    return chips.withColumn("px", F.when(F.coalesce(good, F.lit(False)), F.col("px")).otherwise(F.raise_error(message)))


def chip_features(chips: DataFrame) -> DataFrame:
    """Mean and population std per channel of each chip, as one array
    (means first). Computed inside the row; nothing is shuffled."""

    def one(i):
        part = F.slice("px", i * plane() + 1, plane())
        n = plane().cast("double")
        total = F.aggregate(part, F.lit(0).cast("bigint"), lambda a, v: a + v.cast("bigint"))
        squares = F.aggregate(part, F.lit(0).cast("bigint"), lambda a, v: a + v.cast("bigint") * v.cast("bigint"))
        mean = total.cast("double") / n
        var = squares.cast("double") / n - mean * mean
        return F.struct(mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))

    per = F.transform(F.sequence(F.lit(0), F.col("c") - 1), one)
    return chips.withColumn("_s", per).select(
        "chip_id",
        "class_idx",
        F.concat(F.transform("_s", lambda s: s["mean"]), F.transform("_s", lambda s: s["std"])).alias("features"),
    )
