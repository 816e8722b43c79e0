"""District selection, class tables and samples."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window, functions as F

from furrow.functions.geometry import is_polygon_wkt
from furrow.functions.hashing import key_hash
from furrow.functions.labels import strip
from furrow.operators.filters import with_bounds
from furrow.operators.ranking import shuffled_rank


def district_counts(fields: DataFrame) -> DataFrame:
    """Polygons per district that has a code, by region, largest first."""
    return (
        fields.where(F.col("tuman_code").isNotNull())
        .groupBy("viloyat", "tuman", "tuman_code")
        .agg(F.count(F.lit(1)).alias("polygons"))
        .orderBy(F.asc_nulls_first("viloyat"), F.desc("polygons"), "tuman_code")
    )


def top_districts(counts: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` largest districts per region.

    The region is the trimmed name ("unknown" when missing or empty), but the
    order inside it is the input's: raw name first, then size. The rank limit
    is applied map-side as well, so at most ``n`` rows per region and task
    reach the shuffle.
    """
    raw = F.when(F.col("viloyat") == "", None).otherwise(F.col("viloyat"))
    region = strip(F.coalesce(raw, F.lit("unknown")))
    order = Window.partitionBy("region").orderBy(F.asc_nulls_first("viloyat"), F.desc("polygons"), "tuman_code", "tuman")
    return counts.withColumn("region", region).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def pending_districts(selected: DataFrame, done: DataFrame) -> DataFrame:
    """Selected districts that have not been processed yet."""
    return selected.join(done.select("tuman_code"), "tuman_code", "left_anti")


def select_districts(fields: DataFrame, selected: DataFrame) -> DataFrame:
    """Fields of the selected districts."""
    return fields.join(selected.select("tuman_code").distinct(), "tuman_code", "left_semi")


def class_distribution(df: DataFrame, label_col: str = "crop_type") -> DataFrame:
    """Rows and percentage per class. The total is a window over the class
    counts, which are already one row per class."""
    return (
        df.groupBy(label_col)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))
        .orderBy(F.desc("n"), label_col)
    )


def class_index(df: DataFrame, label_col: str = "crop_type") -> DataFrame:
    """Class table: sorted distinct names -> 0..K-1."""
    return (
        df.where(F.col(label_col).isNotNull())
        .select(label_col)
        .distinct()
        .withColumn("class_idx", (F.row_number().over(Window.orderBy(label_col)) - 1).cast("int"))
    )


def with_class_idx(df: DataFrame, classes: DataFrame, label_col: str = "crop_type") -> DataFrame:
    """Attach the class index; rows without a known class are dropped.

    Pass a stored class table: Spark then knows its size before it plans, and
    sends it to the rows when it is small (the usual case) but not otherwise.
    Computed on the fly, its size is unknown and the rows would be shuffled by
    label, which has few values.
    """
    return df.join(classes, label_col, "inner")


# Ranks up to this are cut before the shuffle (Spark's own default).
MAP_SIDE_RANKS = 1000


def sample_per_class(
    df: DataFrame, n: int, seed: int = 0, label_col: str = "crop_type", id_col: str = "field_id"
) -> DataFrame:
    """At most ``n`` random rows per class, without replacement (0 = all): those with
    the smallest hash of id and seed.

    Rows without a label are a class of their own. Each task keeps the ``n`` smallest
    of every class before the one shuffle, so a class that holds most rows brings at
    most ``n`` per task to the merge. A larger ``n`` ranks the class in hash buckets,
    so that none sits in one task.
    """
    if n <= 0:
        return df
    if n <= MAP_SIDE_RANKS:
        smallest = Window.partitionBy(label_col).orderBy("_digest", id_col)
        hashed = df.withColumn("_digest", key_hash(F.col(id_col), seed))
        return hashed.withColumn("_rank", F.row_number().over(smallest)).where(F.col("_rank") <= n).select(*df.columns)
    keyed = df.withColumns({"_null": F.col(label_col).isNull(), "_class": F.coalesce(F.col(label_col).cast("string"), F.lit(""))})
    ranked = shuffled_rank(keyed, id_col, seed, group=["_null", "_class"], rank="_rank", size="_size", first=n)
    return ranked.where(F.col("_rank") < n).select(*df.columns)


def extent(fields: DataFrame) -> DataFrame:
    """Overall bounds of all polygons; nulls when there are none."""
    return fields.agg(
        F.min("x0").alias("lon_min"), F.min("y0").alias("lat_min"), F.max("x1").alias("lon_max"), F.max("y1").alias("lat_max")
    )


def geometry_skips(fields: DataFrame, geom_col: str = "geom_2", label_col: str = "crop_type") -> DataFrame:
    """Why rows are left out of an export, with counts."""
    reason = (
        F.when(F.col(geom_col).isNull(), "no_geometry")
        .when(F.col(label_col).isNull(), "no_label")
        .when(~is_polygon_wkt(F.col(geom_col)), "unparseable")
        .when(F.col("x0").isNull(), "exported_empty")
        .otherwise("exported")
    )
    return with_bounds(fields, geom_col).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def combine_report(chips: DataFrame, source: str = "tuman_code") -> DataFrame:
    """Chips and shape per source plus a total row (source null)."""
    return chips.rollup(source).agg(
        F.count(F.lit(1)).alias("chips"),
        F.max("c").alias("channels"),
        F.max("h").alias("height"),
        F.max("w").alias("width"),
    )
