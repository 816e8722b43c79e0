"""Labelled polygons: table scan, GeoJSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from furrow.functions.geometry import is_polygon_wkt, wkt_coordinates
from furrow.functions.labels import normalize_label
from furrow.sources.collections import SPLIT_BYTES, as_collections, read_features

_GEOMETRY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))),
    ]
)
_POLYGON = T.StructType([T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
# Geometries nest to different depths, so they are read as text first.
FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("geometry", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_fields(
    spark: SparkSession, path: str, geom_col: str = "geom_2", label_col: str = "crop_type", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Scan a label table; see ``labelled``."""
    return labelled(spark.read.parquet(path), geom_col, label_col, keep)


def labelled(df: DataFrame, geom_col: str = "geom_2", label_col: str = "crop_type", keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep geometry and label (and ``keep`` columns) of rows that have both."""
    return df.where(F.col(geom_col).isNotNull() & F.col(label_col).isNotNull()).select(*keep, geom_col, label_col)


def exportable(df: DataFrame, geom_col: str = "geom_2", label_col: str = "crop_type") -> DataFrame:
    """Rows that become features: both values present, geometry parseable
    (EMPTY parses), label normalised."""
    return labelled(df, geom_col, label_col, tuple(c for c in df.columns if c not in (geom_col, label_col))).where(
        is_polygon_wkt(F.col(geom_col))
    ).withColumn(label_col, normalize_label(F.col(label_col)))


def to_geojson_features(
    df: DataFrame, geom_col: str = "geom_2", label_col: str = "crop_type", properties: tuple[str, ...] = ()
) -> DataFrame:
    """One GeoJSON Feature struct per polygon, label normalised. The struct holds
    the coordinates of a Polygon as those of a MultiPolygon with one member."""
    names = [label_col, *properties]
    kind = F.when(F.col(geom_col).rlike(r"(?i)^\s*MULTI"), "MultiPolygon").otherwise("Polygon")
    return exportable(df, geom_col, label_col).select(
        F.lit("Feature").alias("type"),
        F.struct(kind.alias("type"), wkt_coordinates(F.col(geom_col)).alias("coordinates")).alias("geometry"),
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names])
        ).alias("properties"),
    )


def write_geojson(features: DataFrame, path: str, collection: bool = False) -> None:
    """One Feature per line, or one FeatureCollection, per task; nothing passes the driver."""
    kind, coordinates = F.col("geometry.type"), F.col("geometry.coordinates")
    none = F.expr("cast(array() as array<array<array<double>>>)")
    single = F.struct(kind.alias("type"), F.coalesce(F.get(coordinates, F.lit(0)), none).alias("coordinates"))
    text = F.when(kind == "Polygon", F.to_json(single)).otherwise(F.to_json("geometry"))
    parts = [F.lit('{"type":"Feature","geometry":'), F.coalesce(text, F.lit("null")), F.lit(',"properties":'), F.coalesce(F.to_json("properties"), F.lit("null")), F.lit("}")]
    lines = features.select(F.concat(*parts).alias("value"))
    (as_collections(lines) if collection else lines).write.text(path)


def parse_geometry(text: Column) -> Column:
    """GeoJSON text of a Polygon or MultiPolygon -> struct of type and MultiPolygon
    coordinates; null stays null and any other type is an error."""
    kind = F.get_json_object(text, "$.type")
    many = F.from_json(text, _GEOMETRY)["coordinates"]
    one = F.from_json(text, _POLYGON)["coordinates"]
    lifted = F.when(F.size(one) > 0, F.array(one)).otherwise(F.expr("cast(array() as array<array<array<array<double>>>>)"))
    coordinates = F.when(kind == "MultiPolygon", many).when(kind == "Polygon", lifted)
    bad = F.raise_error(F.concat(F.lit("no polygon geometry: "), F.coalesce(kind, F.lit("type missing"))))
    return F.when(text.isNotNull(), F.when(kind.isin("MultiPolygon", "Polygon"), F.struct(kind.alias("type"), coordinates.alias("coordinates"))).otherwise(bad))


def read_geojson(
    spark: SparkSession, path: str, class_field: str = "crop_type", collection: bool = False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Read features from line-per-feature shards or from FeatureCollections, which
    may be large: each is read in byte ranges of ``split_bytes`` by many tasks.

    The class field must exist in the data; a row that lacks the property
    altogether (not one where it is null) fails the read.
    """
    if collection:
        rows = read_features(spark, path, split_bytes).select(F.from_json("value", FEATURE_SCHEMA).alias("_f")).select("_f.*")
    else:
        rows = spark.read.schema(FEATURE_SCHEMA).json(path)
    has_field = F.map_contains_key("properties", F.lit(class_field))
    return rows.select(
        parse_geometry(F.col("geometry")).alias("geometry"),
        "properties",
        F.when(has_field, F.col("properties")[class_field])
        .otherwise(F.raise_error(F.lit(f"class field '{class_field}' not in {path}")))
        .alias(class_field),
    )
