"""Input tables of the registered queries, derived from the given Parquet files.

``FIXTURES.md`` describes each table. ``fields`` and ``scenes_flat`` are plain
SQL that Spark and the checking engine both run; pixel tables are built in
array form here and in long form by the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from furrow.operators.ranking import bucketed_rank

FIELDS_SQL = """
select k as field_id,
 case when k % 97 = 0 then null when k % 89 = 0 then concat('  ', r_name) else r_name end as viloyat,
 n_name as tuman,
 case when k % 101 = 0 then null else 1700200 + n_nationkey end as tuman_code,
 case k % 10 when 0 then 'bugdoy' when 1 then ' Bugdoy ' when 2 then 'paxta' when 3 then 'other'
  when 4 then 'bugdoy, other' when 5 then 'bugdoy, paxta' when 6 then 'other, bugdoy' when 7 then 'Paxta'
  when 8 then 'paxta, other' else case when k % 3 = 0 then null else 'other' end end as crop_type,
 case when k % 73 = 0 then null when k % 79 = 0 then 'garbage' when k % 83 = 0 then 'MULTIPOLYGON EMPTY'
  when k % 71 = 0 then concat('POLYGON ', x0, ' ', y0, ' ', x1, ' ', y1)
  when k % 67 = 0 then concat('POLYGON ((', x0,' ',y0,', ',x1,' ',y0,', ',x1,' ',y1,', ',x0,' ',y1,'))')
  when k % 11 = 0 then concat('POLYGON ((', x0,' ',y0,', ',x1,' ',y0,', ',x1,' ',y1,', ',x0,' ',y1,', ',x0,' ',y0,'))')
  else concat('MULTIPOLYGON (((', x0,' ',y0,', ',x1,' ',y0,', ',x1,' ',y1,', ',x0,' ',y1,', ',x0,' ',y0,')))') end as geom_2
from (select k, r_name, n_name, n_nationkey,
  concat(cast(cast(floor(a / 1000) as bigint) as string), '.', lpad(cast(a % 1000 as string),3,'0')) as x0,
  concat(cast(cast(floor((a+w) / 1000) as bigint) as string), '.', lpad(cast((a+w) % 1000 as string),3,'0')) as x1,
  concat(cast(cast(floor(b / 1000) as bigint) as string), '.', lpad(cast(b % 1000 as string),3,'0')) as y0,
  concat(cast(cast(floor((b+h) / 1000) as bigint) as string), '.', lpad(cast((b+h) % 1000 as string),3,'0')) as y1
 from (select o_orderkey as k, r_name, n_name, n_nationkey,
   56000 + (o_orderkey * 7919) % 17100 as a, 37000 + (o_orderkey * 104729) % 8550 as b,
   case when o_orderkey % 1999 = 0 then 5000 when o_orderkey % 499 = 0 then 300 else 1 + o_orderkey % 40 end as w,
   case when o_orderkey % 1999 = 0 then 5000 when o_orderkey % 499 = 0 then 300 else 1 + o_orderkey % 23 end as h
  from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
   join {region} on n_regionkey = r_regionkey) t0) t1
"""

SCENES_SQL = """
select concat('S2_', lpad(cast(s_suppkey as string),6,'0')) as scene_id, s_suppkey as scene_k,
 cast(a as double) / 1000.0 as lon_min, cast(b as double) / 1000.0 as lat_min,
 cast(a + 3300 as double) / 1000.0 as lon_max, cast(b + 3300 as double) / 1000.0 as lat_max,
 cast((s_suppkey * 37) % 40 as double) as cloud_cover,
 date '2025-04-01' + cast((s_suppkey * 13) % 183 as int) as acq_date,
 cast(32601 + floor((a + 1650 + 180000) / 6000) as int) as epsg,
 case when s_suppkey % 13 = 0 then null when s_suppkey % 11 = 0 then 'MultiPolygon' else 'Polygon' end as geom_type,
 s_suppkey % 17 <> 0 as has_b12
from (select s_suppkey, 54500 + (s_suppkey * 3571) % 17000 as a, 35500 + (s_suppkey * 2693) % 8500 as b from {supplier}) t
"""

# The nine bands of a scene and the three date windows of a season.
BANDS = ["B02", "B03", "B04", "B05", "B06", "B07", "B08", "B11", "B12"]
WINDOWS = [
    (0, "2025-04-01", "2025-05-31"),
    (1, "2025-06-01", "2025-07-31"),
    (2, "2025-08-01", "2025-09-30"),
]
# Bands of the pixel table: position in BANDS, name and ground resolution in degrees.
OBS_BANDS = [(2, "B04", 0.0001), (6, "B08", 0.0001), (7, "B11", 0.0002)]
TILE_SIZE = 16
TILE_RES = 0.2
CLASS_NAMES = ["bugdoy", "other", "paxta"]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table. Its schema is inferred once per process: each inference
    is a job that reads a file footer."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled polygons, one per order, with missing and malformed values."""
    inputs = {name: table(spark, sf_dir, name) for name in ("customer", "nation", "region")}
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return spark.sql(FIELDS_SQL, orders=orders, **inputs)


def scenes_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCENES_SQL, supplier=table(spark, sf_dir, "supplier"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue items, one per supplier: nested geometry, declared bbox, assets.

    The declared bbox of a Polygon item is wider than its ring, so reading the
    wrong one shows. Every 13th item has neither; every 17th lacks B12.
    """

    def point(x: str, y: str):
        return F.array(F.col(x), F.col(y))

    ring = F.array(
        point("lon_min", "lat_min"),
        point("lon_max", "lat_min"),
        point("lon_max", "lat_max"),
        point("lon_min", "lat_max"),
        point("lon_min", "lat_min"),
    )
    pad = F.when(F.col("geom_type") == "Polygon", F.lit(0.05)).otherwise(F.lit(0.0))
    bbox = F.array(
        F.col("lon_min") - pad, F.col("lat_min") - pad, F.col("lon_max") + pad, F.col("lat_max") + pad
    )
    owned = [
        F.when(F.col("has_b12") | F.lit(band != "B12"), F.struct(F.lit(band), F.concat_ws("_", "scene_id", F.lit(f"{band}.tif"))))
        for band in BANDS
    ]
    return scenes_flat(spark, sf_dir).select(
        "scene_id",
        "scene_k",
        "acq_date",
        (F.col("acq_date").cast("timestamp") + F.make_dt_interval(hours=((F.col("scene_k") * 7) % 24).cast("int"))).alias(
            "datetime"
        ),
        "cloud_cover",
        "epsg",
        F.lit(10.0).alias("res"),
        F.when(
            F.col("geom_type").isNotNull(),
            F.struct(F.col("geom_type").alias("type"), F.array(ring).alias("coordinates")),
        ).alias("geometry"),
        F.when(F.col("geom_type").isNotNull(), bbox).alias("bbox"),
        F.map_from_entries(F.filter(F.array(*owned), lambda e: e.isNotNull())).alias("assets"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band files, one row per scene and owned band."""
    return scenes(spark, sf_dir).select("scene_id", "scene_k", F.explode("assets").alias("band", "path"))


def band_position(band: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(b) for b in BANDS]), band) - 1).cast("int")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files fetched by an earlier run: about a fifth of the assets."""
    done = (F.col("scene_k") + band_position(F.col("band"))) % 5 == 0
    return assets(spark, sf_dir).where(done).select("path")


def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of this run per file: about one in seven failed."""
    ok = (F.col("scene_k") * 3 + band_position(F.col("band"))) % 7 != 0
    return assets(spark, sf_dir).select("path", ok.alias("ok"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native-resolution windows per field, date window and band, in array form.

    10 m windows run from 1x1 to 6x5 pixels and 20 m ones have half the size;
    a field misses up to two of its three date windows.
    """
    ids = fields(spark, sf_dir).select("field_id")
    specs = F.array(
        *[
            F.struct(F.lit(w).alias("window_idx"), F.lit(i).alias("band_idx"), F.lit(b).alias("band"), F.lit(r).alias("res"))
            for w, _, _ in WINDOWS
            for i, b, r in OBS_BANDS
        ]
    )
    seen = ((F.col("field_id") + F.col("window_idx")) % 4 != 0) & ((2 * F.col("field_id") + F.col("window_idx")) % 5 != 0)
    step = F.when(F.col("res") > 0.00015, 2).otherwise(1)

    def side(full):
        return F.ceil(full / step).cast("int")

    base = (
        F.col("field_id") * 31 + F.col("window_idx") * 997 + F.col("band_idx") * 131
    )
    rows = (
        ids.select("field_id", F.inline(specs))
        .where(seen)
        .select(
            "field_id",
            "window_idx",
            "band_idx",
            "band",
            "res",
            side(1 + F.col("field_id") % 6).alias("h"),
            side(1 + F.col("field_id") % 5).alias("w"),
            base.alias("base"),
        )
    )
    px = F.expr("transform(sequence(0, h * w - 1), i -> cast((base + (i div w) * 17 + (i % w) * 7) % 10000 as int))")
    return rows.withColumn("px", px).drop("base")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 16x16 single-band raster per scene, north up, in array form."""
    n = TILE_SIZE
    return scenes_flat(spark, sf_dir).select(
        "scene_id",
        F.col("lon_min").alias("origin_x"),
        F.col("lat_max").alias("origin_y"),
        F.lit(TILE_RES).alias("res"),
        F.lit(n).alias("h"),
        F.lit(n).alias("w"),
        F.expr(
            f"transform(sequence(0, {n * n - 1}),"
            f" i -> cast((scene_k * 53 + (i div {n}) * 19 + (i % {n}) * 11) % 10000 as int))"
        ).alias("px"),
    )


# Bands of the block-stored rasters: position in BANDS, name, ground resolution in degrees.
RASTER_BANDS = [(2, "B04", 0.01), (6, "B08", 0.01), (7, "B11", 0.02), (8, "B12", 0.01)]
RASTER_BLOCK = 64
SCENE_DEGREES = 3.3


def raster_blocks(spark: SparkSession, sf_dir: str, bands: list[str], places: DataFrame | None = None) -> DataFrame:
    """Rasters of 330 x 330 or 165 x 165 pixels per scene and band, in blocks: all of
    them, or those at ``places`` (``scene_id, band, br, bc``), whose pixels alone are made."""
    n = RASTER_BLOCK
    specs = F.array(
        *[
            F.struct(F.lit(b).alias("band"), F.lit(i).alias("band_idx"), F.lit(round(SCENE_DEGREES / res)).alias("side"))
            for i, b, res in RASTER_BANDS
            if b in bands
        ]
    )
    last = F.floor((F.col("side") - 1) / n).cast("int")
    rows = scenes_flat(spark, sf_dir).where(F.col("has_b12") | F.lit("B12" not in bands)).select("scene_id", "scene_k", F.inline(specs))
    rows = rows.withColumn("br", F.explode(F.sequence(F.lit(0), last))).withColumn("bc", F.explode(F.sequence(F.lit(0), last)))
    if places is not None:
        rows = rows.join(places, ["scene_id", "band", "br", "bc"], "left_semi")
    rows = rows.withColumns({"bh": F.least(F.lit(n), F.col("side") - F.col("br") * n), "bw": F.least(F.lit(n), F.col("side") - F.col("bc") * n)})
    rows = rows.withColumn("base", F.expr(f"cast(scene_k * 53 + band_idx * 131 + br * {n * 19} + bc * {n * 11} as int)")).repartition("scene_id", "band", "br")
    dn = (
        "flatten(transform(sequence(0, bh - 1), y -> transform("
        "sequence(base + cast(y as int) * 19, base + cast(y as int) * 19 + cast(bw - 1 as int) * 11, 11), v -> v % 10000)))"
    )
    return rows.select("scene_id", "band", "br", "bc", "bh", "bw", F.expr(dn).alias("px"))


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4x4x4 chips of three classes, one per embedding vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chip_id"),
        (F.col("label") % 3).alias("class_idx"),
        F.lit(4).alias("c"),
        F.lit(4).alias("h"),
        F.lit(4).alias("w"),
        F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 5000).cast("int")).alias("px"),
    )


def full_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips of the size a season's build makes, 30 x 64 x 64: each small chip's values, repeated."""
    px = F.flatten(F.array_repeat(F.transform("px", lambda v: v.cast("float")), 30 * 64 * 64 // 64))
    return chips(spark, sf_dir).select("chip_id", "class_idx", F.lit(30).alias("c"), F.lit(64).alias("h"), F.lit(64).alias("w"), px.alias("px"))


def dirty_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips with the defects the dataset checks look for."""
    k = F.col("chip_id")
    return (
        chips(spark, sf_dir)
        .withColumn("px", F.when(k % 37 == 0, F.lit(None)).when(k % 50 == 0, F.slice("px", 1, 63)).otherwise(F.col("px")))
        .withColumn("class_idx", F.when(k % 41 == 0, 5).when(k % 47 == 0, F.lit(None)).otherwise(F.col("class_idx")))
        .withColumn("c", F.when(k % 43 == 0, 5).otherwise(F.col("c")))
    )


def district_of(id_col: Column) -> Column:
    return (1700200 + id_col % 25).cast("int")


def chip_sets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two sets of chips per district; every seventh district has no labels yet."""
    code = district_of(F.col("chip_id"))
    rows = chips(spark, sf_dir).select(
        code.alias("tuman_code"), "chip_id", F.when(code % 7 != 0, F.col("class_idx")).alias("class_idx"), "c", "h", "w", "px"
    )
    return [rows.where(F.col("tuman_code") < 1700212), rows.where(F.col("tuman_code") >= 1700212)]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three logits per chip: sums over every third value of the whole vector,
    in whole steps so that the order of addition does not matter."""
    whole = F.transform("embedding", lambda v: (F.floor((v.cast("double") + 1) * 5000) - 5000).cast("bigint"))
    third = lambda r: F.aggregate(
        F.filter(whole, lambda _, i: i % 3 == r), F.lit(0).cast("bigint"), lambda a, v: a + v
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chip_id"),
        (F.col("label") % 3).alias("label"),
        F.array(*[third(r).cast("double") / 500 for r in range(3)]).alias("logits"),
    )


def events_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their position in time per user, ranked minute by minute so
    that a user with a large share of all events is split over many tasks."""
    return bucketed_rank(
        table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"),
        F.date_trunc("minute", "ts"),
        [F.col("ts"), F.col("event_id")],
        group=["user_id"],
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation score per run and epoch; NaN where a run diverged, on every 53rd event."""
    return events_ranked(spark, sf_dir).select(
        F.col("user_id").alias("run_id"),
        F.col("rank").cast("int").alias("epoch"),
        F.when(F.col("event_id") % 53 == 0, float("nan")).otherwise(F.floor(F.col("value") * 10).cast("double") / 5000).alias("val_f1"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-channel time series per sample, long form."""
    return events_ranked(spark, sf_dir).select(
        F.col("user_id").alias("sample_id"),
        F.col("rank").cast("int").alias("t"),
        F.posexplode(F.array(F.floor(F.col("value") * 100).cast("bigint"), F.col("event_id") % 50)).alias("c", "v"),
    )




def window_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date-window arguments as users type them, one per order: valid pairs,
    blanks between commas, and pairs with a missing or extra part."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    later = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd")
    k = F.col("o_orderkey")
    pair = F.concat(day, F.lit(":"), later)
    return table(spark, sf_dir, "orders").select(
        k.alias("spec_id"),
        F.when(k % 7 == 0, F.concat(day, F.lit(","), pair))
        .when(k % 7 == 1, F.concat(pair, F.lit(", ,"), pair, F.lit(":x")))
        .when(k % 7 == 2, F.concat(F.lit(" "), pair, F.lit(" , "), later, F.lit(" : "), later))
        .otherwise(pair)
        .alias("spec"),
    )
