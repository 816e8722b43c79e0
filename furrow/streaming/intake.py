"""Incremental scene intake."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from furrow.session import scratch_path

LEAST_BUCKETS = 16
IDS_PER_BUCKET = 4096


def scene_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bucket_of(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")


def index_ids(sink: DataFrame, processed: DataFrame, path: str) -> int:
    """Store the ids of both, with the run and batch that stored each, in folders by
    hash bucket, and return the number of buckets: about ``IDS_PER_BUCKET`` ids each."""
    ids = sink.select("scene_id", F.col("run").cast("string").alias("run"), F.col("batch").cast("bigint").alias("batch")).unionByName(
        processed.select("scene_id", F.lit(None).cast("string").alias("run"), F.lit(None).cast("bigint").alias("batch"))
    )
    buckets = max(LEAST_BUCKETS, ids.count() // IDS_PER_BUCKET)
    ids.withColumn("bucket", bucket_of("scene_id", buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)
    return buckets


def known_ids(spark: SparkSession, path: str, wanted: Sequence[int], id_type: str) -> DataFrame:
    """The indexed ids of some buckets; other buckets are not read."""
    rows = spark.read.schema(f"scene_id {id_type}, run string, batch bigint, bucket int").parquet(path)
    return rows.where(F.col("bucket").isin(*wanted)) if wanted else rows.limit(0)


def intake(stream: DataFrame, cloud_max: float, processed: DataFrame, out: str, checkpoint: str):
    """Append new scenes to ``out`` once each and stop when the input is drained.

    A scene is new if it is neither in ``processed`` nor stored in ``out``, whatever
    its date and whichever run stored it. Each micro-batch owns one folder, named
    by the query's id (kept in its checkpoint) and the batch number: a batch that
    is run again replaces its own rows, and no other run ever writes there.

    The ids of both tables are read once, when the intake starts, into an index by
    hash bucket that this run alone uses and adds to. A batch reads the buckets of its
    own scenes, so its cost follows its size and not that of the sink. One run at a
    time may write to a sink.
    """
    spark, schema = stream.sparkSession, stream.schema
    # The sink exists from the start, so that it can be read.
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{out}/run=none/batch=0")
    index = scratch_path(spark, "intake-ids")
    buckets = index_ids(read_intake(spark, out, schema), processed, index)
    id_type = schema["scene_id"].dataType.simpleString()

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        fresh = batch.where(F.col("cloud_cover") < cloud_max).dropDuplicates(["scene_id"]).withColumn("bucket", bucket_of("scene_id", buckets))
        wanted = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most one per scene of the batch
        own = F.coalesce((F.col("run") == run) & (F.col("batch") == batch_id), F.lit(False))
        known = known_ids(spark, index, wanted, id_type).where(~own).select("scene_id")
        fresh = fresh.join(known, "scene_id", "left_anti")
        target = f"{out}/run={run}/batch={batch_id}"
        fresh.select(*schema.names).write.mode("overwrite").parquet(target)
        # The index follows the sink: rows that a batch run again adds twice do no harm.
        stored = spark.read.schema(schema).parquet(target).select("scene_id", F.lit(run).alias("run"), F.lit(batch_id).cast("bigint").alias("batch"))
        stored.withColumn("bucket", bucket_of("scene_id", buckets)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(index)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_intake(spark: SparkSession, out: str, schema) -> DataFrame:
    """The scenes taken in so far, with the run and batch that stored each."""
    return spark.read.schema(schema).option("basePath", out).parquet(out)
