"""Contiguous shards of equal bytes.

Rows are put in id order by range partitions; each partition's byte and row
totals give its offset, and a running sum inside the partition gives every row
its global byte position. Shards are cut where that position crosses an equal
share of all bytes, so each shard is one contiguous run of the id order and
differs from the equal share by less than the longest document at either end.

The totals table has one row per range partition, whatever the input size; it
is the only thing that is gathered. Rows that tie on the id are ordered by
checksum, size and input position, so a hot id is split over many partitions.

Null and empty texts weigh one byte. Null ids sort first. Equal rows keep one
slot each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from furrow.session import checkpointed

_ORDER = ["doc_id", "text_crc32", "size", "_tie"]


def text_weight(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint") + 1


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, byte_start`` for every row of ``docs``.

    ``slot`` counts from 0 inside the shard. Other columns of ``docs`` are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        text_weight(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds come from a sample and may differ between two runs of the
    # plan, so the placement is written once and every later step reads it.
    placed = checkpointed(
        rows.repartitionByRange(parts, *_ORDER).withColumn("_part", F.spark_partition_id()), spark, "shard-rows"
    )
    every = Window.partitionBy()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(every).alias("_total"),
        )
    )
    inside = Window.partitionBy("_part").orderBy(*_ORDER)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        placed.withColumn("_run", F.sum("size").over(upto))
        .withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")  # one row per range partition
        .withColumn("byte_start", F.col("_bytes_before") + F.col("_run") - F.col("size"))
        .withColumn("_row", F.col("_rows_before") + F.col("_row") - 1)
        .withColumn("shard", F.expr(f"cast(((2 * byte_start + size) * {shards}) div (2 * _total) as int)"))
    )
    firsts = summed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return summed.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"), "byte_start"
    )
