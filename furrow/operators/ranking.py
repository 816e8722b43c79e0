"""Exact ranks without sorting a whole table, or a whole group, in one task.

``row_number().over(orderBy(...))`` moves every row to a single partition, and
with ``partitionBy`` one hot key still lands in one task. Both are avoided by
ranking inside buckets that follow the order, then adding the number of rows in
all earlier buckets of the same group. The bucket counts are a map-side
combined aggregate, so the second scan is narrow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from furrow.functions.hashing import key_hash

HASH_BUCKET_DIGITS = 3


def bucketed_rank(
    df: DataFrame,
    bucket: Column,
    order: Sequence[Column],
    group: Sequence[str] = (),
    rank: str = "rank",
    size: str = "group_size",
    bounded_buckets: bool = False,
    first: int | None = None,
) -> DataFrame:
    """Add ``rank`` (0-based, exact) and ``size`` (rows in the group).

    ``bucket`` must be monotone in ``order``: every row of a smaller bucket
    sorts before every row of a larger one. ``group`` columns must not be null.
    Set ``bounded_buckets`` when groups times buckets is bounded by construction
    (not by the data); only then is the offset table broadcast. With ``first``,
    rows that cannot be among the first so many of their group are left out of
    each bucket; the caller still has to cut on ``rank``.
    """
    keys = [*group, "_bucket"]
    tagged = df.withColumn("_bucket", bucket)
    upto = Window.partitionBy(*group).orderBy("_bucket")
    whole = Window.partitionBy(*group)
    offsets = (
        tagged.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
            F.sum("_n").over(whole).alias(size),
        )
    )
    if bounded_buckets:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*keys).orderBy(*order)
    placed = tagged.withColumn("_pos", F.row_number().over(inside))
    if first is not None:
        placed = placed.where(F.col("_pos") <= first)
    return (
        placed.withColumn("_pos", F.col("_pos").cast("bigint"))
        .join(offsets, keys)
        .select(*df.columns, (F.col("_before") + F.col("_pos") - 1).alias(rank), size)
    )


def shuffled_rank(
    df: DataFrame,
    id_col: str,
    seed: int,
    group: Sequence[str] = (),
    rank: str = "rank",
    size: str = "group_size",
    digest: Column | None = None,
    bounded_groups: bool = False,
    first: int | None = None,
) -> DataFrame:
    """Rank rows in a seeded random order: the permutation behind splits,
    samples and batches. At most 16**3 buckets per group."""
    hashed = df.withColumn("_digest", digest if digest is not None else key_hash(F.col(id_col), seed))
    return bucketed_rank(
        hashed,
        F.substring("_digest", 1, HASH_BUCKET_DIGITS),
        [F.col("_digest"), F.col(id_col)],
        group,
        rank,
        size,
        bounded_buckets=not group or bounded_groups,
        first=first,
    ).drop("_digest")
