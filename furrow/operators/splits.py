"""Exact, seeded train / validation / test splits and batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from furrow.functions.hashing import key_hash
from furrow.operators.ranking import shuffled_rank


def _check(**shares: float) -> None:
    """Every share is part of the whole and something is left for training."""
    left = 1.0
    for name, share in shares.items():
        left -= share
        if share < 0.0 or left <= 0.0:
            raise ValueError(f"share {name}={share} leaves no training rows or is negative")


def assign_split(chips: DataFrame, val: float, test: float, seed: int, id_col: str = "chip_id") -> DataFrame:
    """Random split of exact sizes: test first, then validation, rest train.
    Sizes round half to even."""
    _check(test=test, val=val)
    n_test = F.bround(F.col("group_size") * float(test), 0)
    n_val = F.bround(F.col("group_size") * float(val), 0)
    split = F.when(F.col("rank") < n_test, "test").when(F.col("rank") < n_test + n_val, "val").otherwise("train")
    return (
        shuffled_rank(chips.select(id_col), id_col, seed).withColumn("split", split).select(id_col, "rank", "split")
    )


def assign_split_external(main: DataFrame, external: DataFrame, val: float, seed: int, id_col: str = "chip_id") -> DataFrame:
    """The main set becomes validation and train, the external set is the test."""
    inner = assign_split(main, val, 0.0, seed, id_col).withColumn("source", F.lit("main"))
    outer = external.select(
        id_col, F.lit(None).cast("bigint").alias("rank"), F.lit("test").alias("split"), F.lit("external").alias("source")
    )
    return inner.unionByName(outer)


def assign_batches(split: DataFrame, batch_size: int, seed: int, epoch: int = 0, id_col: str = "chip_id") -> DataFrame:
    """Batch number and place of each chip. Train chips are reshuffled per
    epoch and their last partial batch is dropped; the others keep the split's
    order and all chips. Only the three split names group the ranks."""
    place = F.when(F.col("split") == "train", key_hash(F.col(id_col), seed, "epoch", epoch)).otherwise(
        key_hash(F.col(id_col), seed)
    )
    ranked = shuffled_rank(
        split.select(id_col, "split"), id_col, seed, group=["split"], rank="_r", size="_n", digest=place, bounded_groups=True
    )
    batch = F.floor(F.col("_r") / batch_size)
    full = (batch + 1) * batch_size <= F.col("_n")
    return ranked.where((F.col("split") != "train") | full).select(
        id_col, "split", batch.alias("batch"), (F.col("_r") % batch_size).alias("slot")
    )
