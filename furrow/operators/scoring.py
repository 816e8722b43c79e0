"""Scores of predictions and of training runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from furrow.functions.arrays import argmax


def with_prediction(preds: DataFrame) -> DataFrame:
    """Add ``pred``, the class of the largest logit."""
    return preds.withColumn("pred", argmax(F.col("logits")))


def known_class(name: str, k: int) -> Column:
    """The class column ``name``; a value outside 0..k-1, or none, fails the run."""
    message = F.concat(F.lit(f"{name} outside 0..{k - 1}: "), F.coalesce(F.col(name).cast("string"), F.lit("none")))
    return F.when(F.col(name).between(0, k - 1), F.col(name)).otherwise(F.raise_error(message))


def confusion(preds: DataFrame, k: int) -> DataFrame:
    """All k x k cells, rows true and columns predicted, zeros included.
    Counting is combined before the shuffle; the cells are k*k rows. A class
    outside 0..k-1 is an error."""
    checked = preds.select(known_class("label", k).alias("label"), known_class("pred", k).alias("pred"))
    counts = checked.groupBy(F.col("label").alias("true"), "pred").agg(F.count(F.lit(1)).alias("n"))
    cells = preds.sparkSession.range(k * k).select(
        F.expr(f"cast(id div {k} as int)").alias("true"), F.expr(f"cast(id % {k} as int)").alias("pred")
    )
    return cells.join(counts, ["true", "pred"], "left").na.fill(0, ["n"])


def confusion_pct(preds: DataFrame, k: int) -> DataFrame:
    """Row-normalised shares; null for a class without samples."""
    row = F.sum("n").over(Window.partitionBy("true"))
    return confusion(preds, k).select("true", "pred", F.try_divide(F.col("n").cast("double"), row).alias("share"))


def accuracy(preds: DataFrame) -> DataFrame:
    right = F.count_if(F.col("pred") == F.col("label"))
    return preds.agg(F.try_divide(right.cast("double"), F.count(F.lit(1))).alias("accuracy"))


def macro_scores(preds: DataFrame, k: int) -> DataFrame:
    """Mean recall and mean F1 over the classes that occur as truth or prediction."""
    cells = confusion(preds, k)
    # Each cell counts for its true class and, off the diagonal, for its predicted class.
    facts = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("true").alias("k"),
                    F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                    F.when(F.col("true") != F.col("pred"), F.col("n")).otherwise(0).alias("fn"),
                    F.lit(0).cast("bigint").alias("fp"),
                ),
                F.struct(
                    F.col("pred").alias("k"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("fn"),
                    F.when(F.col("true") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"),
                ),
            )
        )
    )
    per_class = (
        facts.groupBy("k")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        .where(F.col("tp") + F.col("fp") + F.col("fn") > 0)
    )
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = (2.0 * F.col("tp")) / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return per_class.agg(F.avg(recall).alias("macro_accuracy"), F.avg(f1).alias("macro_f1"))


def log_softmax(logits: Column) -> Column:
    """Log probabilities; the largest logit is taken out before ``exp``."""
    top = F.array_max(logits)
    log_sum = F.log(F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top)))
    return F.transform(logits, lambda z: z - top - log_sum)


def ce_loss(preds: DataFrame, weights: Sequence[float] | None = None, eps: float = 0.0, k: int | None = None) -> DataFrame:
    """Mean cross-entropy with optional class weights and label smoothing,
    weighted over all rows at once. A label outside the classes is an error."""
    if weights is None and k is None:
        raise ValueError("pass the class weights or the number of classes")
    weights = list(weights) if weights is not None else [1.0] * k
    k = len(weights)
    w = F.array(*[F.lit(float(v)) for v in weights])
    rows = preds.select(known_class("label", k).alias("label"), log_softmax(F.col("logits")).alias("lp")).select(
        F.get(w, F.col("label")).alias("w"),
        F.get("lp", F.col("label")).alias("hit"),
        F.aggregate(F.zip_with("lp", w, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v).alias("spread"),
    )
    total = F.sum("w")
    return rows.agg(
        ((1.0 - eps) * -F.sum(F.col("w") * F.col("hit")) / total - (eps / k) * F.sum("spread") / total).alias("loss")
    )


def class_weights(chips: DataFrame, k: int) -> DataFrame:
    """Balanced weights N / (K * n_k), for the classes that occur."""
    counts = chips.groupBy("class_idx").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("class_idx", "n", (total.cast("double") / (F.col("n") * k)).alias("weight"))


def scores(preds: DataFrame, k: int, weights: Sequence[float] | None = None, eps: float = 0.0) -> DataFrame:
    """All scores as ``name, value`` rows."""
    parts = [accuracy(preds), macro_scores(preds, k), ce_loss(preds, weights, eps, k)]
    tall = [p.unpivot([], p.columns, "name", "value") for p in parts]
    return tall[0].unionByName(tall[1]).unionByName(tall[2])


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def best_epoch(history: DataFrame, metric: str = "val_f1") -> DataFrame:
    """Best epoch per run, the first on ties; NaN counts as missing. An aggregate,
    so that a run with most of the rows is combined before the shuffle."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col("epoch")).alias("e")))
    return (
        history.where(F.col(metric).isNotNull() & ~F.isnan(metric))
        .groupBy("run_id")
        .agg(best.alias("_b"))
        .select("run_id", (-F.col("_b.e")).alias("epoch"), F.col("_b.m").alias(metric))
    )


def running_best(df: DataFrame, value: str, out: str, block: int) -> DataFrame:
    """Running maximum of ``value`` over ``epoch`` within ``run_id``, as ``out``.

    A run is cut into blocks of epochs: one small pass over the block maxima
    gives what precedes each block, and the window inside a block never holds
    more than ``block`` rows. The in-block window and the join use the same
    layout.
    """
    keys = ["run_id", "_block"]
    df = df.withColumn("_block", F.floor(F.col("epoch") / block))
    before = Window.partitionBy("run_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        df.groupBy(*keys).agg(F.max(value).alias("_m")).select(*keys, F.max("_m").over(before).alias("_carry"))
    )
    inside = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_in", F.max(value).over(inside))
        .join(carried, keys)
        .withColumn(out, F.greatest("_in", "_carry"))
        .drop("_block", "_in", "_carry")
    )


def early_stop(history: DataFrame, patience: int = 10, metric: str = "val_f1", block: int = 4096) -> DataFrame:
    """First epoch per run at which ``patience`` epochs have passed without a
    value strictly above the best so far; null when the run never stops. NaN is
    no value.

    The last improvement is the epoch at which the best value so far was first
    reached, so one running maximum of (value, earliest epoch) gives both.
    """
    reached = F.when(F.col(metric).isNotNull() & ~F.isnan(metric), F.struct(F.col(metric).alias("m"), (-F.col("epoch")).alias("e")))
    best = running_best(history.select("run_id", "epoch", reached.alias("_v")), "_v", "_best", block)
    waited = F.col("epoch") + F.col("_best.e")
    return best.groupBy("run_id").agg(F.min(F.when(waited >= patience, F.col("epoch"))).alias("stop_epoch"))
