"""Splits, batches, scores, run history, the stream and the end-to-end plans."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from furrow import fixtures as fx
from furrow.operators import chips as ops, scoring, splits, stats
from furrow.plans import build
from furrow.plans.queries import DATE_WINDOWS, QUERIES
from furrow.sources.chips import synthetic_chips
from furrow.sources.fields import read_fields
from furrow.sources.scenes import aoi_table, footprints, resolve_aoi
from furrow.streaming import intake as intake_module
from furrow.streaming.intake import intake, read_intake, scene_stream


def test_split_sizes_and_cover(spark):
    ids = spark.range(32).withColumnRenamed("id", "chip_id")
    rows = splits.assign_split(ids, 0.25, 0.25, 42).collect()
    sizes = {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")}
    assert sizes == {"train": 16, "val": 8, "test": 8}
    assert sorted(r.chip_id for r in rows) == list(range(32))
    again = splits.assign_split(ids.repartition(7), 0.25, 0.25, 42).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}
    # 10 * 0.25 = 2.5 rounds to the even 2.
    small = splits.assign_split(ids.where("chip_id < 10"), 0.25, 0.25, 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in small} == {"test": 2, "val": 2, "train": 6}
    for bad in ((-0.1, 0.2), (1.0, 0.0), (0.5, 0.5)):
        with pytest.raises(ValueError):
            splits.assign_split(ids, *bad, 1)


def test_batches_drop_only_the_last_train_batch(spark):
    ids = spark.range(103).withColumnRenamed("id", "chip_id")
    split = splits.assign_split(ids, 0.2, 0.2, 1)
    rows = splits.assign_batches(split, 8, 1).collect()
    count = {s: [r for r in rows if r.split == s] for s in ("train", "val", "test")}
    n = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert len(count["train"]) == n["train"] // 8 * 8
    assert len(count["val"]) == n["val"] and len(count["test"]) == n["test"]
    assert len({(r.split, r.batch, r.slot) for r in rows}) == len(rows)
    other = splits.assign_batches(split, 8, 1, epoch=1).where("split = 'train'").collect()
    assert {tuple(r) for r in other} != {tuple(r) for r in count["train"]}


def preds(spark, rows):
    return spark.createDataFrame(rows, "label int, logits array<double>").transform(scoring.with_prediction)


def test_scores_match_hand_values(spark):
    df = preds(spark, [(0, [2.0, 1.0, 0.0]), (0, [0.0, 1.0, 0.0]), (1, [0.0, 3.0, 1.0]), (1, [1.0, 1.0, 0.0])])
    cells = {(r.true, r.pred): r.n for r in scoring.confusion(df, 3).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 4
    # The tie in the last row goes to the lower class.
    assert (cells[0, 0], cells[0, 1], cells[1, 0], cells[1, 1]) == (1, 1, 1, 1)
    assert scoring.accuracy(df).first()[0] == 0.5
    # Class 2 occurs nowhere and is left out.
    r = scoring.macro_scores(df, 3).first()
    assert (r.macro_accuracy, r.macro_f1) == (0.5, 0.5)
    shares = {(x.true, x.pred): x.share for x in scoring.confusion_pct(df, 3).collect()}
    assert shares[0, 1] == 0.5 and shares[2, 0] is None


def test_loss_matches_formula(spark):
    rows = [(0, [1000.0, 999.0]), (1, [0.5, -0.5]), (1, [0.0, 2.0])]
    w, eps = [1.0, 3.0], 0.1
    top = bottom = smooth = 0.0
    for y, z in rows:
        m = max(z)
        lse = m + math.log(sum(math.exp(v - m) for v in z))
        lp = [v - lse for v in z]
        top -= w[y] * lp[y]
        smooth -= sum(a * b for a, b in zip(w, lp))
        bottom += w[y]
    want = (1 - eps) * top / bottom + eps / 2 * smooth / bottom
    assert math.isclose(scoring.ce_loss(preds(spark, rows), w, eps).first()[0], want, rel_tol=1e-12)


def stop_epoch(values, patience):
    best, wait = -math.inf, 0
    for i, v in enumerate(values):
        if v > best:
            best, wait = v, 0
        else:
            wait += 1
            if wait >= patience:
                return i
    return None


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_history_rules(spark, block):
    rng = random.Random(2)
    runs = {i: [rng.randrange(40) / 10 for _ in range(rng.randrange(1, 60))] for i in range(30)}
    df = spark.createDataFrame([(i, e, v) for i, vs in runs.items() for e, v in enumerate(vs)], "run_id long, epoch int, val_f1 double")
    got = {r.run_id: r.stop_epoch for r in scoring.early_stop(df, 5, block=block).collect()}
    assert got == {i: stop_epoch(vs, 5) for i, vs in runs.items()}
    best = {r.run_id: (r.epoch, r.val_f1) for r in scoring.best_epoch(df).collect()}
    assert best == {i: (vs.index(max(vs)), max(vs)) for i, vs in runs.items()}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "class_idx int")
    assert {r.class_idx: r.weight for r in scoring.class_weights(df, 2).collect()} == {0: 4 / 6, 1: 2.0}


def test_stream_takes_each_scene_once_and_resumes(spark, tmp_path):
    schema = "scene_id string, datetime timestamp, cloud_cover double"
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))

    def arrive(ids, cloud=1.0):
        rows = spark.createDataFrame([(i, cloud) for i in ids], "scene_id string, cloud_cover double")
        rows.select("scene_id", F.to_timestamp(F.lit("2025-05-01")).alias("datetime"), "cloud_cover").repartition(2).write.mode("append").parquet(src)

    done = spark.createDataFrame([("b",)], "scene_id string")

    def drain():
        typed = spark.read.parquet(src).schema
        intake(scene_stream(spark, src, typed, 1), 20.0, done, out, state).awaitTermination()
        return sorted(r.scene_id for r in read_intake(spark, out, typed).collect())

    arrive(["a", "a", "b", "c"])
    arrive(["cloudy"], 20.0)
    assert drain() == ["a", "c"]
    arrive(["c", "d"])
    assert drain() == ["a", "c", "d"]


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    """Ids read for a batch do not grow with the sink: buckets stay of about one size."""
    few = {}
    for n in (5_000, 50_000):
        path = str(tmp_path / f"ids{n}")
        sink = spark.range(n).select(F.concat(F.lit("s"), "id").alias("scene_id"), F.lit("r").alias("run"), F.lit(0).alias("batch"))
        old_size, intake_module.IDS_PER_BUCKET, old_least, intake_module.LEAST_BUCKETS = intake_module.IDS_PER_BUCKET, 50, intake_module.LEAST_BUCKETS, 4
        try:
            buckets = intake_module.index_ids(sink, spark.createDataFrame([("old",)], "scene_id string"), path)
        finally:
            intake_module.IDS_PER_BUCKET, intake_module.LEAST_BUCKETS = old_size, old_least
        batch = spark.createDataFrame([("s7",), ("old",), ("new",)], "scene_id string").select(intake_module.bucket_of("scene_id", buckets).alias("b"))
        known = intake_module.known_ids(spark, path, [r.b for r in batch.collect()], "string")
        assert "PartitionFilters: [isnotnull(bucket" in known._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in known._jdf.queryExecution().toString()
        ids = [r.scene_id for r in known.collect()]
        assert {"s7", "old"} <= set(ids) and "new" not in ids
        few[n] = len(ids)
    assert few[5_000] <= 3 * 100 and few[50_000] <= 3 * 100


def test_build_and_train(spark, sf_dir):
    fields = build.labelled_fields(fx.fields(spark, sf_dir), n_per_region=3, per_class=20, seed=1)
    assert fields.count() > 0
    chips = build.build_chips(
        fields, footprints(fx.scenes(spark, sf_dir)), fx.obs(spark, sf_dir), DATE_WINDOWS, ["B04", "B08"], 4, min_px=1, max_missing=2
    )
    first = chips.first()
    assert first.c == 9 and len(first.px) == 9 * 16
    ids = {r.chip_id for r in chips.select("chip_id").collect()}
    assert ids <= {r.field_id for r in fields.select("field_id").collect()}


def test_window_report_adds_up(spark, sf_dir):
    fields = fx.fields(spark, sf_dir)
    for r in ops.window_report(fx.obs(spark, sf_dir), fields, ["B04", "B08", "B11"], 3, 2).collect():
        assert r.chips + r.too_small + r.no_scene == fields.count() and min(r.chips, r.too_small, r.no_scene) > 0


def test_sinks_and_sources_round_trip(spark, sf_dir, tmp_path):
    scored = scoring.scores(scoring.with_prediction(fx.predictions(spark, sf_dir)), 3)
    scoring.write_metrics(scored, str(tmp_path / "metrics"))
    assert {r.name for r in spark.read.json(str(tmp_path / "metrics")).collect()} == {"accuracy", "macro_accuracy", "macro_f1", "loss"}
    stats.write_band_stats(stats.band_stats(fx.chips(spark, sf_dir)), str(tmp_path / "stats"))
    mean, std = stats.stats_lists(spark.read.parquet(str(tmp_path / "stats")))
    assert len(mean) == len(std) == 4
    fx.fields(spark, sf_dir).write.parquet(str(tmp_path / "fields"))
    stored = read_fields(spark, str(tmp_path / "fields"), keep=("field_id",))
    assert stored.columns == ["field_id", "geom_2", "crop_type"] and stored.where("geom_2 is null or crop_type is null").count() == 0
    assert "PushedFilters: [IsNotNull(geom_2), IsNotNull(crop_type)]" in stored._jdf.queryExecution().toString()


def test_named_areas(spark):
    rows = {r.aoi: r.ax0 for r in aoi_table(spark, {"mine": (1, 2, 3, 4)}).collect()}
    assert set(rows) == {"fergana", "samarkand", "tashkent", "mine"} and rows["mine"] == 1.0
    with pytest.raises(ValueError):
        resolve_aoi("nowhere")


def test_rank_limits_apply_before_the_shuffle(spark, sf_dir):
    for name in ("top_districts", "sample_per_class"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2, name


@pytest.mark.parametrize("model", ["linear", "normal", "optimised"])
def test_baselines_learn_separable_chips(spark, model):
    chips = synthetic_chips(spark.range(400).withColumnRenamed("id", "chip_id"), 4, 8, 3, 1).withColumn("px", F.transform("px", lambda v: v.cast("int")))
    got = {r.name: r.value for r in build.train_and_score(spark, chips, 3, model=model).collect()}
    assert got["accuracy"] >= 0.75 and got["macro_f1"] >= 0.75
