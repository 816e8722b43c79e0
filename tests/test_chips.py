"""Chip arrays, transforms, statistics and checks."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from furrow import fixtures as fx
from furrow.functions import arrays
from furrow.functions.hashing import hash_int
from furrow.operators import chips as ops, stats, transforms as tf
from furrow.sources import chips as chip_io

CHIP = "chip_id long, class_idx int, c int, h int, w int, px array<double>"


def chip(spark, array, chip_id=1, class_idx=0):
    a = np.asarray(array, dtype=float)
    return spark.createDataFrame([(chip_id, class_idx, *a.shape, a.ravel().tolist())], CHIP)


def array_of(df):
    r = df.first()
    return np.array(r.px).reshape(r.c, r.h, r.w)


def bilinear(img, size):
    h, w = img.shape
    out = np.empty((size, size))
    for oy in range(size):
        for ox in range(size):
            sy, sx = max((oy + 0.5) * h / size - 0.5, 0), max((ox + 0.5) * w / size - 0.5, 0)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            wy, wx = sy - y0, sx - x0
            out[oy, ox] = (1 - wy) * ((1 - wx) * img[y0, x0] + wx * img[y0, x1]) + wy * ((1 - wx) * img[y1, x0] + wx * img[y1, x1])
    return out


@pytest.mark.parametrize("size", [1, 3, 8])
def test_resize_is_bilinear_per_channel(spark, size):
    rng = np.random.default_rng(123)
    shapes = [(2, 5, 3), (1, 1, 1), (3, 4, 4), (2, 7, 2), (2, 5, 3)]
    data = {i: rng.uniform(0, 1e4, s) for i, s in enumerate(shapes)}
    df = spark.createDataFrame([(i, 0, *a.shape, a.ravel().tolist()) for i, a in data.items()], CHIP)
    for r in ops.resize_bilinear(df, size).collect():
        assert (r.h, r.w) == (size, size)
        got = np.array(r.px).reshape(r.c, size, size)
        np.testing.assert_allclose(got, np.stack([bilinear(p, size) for p in data[r.chip_id]]))


def test_scale_and_normalize(spark):
    assert (array_of(chip(spark, np.full((1, 2, 2), 5000.0)).transform(tf.scale_reflectance())) == 0.5).all()
    done = array_of(chip(spark, [[[0.6]], [[0.6]]]).transform(tf.normalize([0.1, 0.2], [0.5, 0.4])))
    np.testing.assert_allclose(done.ravel(), [1.0, 1.0])
    with pytest.raises(ValueError):
        tf.scale_reflectance(0)
    with pytest.raises(ValueError):
        tf.normalize([0.1], [0.5, 0.4])
    with pytest.raises(Exception, match="channels"):
        array_of(chip(spark, [[[0.6]]]).transform(tf.normalize([0.1, 0.2], [0.5, 0.4])))


def test_flips_reverse_and_undo(spark):
    a = np.arange(12.0).reshape(1, 3, 4)
    df = chip(spark, a)
    np.testing.assert_array_equal(array_of(df.transform(tf.hflip(1.0))), a[:, :, ::-1])
    np.testing.assert_array_equal(array_of(df.transform(tf.vflip(1.0))), a[:, ::-1, :])
    np.testing.assert_array_equal(array_of(df.transform(tf.hflip(0.0))), a)
    np.testing.assert_array_equal(array_of(df.transform(tf.compose(tf.vflip(1.0), tf.vflip(1.0)))), a)


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_rotation_is_counter_clockwise(spark, k):
    a = np.arange(24.0).reshape(2, 3, 4)
    np.testing.assert_array_equal(array_of(chip(spark, a).transform(tf.rot90(turns=F.lit(k)))), np.rot90(a, k, axes=(1, 2)))


def test_four_quarter_turns_undo(spark):
    a = np.arange(24.0).reshape(2, 3, 4)
    turn = tf.rot90(turns=F.lit(1))
    np.testing.assert_array_equal(array_of(chip(spark, a).transform(tf.compose(turn, turn, turn, turn))), a)


def test_compose_keeps_order(spark):
    df = chip(spark, [[[10000.0]]])
    one = array_of(df.transform(tf.compose(tf.scale_reflectance(), tf.normalize([0.5], [0.5]))))
    two = array_of(df.transform(tf.compose(tf.normalize([0.5], [0.5]), tf.scale_reflectance())))
    assert one[0, 0, 0] == 1.0 and two[0, 0, 0] != 1.0


def test_random_transforms_do_not_depend_on_partitions(spark, sf_dir):
    chips = fx.chips(spark, sf_dir)
    run = tf.train_transforms([0.5] * 4, [0.1] * 4, seed=3)
    one = {r.chip_id: r.px for r in chips.repartition(1).transform(run).collect()}
    many = {r.chip_id: r.px for r in chips.repartition(17).transform(run).collect()}
    assert one == many
    flipped = [r.v for r in chips.select(arrays.coin(F.col("chip_id"), 3, "hflip", 0.5).alias("v")).collect()]
    assert 0.4 < sum(flipped) / len(flipped) < 0.6


def test_noise_has_the_right_spread(spark):
    df = chip(spark, np.zeros((4, 40, 40))).transform(tf.gaussian_noise(0.01, 1))
    v = array_of(df)
    assert abs(v.mean()) < 5e-4 and math.isclose(v.std(), 0.01, rel_tol=0.05)


def scalar_mix(x: int) -> int:
    full = (1 << 32) - 1
    x = ((x ^ x >> 16) * tf.MIX[0]) & full
    x = ((x ^ x >> 15) * tf.MIX[1]) & full
    return x ^ x >> 16


def test_fused_steps_follow_the_rule_pixel_by_pixel(spark):
    """Mixed shapes, an odd number of pixels, a row without pixels, clashing names."""
    rng = np.random.default_rng(12)
    data = {i: rng.uniform(0, 1e4, s) for i, s in enumerate([(2, 3, 5), (1, 3, 3), (2, 3, 5), (2, 4, 4), (1, 1, 1)] * 4)}
    rows = [(i, 0, *a.shape, a.ravel().tolist()) for i, a in data.items()] + [(99, 0, 2, 3, 5, None)]
    df = spark.createDataFrame(rows, CHIP).withColumn("c0", F.lit("kept"))
    step = tf.compose(tf.scale_reflectance(), tf.hflip(0.5, 3), tf.vflip(0.5, 3), tf.rot90(3), tf.spectral_jitter(0.2, 0.1, 3), tf.gaussian_noise(0.05, 3))
    assert isinstance(step, tf.Fused)
    one, apart = (
        {r.chip_id: r for r in out.collect()}
        for out in (df.transform(step), df.transform(tf.scale_reflectance()).transform(tf.hflip(0.5, 3)).transform(tf.vflip(0.5, 3)).transform(tf.rot90(3)))
    )
    keys = {
        r.chip_id: r
        for r in df.select(
            "chip_id", *(hash_int(F.col("chip_id"), 3, op).alias(op) for op in ("scale", "shift", "noise")), *(arrays.coin(F.col("chip_id"), 3, op, 0.5).alias(op) for op in ("hflip", "vflip")),
            arrays.quarter_turns(F.col("chip_id"), 3).alias("k"),
        ).collect()
    }
    assert one[99].px is None and one[99].c0 == "kept" and len({keys[i].k for i in data}) > 2
    full = float(1 << 32)
    for i, a in data.items():
        key = keys[i]
        a = a / 1e4
        a = a[:, :, ::-1] if key.hflip else a
        a = a[:, ::-1] if key.vflip else a
        a = np.rot90(a, key.k, axes=(1, 2))
        assert (one[i].h, one[i].w) == a.shape[1:] == (apart[i].h, apart[i].w)
        np.testing.assert_allclose(np.array(apart[i].px), a.ravel(), rtol=1e-6)
        draw = lambda op, n: scalar_mix((key[op] + n * tf.GOLDEN) % (1 << 32))
        want = []
        for n, v in enumerate(a.ravel().tolist()):
            ch = n // (a.shape[1] * a.shape[2])
            v = v * ((draw("scale", ch) / full * 2 - 1) * 0.1 + 1) + (draw("shift", ch) / full * 2 - 1) * 0.2
            first = draw("noise", n // 2)
            angle = scalar_mix(first ^ tf.SECOND_LANE) / full * 2 * math.pi
            want.append(v + math.sqrt(-2 * math.log(1 - first / full)) * 0.05 * (math.sin(angle) if n % 2 else math.cos(angle)))
        np.testing.assert_allclose(np.array(one[i].px), want, rtol=1e-5, atol=1e-6)


def test_wrong_sizes_fail(spark):
    df = spark.createDataFrame([(1, 0, 2, 2, 2, [1.0] * 7)], CHIP)
    with pytest.raises(Exception, match="7 values"):
        df.transform(tf.hflip()).collect()


def test_neighbouring_steps_run_in_one_pass(spark, sf_dir):
    plan = fx.chips(spark, sf_dir).transform(tf.train_transforms([0.5] * 4, [0.1] * 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_custom_transform_holds_few_outputs(spark, monkeypatch):
    monkeypatch.setattr(ops, "OUTPUT_BYTES", 100)
    rows = spark.createDataFrame([(i, 0, 1, 2, 2, [float(i)] * 4) for i in range(20)], CHIP)
    assert sorted(sum(r.px) for r in ops.apply_transform(rows, lambda a: a + 1).collect()) == [4.0 * (i + 1) for i in range(20)]


def test_jitter_is_one_draw_per_channel(spark):
    v = array_of(chip(spark, np.stack([np.full((2, 2), 1.0), np.full((2, 2), 1.0)])).transform(tf.spectral_jitter(0.1, 0.1, 5)))
    assert len(set(v[0].ravel())) == 1 and len(set(v[1].ravel())) == 1 and v[0, 0, 0] != v[1, 0, 0]
    assert (np.abs(v - 1.0) <= 0.2).all()


def test_ndvi_channel(spark):
    a = np.array([[[100.0]], [[300.0]]])
    got = array_of(ops.add_ndvi(chip(spark, a), ["B04", "B08"]))
    assert got.shape == (3, 1, 1) and math.isclose(got[2, 0, 0], (200 / 400.001 + 1) * 5000)
    assert array_of(ops.add_ndvi(chip(spark, a), ["B04", "B03"])).shape == (2, 1, 1)


def test_custom_transform_may_change_shape(spark):
    got = array_of(ops.apply_transform(chip(spark, np.arange(8.0).reshape(2, 2, 2)), lambda a: a[:1] * 2))
    np.testing.assert_array_equal(got, [[[0, 2], [4, 6]]])


def test_long_form_round_trip(spark):
    df = chip(spark, np.arange(24.0).reshape(2, 3, 4))
    np.testing.assert_array_equal(array_of(ops.collect_chips(ops.explode_chips(df))), array_of(df))


def test_stacks_need_each_band_once_and_one_size(spark):
    rows = [(1, "B04", 1, 1, [1]), (1, "B08", 1, 1, [2]), (2, "B04", 1, 1, [1]), (2, "B04", 1, 1, [3]), (3, "B04", 2, 2, [1, 1, 1, 1]), (3, "B08", 1, 1, [2])]
    df = spark.createDataFrame(rows, "field_id long, band string, h int, w int, px array<int>").withColumn("window_idx", F.lit(0))
    assert [(r.field_id, r.px) for r in ops.stack_bands(df, ["B08", "B04"]).collect()] == [(1, [2, 1])]


def test_resize_output_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(ops, "OUTPUT_BYTES", 4 * 8 * 16 * 3)
    rng = np.random.default_rng(1)
    rows = [(i, 0, 3, 2, 2, rng.random(12).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, CHIP).coalesce(1)
    got = {r.chip_id: r.px for r in ops.resize_bilinear(df, 4).collect()}
    monkeypatch.setattr(ops, "OUTPUT_BYTES", 1 << 30)
    assert got == {r.chip_id: r.px for r in ops.resize_bilinear(df, 4).collect()} and len(got) == 20
    assert [*ops._bounded(np.array([1, 2, 9, 1]), 4)][-1][1] == 4


def test_multitemporal_shuffles_pixels_once(spark, sf_dir):
    df = ops.multitemporal_chips(fx.obs(spark, sf_dir), ["B04", "B08"], 3, 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(field_id") == 1


def test_series_grid_pads_the_tail(spark):
    df = spark.createDataFrame([(1, t, 0, 10 + t) for t in range(5)], "sample_id long, t int, c int, v long")
    got = {(r.y, r.x): r.v for r in ops.series_to_grid(df).collect()}
    assert got == {(i // 3, i % 3): (10 + i if i < 5 else 0) for i in range(9)}


def test_select_task(spark):
    df = spark.createDataFrame([("Uz-crop", 1), ("Ke-crop", 2)], "task_id string, v int")
    assert [r.v for r in ops.select_task(df, "Uz").collect()] == [1]
    with pytest.raises(Exception, match="no task"):
        ops.select_task(df, "Mars").collect()


def test_band_stats_match_numpy_under_any_layout(spark, sf_dir):
    chips = fx.chips(spark, sf_dir)
    a = np.array([r.px for r in chips.select("px").collect()], float).reshape(-1, 4, 16) / 1e4
    for parts in (1, 17):
        rows = stats.band_stats(chips.repartition(parts)).orderBy("c").collect()
        np.testing.assert_allclose([r["mean"] for r in rows], a.mean(axis=(0, 2)))
        np.testing.assert_allclose([r["std"] for r in rows], a.std(axis=(0, 2)))
    assert stats.sample_chips(chips, 10, 1).count() == 10
    assert stats.sample_chips(chips, 10**6, 1).count() == chips.count()
    mean, std = stats.stats_lists(stats.band_stats(chips))
    normed = array_of(chips.limit(1).transform(tf.val_transforms(mean, std)))
    assert normed.shape == (4, 4, 4)


def test_chip_checks(spark):
    rows = [
        (1, 0, 1, 1, 2, [1.0, 2.0]), (2, 5, 1, 1, 2, [1.0, 2.0]), (3, 0, 1, 1, 2, [1.0]), (4, None, 1, 1, 1, [1.0]), (5, 0, 1, 1, 1, None),
    ]
    df = spark.createDataFrame(rows, CHIP)
    r = stats.check_chips(df, 2, 1).first()
    assert (r.chips, r.no_image, r.no_label, r.bad_shape, r.label_too_large, r.channel_mismatch) == (5, 1, 1, 1, 1, 0)
    assert stats.require_valid(df.where("chip_id = 1"), 2).count() == 1
    for bad in (2, 3, 4, 5):
        with pytest.raises(Exception, match="invalid chip"):
            stats.require_valid(df.where(f"chip_id = {bad}"), 2).collect()


def test_synthetic_chips_separate_the_classes(spark):
    df = chip_io.synthetic_chips(spark.range(128).withColumnRenamed("id", "chip_id"), 4, 8, 2, 1)
    means = {r.class_idx: r.m for r in df.select("class_idx", F.explode("px").alias("v")).groupBy("class_idx").agg(F.avg("v").alias("m")).collect()}
    assert abs(means[0] - 1500) < 100 and abs(means[1] - 7500) < 100


def test_missing_chip_set_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        chip_io.read_chips(spark, str(tmp_path / "absent"))


def test_combine_skips_unlabelled_chips_and_moves_no_pixels(spark):
    rows = [(1, 1, 0, 1, 1, 1, [1.0]), (2, 2, None, 1, 1, 1, [1.0])]
    chips = spark.createDataFrame(rows, "tuman_code int, chip_id long, class_idx int, c int, h int, w int, px array<double>")
    assert [r.tuman_code for r in chip_io.combine_chips(chips).collect()] == [1]
    assert chip_io.combine_chips(chips, chips).count() == 2
    chosen = spark.createDataFrame([(2,)], "tuman_code int")
    assert chip_io.combine_chips(chips, selection=chosen).count() == 0
    plan = chip_io.combine_chips(chips, chips)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Exchange" not in stats.sample_chips(chips, 1, 1)._jdf.queryExecution().executedPlan().toString()
