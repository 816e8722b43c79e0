"""Block-stored rasters, windows cut from them, and the chips built from those."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow import fixtures as fx
from furrow.operators import chips as ops
from furrow.plans import build
from furrow.sources import rasters
from furrow.sources.scenes import footprints

RASTER = "scene_id string, band string, y0 int, h int, w int, px array<int>"
WINDOW = "field_id long, scene_id string, band string, col_off int, row_off int, width int, height int"


def strips(scene: str, band: str, raster: np.ndarray, lines: int):
    return [(scene, band, y, len(part), raster.shape[1], part.ravel().tolist()) for y in range(0, len(raster), lines) for part in [raster[y : y + lines]]]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    images = {("a", "B04"): rng.integers(0, 999, (37, 23)), ("a", "B08"): rng.integers(0, 999, (18, 11)), ("b", "B04"): rng.integers(0, 999, (8, 8))}
    rows = [s for (scene, band), raster in images.items() for s in strips(scene, band, raster, 5)]
    path = str(tmp_path_factory.mktemp("rasters") / "blocks")
    rasters.write_blocks(rasters.blocks_from_strips(spark.createDataFrame(rows, RASTER).repartition(4), 8), path)
    return images, path


def test_strips_become_blocks(spark, stored):
    images, path = stored
    rows = rasters.read_blocks(spark, path).collect()
    assert {(r.scene_id, r.band, r.br, r.bc) for r in rows} == {
        (*key, y, x) for key, image in images.items() for y in range(-(-image.shape[0] // 8)) for x in range(-(-image.shape[1] // 8))
    }
    for r in rows:
        part = images[r.scene_id, r.band][r.br * 8 : r.br * 8 + 8, r.bc * 8 : r.bc * 8 + 8]
        assert (r.bh, r.bw) == part.shape and r.px == part.ravel().tolist()
    assert {r.band for r in rasters.read_blocks(spark, path, ["B08"]).collect()} == {"B08"}
    assert "PushedFilters: [In(band" in rasters.read_blocks(spark, path, ["B08", "B11"])._jdf.queryExecution().toString()


def test_windows_of_every_band_on_its_own_grid(spark, stored):
    images, path = stored
    rng = np.random.default_rng(6)
    wanted = []
    for i in range(60):
        key = list(images)[i % 3]
        h, w = images[key].shape
        y, x = int(rng.integers(0, h)), int(rng.integers(0, w))
        wanted.append((i, *key, x, y, int(rng.integers(1, w - x + 1)), int(rng.integers(1, h - y + 1))))
    wanted += [(100, "a", "B04", 0, 0, 23, 37), (101, "a", "B04", 3, 3, 0, 5), (102, "none", "B04", 0, 0, 2, 2)]
    got = {r.field_id: r for r in ops.cut_windows(spark.createDataFrame(wanted, WINDOW), rasters.read_blocks(spark, path), 8).collect()}
    assert set(got) == set(range(60)) | {100}
    for i, scene, band, x, y, w, h in wanted[:61]:
        np.testing.assert_array_equal(np.array(got[i].px).reshape(got[i].h, got[i].w), images[scene, band][y : y + h, x : x + w])
        assert got[i].band == band


def test_windows_without_a_band_take_all(spark, stored):
    images, path = stored
    rows = spark.createDataFrame([(1, "a", 2, 3, 4, 5)], "field_id long, scene_id string, col_off int, row_off int, width int, height int")
    got = {r.band: r.px for r in ops.cut_windows(rows, rasters.read_blocks(spark, path), 8).collect()}
    assert got == {b: images["a", b][3:8, 2:6].ravel().tolist() for b in ("B04", "B08")}


def test_a_hot_block_is_spread(spark):
    """Nine in ten windows in one block, no adaptive plan: no task has over twice the mean."""
    side, n = 64, 4000
    blocks = spark.range(20).select(
        F.lit("a").alias("scene_id"), F.lit("B04").alias("band"), F.lit(0).alias("br"), F.col("id").cast("int").alias("bc"),
        F.lit(side).alias("bh"), F.lit(side).alias("bw"), F.sequence(F.lit(0), F.lit(side * side - 1)).alias("px"),
    )
    at = F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id") / 10 % 20).cast("int")
    windows = spark.range(n).select(
        F.col("id").alias("field_id"), F.lit("a").alias("scene_id"), F.lit("B04").alias("band"), (at * side + 5).alias("col_off"), F.lit(3).alias("row_off"),
        F.lit(2).alias("width"), F.lit(2).alias("height"),
    )
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        pieces = ops.block_pieces(windows, blocks, side, ["field_id"])
        sizes = [r["count"] for r in pieces.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) <= 2 * n / 4
        assert ops.cut_windows(windows, blocks, side).where(F.size("px") == 4).count() == n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_single_window_build(spark, sf_dir):
    bands = {"B04": 0.01, "B12": 0.01}
    fields = build.labelled_fields(fx.fields(spark, sf_dir), n_per_region=3, per_class=500, seed=1)
    scenes = footprints(fx.scenes(spark, sf_dir))
    blocks = fx.raster_blocks(spark, sf_dir, list(bands))
    chips = build.build_chips_single(fields, scenes, blocks, bands, 3, fx.RASTER_BLOCK, min_px=2).collect()
    assert chips and all((c.c, c.h, c.w) == (2, 3, 3) and len(c.px) == 18 for c in chips)
    known = {r.field_id: (r.tuman_code, r.class_idx) for r in fields.collect()}
    assert all(known[c.chip_id] == (c.tuman_code, c.class_idx) for c in chips)
    # A scene without B12 gives no chip, and the field is not moved to another scene.
    from furrow.operators.assign import assign_best_scene

    best = {r.field_id: r.scene_id for r in assign_best_scene(fields, scenes).collect()}
    owners = {r.scene_id for r in fx.scenes(spark, sf_dir).where(F.map_contains_key("assets", F.lit("B12"))).collect()}
    assert all(best[c.chip_id] in owners for c in chips)
    larger = build.build_chips_single(fields, scenes, blocks, bands, 3, fx.RASTER_BLOCK, min_px=4)
    assert {r.chip_id for r in larger.collect()} < {c.chip_id for c in chips}


def test_a_repeated_band_is_no_chip(spark):
    obs = spark.createDataFrame([(0, 1, "B04"), (0, 1, "B08"), (0, 2, "B04"), (0, 2, "B04")], "window_idx int, field_id long, band string")
    obs = obs.withColumns({"h": F.lit(4), "w": F.lit(4), "res": F.lit(0.0001)})
    report = ops.window_report(obs, spark.range(3), ["B04", "B08"], 1).first()
    assert (report.chips, report.too_small, report.no_scene) == (1, 1, 1)


def test_a_reader_is_asked_for_wanted_places_only(spark, stored):
    images, path = stored
    wanted = spark.createDataFrame([(1, "a", "B04", 2, 3, 4, 4), (2, "a", "B04", 17, 30, 3, 3), (3, "b", "B04", 0, 0, 2, 2)], WINDOW)
    asked = []

    def read(places):
        asked.extend(tuple(r) for r in places.select("scene_id", "band", "br", "bc").collect())
        return rasters.read_blocks(spark, path).join(places, ["scene_id", "band", "br", "bc"], "left_semi")

    got = {r.field_id: r.px for r in ops.cut_windows(wanted, read, 8).collect()}
    assert sorted(asked) == [("a", "B04", 0, 0), ("a", "B04", 3, 2), ("a", "B04", 4, 2), ("b", "B04", 0, 0)]
    assert got == {r.field_id: r.px for r in ops.cut_windows(wanted, rasters.read_blocks(spark, path), 8).collect()}


def test_a_window_moves_on_once_per_block(spark, stored):
    """Neither its lines nor its bands become rows of their own before they are shuffled."""
    images, path = stored
    rows = spark.createDataFrame([(1, "a", 2, 3, 18, 9)], "field_id long, scene_id string, col_off int, row_off int, width int, height int")
    blocks = rasters.read_blocks(spark, path).where("band = 'B04'")
    cut = ops.cut_windows(rows, blocks, 8)
    made = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(sequence")
    assert made(cut) == made(ops.block_pieces(rows, blocks, 8, ["field_id"]))
    assert cut.collect()[0].px == images["a", "B04"][3:12, 2:20].ravel().tolist()


@pytest.mark.parametrize("band", [False, True])
@pytest.mark.parametrize("per_copy,cut", [(10_000, 5), (10, 50)])
def test_equal_windows_are_cut_once(spark, stored, monkeypatch, band, per_copy, cut):
    """500 fields share five windows: those are cut, or a copy of each for every so many rows."""
    images, path = stored
    rows = [(i, "a", *([("B04", "B08")[i % 2]] if band else []), i % 5, 3, 4, 2 + i % 5) for i in range(500)]
    windows = spark.createDataFrame(rows, WINDOW if band else WINDOW.replace(" band string,", ""))
    sizes, pieces = [], ops.block_pieces
    monkeypatch.setattr(ops, "ROWS_PER_COPY", per_copy)
    monkeypatch.setattr(ops, "block_pieces", lambda w, *rest: sizes.append(w.count()) or pieces(w, *rest))
    got = {(r.field_id, r.band): (r.h, r.w, r.px) for r in ops.cut_windows(windows, rasters.read_blocks(spark, path), 8).collect()}
    assert sizes == [cut * (2 if band and per_copy > 100 else 1)]
    for i, *_ in rows:
        for b in [("B04", "B08")[i % 2]] if band else ["B04", "B08"]:
            h, w = 2 + i % 5, 4
            part = images["a", b][3 : 3 + h, i % 5 : i % 5 + w]
            assert got.pop((i, b)) == (h, w, part.ravel().tolist())
    assert not got
