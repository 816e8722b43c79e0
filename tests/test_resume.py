"""Builds that stop and go on, and statistics that grow by districts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from furrow import fixtures as fx
from furrow.operators import stats
from furrow.plans import build
from furrow.sources import chips as chip_io


def files(path) -> dict[str, float]:
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet") if "tuman_code=" in str(p) and p.stat().st_size}


def chips_of(rows):
    """Stands for a build: one chip per field."""
    return rows.select(F.col("field_id").alias("chip_id"), "tuman_code", F.array(F.col("field_id")).alias("px"))


@pytest.fixture
def labelled(spark):
    return spark.range(60).select(F.col("id").alias("field_id"), (F.col("id") % 10 + 1700200).cast("int").alias("tuman_code")).cache()


def test_a_stopped_build_goes_on(spark, labelled, tmp_path):
    path = str(tmp_path / "chips")
    assert build.build_in_steps(labelled, chips_of, path, per_step=3, max_steps=2) == 2
    before = files(tmp_path)
    assert {r.tuman_code for r in chip_io.finished_districts(spark, path).collect()} == set(range(1700200, 1700206))
    assert build.build_in_steps(labelled, chips_of, path, per_step=3) == 2
    after = files(tmp_path)
    assert {p: t for p, t in after.items() if p in before} == before  # finished districts are not rewritten
    assert sorted(r.chip_id for r in chip_io.read_finished(spark, path).collect()) == list(range(60))
    assert build.build_in_steps(labelled, chips_of, path) == 0 and files(tmp_path) == after


def test_a_build_that_dies_inside_a_step(spark, labelled, tmp_path):
    """Rows without markers are neither read nor kept."""
    path = str(tmp_path / "chips")
    build.build_in_steps(labelled, chips_of, path, per_step=4, max_steps=1)
    # Rows of an attempt that stored something else and died before its markers.
    chips_of(labelled.where("tuman_code = 1700207")).withColumn("chip_id", F.col("chip_id") + 1000).write.mode("append").partitionBy("tuman_code").parquet(f"{path}/rows")
    assert len(chip_io.read_finished(spark, path).collect()) == 24

    def failing(rows):
        bad = F.when(F.col("chip_id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("chip_id"))
        return chips_of(rows).withColumn("chip_id", bad)

    with pytest.raises(Exception, match="lost"):
        build.build_in_steps(labelled, failing, path, per_step=1)
    assert {r.tuman_code for r in chip_io.finished_districts(spark, path).collect()} == {1700200 + i for i in (0, 1, 2, 3, 4)}
    build.build_in_steps(labelled, chips_of, path, per_step=2)
    assert sorted(r.chip_id for r in chip_io.read_finished(spark, path).collect()) == list(range(60))


def test_a_district_without_chips_is_finished(spark, labelled, tmp_path):
    path = str(tmp_path / "chips")
    build.build_in_steps(labelled, lambda rows: chips_of(rows).where("tuman_code % 2 = 0"), path)
    assert build.build_in_steps(labelled, chips_of, path) == 0
    assert chip_io.read_finished(spark, path).count() == 30


def test_merged_moments_are_those_of_all_pixels(spark, sf_dir, tmp_path):
    """Bit for bit, whichever districts come first, and stored districts are not read again."""
    path = str(tmp_path / "moments")
    one, two = fx.chip_sets(spark, sf_dir)
    every = chip_io.union_chips(one, two)
    want = sorted(map(tuple, stats.band_stats(every).collect()))
    stats.store_moments(two, path)
    first = files(tmp_path)
    # Pixels of stored districts would show if they were added again.
    broken = chip_io.union_chips(one, two.withColumn("px", F.transform("px", lambda v: v * 2)))
    merged = stats.merged_stats(stats.store_moments(broken, path))
    assert sorted(map(tuple, merged.collect())) == want
    assert {p: t for p, t in files(tmp_path).items() if p in first} == first
    assert sorted(map(tuple, stats.merged_stats(stats.store_moments(every, path)).collect())) == want
