"""Spatial assignment against brute force, at every size of field and scene."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from furrow.functions import geometry
from furrow.functions.projection import bounds_to_utm, bounds_to_wgs84
from furrow.operators import assign
from furrow.sources.scenes import download_plan, footprints, in_date_range, search_scenes

FIELD = "field_id long, x0 double, y0 double, x1 double, y1 double"
SCENE = "scene_id string, cloud_cover double, lon_min double, lat_min double, lon_max double, lat_max double"


def boxes(rng, n, low, high, quantum=0.125, spread=8.0):
    out = []
    for _ in range(n):
        x, y = (round(rng.uniform(-spread, spread) / quantum) * quantum for _ in range(2))
        w, h = (max(quantum, round(rng.uniform(low, high) / quantum) * quantum) for _ in range(2))
        out.append((x, y, x + w, y + h))
    return out


def touch(a, b):
    return a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]


@pytest.mark.parametrize("scene_size", [(0.125, 0.5), (1, 4), (0.125, 30)])
@pytest.mark.parametrize("cell", [0.25, 1.0])
def test_best_scene_is_exact(spark, scene_size, cell):
    rng = random.Random(5)
    # Values on a coarse lattice make shared edges and equal clouds common.
    fields = [(i, *b) for i, b in enumerate(boxes(rng, 150, 0.125, 0.25) + boxes(rng, 50, 0.125, 9))]
    scenes = [(f"s{i:03d}", float(rng.randrange(12) * 2), *b) for i, b in enumerate(boxes(rng, 80, *scene_size))]
    scenes += [(f"t{i:03d}", 1.0, *scenes[0][2:]) for i in range(40)]
    want = {}
    for f in fields:
        hits = [(s[1], s[0]) for s in scenes if s[1] < 20 and touch(f[1:], s[2:])]
        want[f[0]] = min(hits)[1] if hits else None
    got = assign.assign_best_scene(
        spark.createDataFrame(fields, FIELD), spark.createDataFrame(scenes, SCENE), cell=cell, unassigned=True
    )
    assert {r.field_id: r.scene_id for r in got.collect()} == want


def test_candidates_stay_few_under_many_covering_scenes(spark):
    """A third of all scenes over one spot adds no candidates per field."""
    scenes = [(f"s{i:04d}", float(i % 19), 10.0 + i * 1e-4, 10.0, 14.0, 14.0) for i in range(600)]
    fields = [(i, 12.0 + i * 1e-3, 12.0, 12.01 + i * 1e-3, 12.01) for i in range(200)]
    cells = assign.candidate_cells(spark.createDataFrame(scenes, SCENE), assign._cloud_order(), [0.25])
    pairs = assign._candidates(spark.createDataFrame(fields, FIELD), cells, 0.25)
    assert pairs.count() == 200


@pytest.mark.parametrize("size", [0.3, 5.0, 70.0])
def test_candidates_grow_with_the_field_and_not_the_catalogue(spark, size):
    """Per cell a field meets, about one scene is left of the hundreds that cover it."""
    rng = random.Random(3)
    scenes = [(f"s{i:05d}", float(i % 19), x, y, x + 3.3, y + 3.3) for i, (x, y) in enumerate((rng.uniform(-40, 40), rng.uniform(-40, 40)) for _ in range(6000))]
    cells = assign.candidate_cells(spark.createDataFrame(scenes, SCENE), assign._cloud_order(), [0.25])
    pairs = assign._candidates(spark.createDataFrame([(1, -size / 2, -size / 2, size / 2, size / 2)], FIELD), cells, 0.25)
    assert pairs.count() <= 8 * (size / 0.25 + 2) ** 2
    assert cells.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] <= 60


@pytest.mark.parametrize("size,most", [(0.3, 3), (5.0, 12), (70.0, 400)])
def test_first_yielding_tests_few_scenes(spark, size, most):
    """Of the hundreds of scenes over a field, those before the first that must yield are tested."""
    rng = random.Random(4)
    native = [utm_scene(f"s{i:05d}", rng.randrange(200_000, 700_000, 10), rng.randrange(3_900_000, 4_800_000, 10), 110_000, 110_000) for i in range(3000)]
    raw = spark.createDataFrame(native, "scene_id string, epsg int, res double, nx0 double, ny0 double, nx1 double, ny1 double")
    index = assign.scene_index(raw.withColumns({c: F.lit(0.0) for c in assign._BOX})).cache()
    fields = spark.createDataFrame([(1, 63.1 - size / 2, 40.1 - size / 2, 63.1 + size / 2, 40.1 + size / 2)], FIELD)
    extra = ["scene_id", "epsg", "res", "nx0", "ny0", "nx1", "ny1"]
    enough = (F.col("chip.width") >= 8) & (F.col("chip.height") >= 8)
    pairs = assign.quadtree_candidates(fields, index, F.struct("scene_id"), 0.25, extra, [], lambda found: assign.with_chip_window(found).where(enough))
    assert 0 < pairs.count() <= most
    touching = fields.crossJoin(index).where(geometry.boxes_touch(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], *[F.col(c) for c in assign._BOX]))
    assert touching.count() > 20 * (1 if size < 1 else 10)
    want = assign.with_chip_window(touching).where(enough).agg(F.min("scene_id")).first()[0]
    assert [r.scene_id for r in assign.assign_first_yielding(fields, index, 8).collect()] == ([want] if want else [])


@pytest.mark.parametrize("cell", [0.25, 0.5])
def test_quadtree_cells_tile_every_field(spark, cell):
    rng = random.Random(8)
    rows = [(i, *b) for i, b in enumerate(boxes(rng, 40, 0.125, 9) + boxes(rng, 10, 0.01, 3, quantum=0.01) + [(0.0, 0.0, 4.0, 8.0), (-1.0, 0.3, 6.0, 0.31)])]
    finest = assign.quadtree_sides(cell)[0]
    tiled: dict[int, list] = {}
    for r in assign.quadtree_cells(spark.createDataFrame(rows, FIELD), cell).collect():
        n = round(r.side / finest)
        tiled.setdefault(r.field_id, []).extend((r.cx * n + i, r.cy * n + j) for i in range(n) for j in range(n))
        box = rows[r.field_id][1:]
        within = box[0] <= r.cx * r.side and (r.cx + 1) * r.side <= box[2] and box[1] <= r.cy * r.side and (r.cy + 1) * r.side <= box[3]
        assert within == r.inside or (r.side == finest and not r.inside)
    for i, x0, y0, x1, y1 in rows:
        want = {(x, y) for x in range(math.floor(x0 / finest), math.floor(x1 / finest) + 1) for y in range(math.floor(y0 / finest), math.floor(y1 / finest) + 1)}
        assert len(tiled[i]) == len(want) and set(tiled[i]) == want
        assert not any(r == () for r in tiled[i])


@pytest.mark.parametrize("native", [False, True])
def test_candidates_stay_few_along_a_rim(spark, native):
    """Hundreds of scenes reach into a cell from one side and none covers it."""
    rng = random.Random(6)
    scenes = [(f"s{i:04d}", 32641, 10.0, float(i % 19), 61.0, 39.0, 63.05 + rng.random() * 0.4, 42.0) for i in range(400)]
    df = spark.createDataFrame(scenes, "scene_id string, epsg int, res double, cloud_cover double, lon_min double, lat_min double, lon_max double, lat_max double")
    fields = spark.createDataFrame([(i, 63.0 + i * 0.002, 40.3, 63.004 + i * 0.002, 40.31) for i in range(120)], FIELD)
    if native:
        index = assign.scene_index(assign.native_extents(df))
        cells = assign.candidate_cells(index, F.struct("scene_id"), [0.25], kind=["epsg"], tag_covers=assign._tag_native_covers)
        pairs = assign.with_chip_window(fields.crossJoin(index).where(geometry.boxes_touch(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], *[F.col(c) for c in assign._BOX])))
        want = pairs.where("chip.width >= 8 and chip.height >= 8").groupBy("field_id").agg(F.min("scene_id").alias("s"))
        got = assign.assign_first_yielding(fields, index, 8)
    else:
        cells = assign.candidate_cells(df, assign._cloud_order(), [0.25])
        pairs = fields.crossJoin(df).where(geometry.boxes_touch(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], *[F.col(c) for c in assign._BOX]))
        want = pairs.groupBy("field_id").agg(F.min(F.struct("cloud_cover", "scene_id"))["scene_id"].alias("s"))
        got = assign.assign_best_scene(fields, df)
    assert cells.where("cy between 157 and 166").groupBy("cx", "cy").count().agg(F.max("count")).first()[0] <= 30
    assert {r.field_id: r.scene_id for r in got.collect()} == {r.field_id: r.s for r in want.collect()} != {}


def test_fields_of_crowded_cells_are_exact(spark, monkeypatch):
    """Cells with more scenes than a row lists, or where three zones meet."""
    rng = random.Random(10)
    native = [utm_scene(f"s{i:03d}", rng.randrange(300000, 500000, 10), rng.randrange(4300000, 4500000, 10), rng.randrange(2000, 60000, 10), rng.randrange(2000, 60000, 10), 32640 + i % 3) for i in range(60)]
    raw = spark.createDataFrame(native, "scene_id string, epsg int, res double, nx0 double, ny0 double, nx1 double, ny1 double")
    index = assign.scene_index(raw.withColumns({c: F.lit(0.0) for c in assign._BOX}).withColumn("epsg", F.lit(32641))).withColumn("cloud_cover", F.lit(1.0)).cache()
    index = index.withColumn("epsg", (F.lit(32640) + F.substring("scene_id", 2, 3).cast("int") % 3).cast("int"))
    fields = spark.createDataFrame([(i, x, y, x + 0.01, y + 0.01) for i in range(60) for x, y in [(rng.uniform(61, 64), rng.uniform(38.8, 40.6))]], FIELD)

    def found():
        first = assign.assign_first_yielding(fields, index, 8, unassigned=True)
        return sorted(map(str, first.collect())), sorted(map(str, assign.assign_best_scene(fields, index, unassigned=True).collect()))

    rows = found()
    touching = fields.crossJoin(index).where(geometry.boxes_touch(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], *[F.col(c) for c in assign._BOX]))
    large = assign.with_chip_window(touching).where("chip.width >= 8 and chip.height >= 8").groupBy("field_id").agg(F.min("scene_id").alias("s"))
    got = assign.assign_first_yielding(fields, index, 8)
    assert {r.field_id: r.scene_id for r in got.collect()} == {r.field_id: r.s for r in large.collect()}
    monkeypatch.setattr(assign, "LISTED", 1)
    assert found() == rows and len(rows[0]) == len(rows[1]) == 60


def utm_scene(scene_id, left, bottom, width, height, epsg=32641, res=10.0):
    return (scene_id, epsg, res, *map(float, (left, bottom, left + width, bottom + height)))


def test_first_yielding_is_exact(spark):
    rng = random.Random(9)
    native = [
        utm_scene(f"s{i:03d}", rng.randrange(300000, 500000, 10) + (5 if i % 7 == 0 else 0), rng.randrange(4300000, 4500000, 10), rng.randrange(2000, 120000, 10), rng.randrange(2000, 120000, 10), 32641 + i % 2)
        for i in range(60)
    ]
    raw = spark.createDataFrame(native, "scene_id string, epsg int, res double, nx0 double, ny0 double, nx1 double, ny1 double")
    raw = raw.withColumns({c: F.lit(0.0) for c in assign._BOX})
    index = assign.scene_index(raw).cache()
    rows = [(i, x, y, x + s, y + s) for i in range(120) for x, y, s in [(rng.uniform(61, 64), rng.uniform(38.8, 40.6), rng.choice([0.0005, 0.004, 0.03, 0.4, 1.7]))]]
    fields = spark.createDataFrame(rows, FIELD)
    got = {r.field_id: r for r in assign.assign_first_yielding(fields, index, 8, unassigned=True).collect()}
    pairs = fields.crossJoin(index).where(
        geometry.boxes_touch(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], *[F.col(c) for c in assign._BOX])
    )
    want, overlap = {}, set()
    for r in assign.with_chip_window(pairs).orderBy("scene_id").collect():
        overlap.add(r.field_id)
        if r.chip and r.chip.width >= 8 and r.chip.height >= 8:
            want.setdefault(r.field_id, (r.scene_id, r.chip.width, r.chip.height))
    assert len(want) > 40
    for i, *_ in rows:
        assert bool(got[i].overlaps) == (i in overlap)
        assert (got[i].scene_id, got[i].w, got[i].h) == want.get(i, (None, None, None))


def test_utm_round_trip_and_known_point(spark):
    # On the central meridian the easting is exactly 500 km.
    rows = [(1, 63.0, 40.0, 63.5, 40.5, 32641), (2, 69.2, 41.2, 69.3, 41.4, 32642), (3, 20.0, -34.0, 20.5, -33.5, 32734)]
    df = spark.createDataFrame(rows, "i int, x0 double, y0 double, x1 double, y1 double, epsg int")
    back = bounds_to_wgs84(bounds_to_utm(df, "x0", "y0", "x1", "y1", "epsg"), "ux0", "uy0", "ux1", "uy1", "epsg")
    for r in back.collect():
        # The projected box contains the field, so going back never shrinks it.
        assert r.gx0 <= r.x0 + 1e-8 and r.gx1 >= r.x1 - 1e-8 and r.gy0 <= r.y0 + 1e-8 and r.gy1 >= r.y1 - 1e-8
        if r.i == 1:
            assert math.isclose(r.ux0, 500000.0, abs_tol=1e-6)
            assert math.isclose(r.uy0, 4427757.219, abs_tol=0.01)
    point = spark.createDataFrame([(69.24, 41.3, 69.24, 41.3, 32642)], "x0 double, y0 double, x1 double, y1 double, epsg int")
    r = bounds_to_wgs84(bounds_to_utm(point, "x0", "y0", "x1", "y1", "epsg"), "ux0", "uy0", "ux1", "uy1", "epsg").first()
    assert math.isclose(r.gx0, 69.24, abs_tol=1e-8) and math.isclose(r.gy0, 41.3, abs_tol=1e-8)


def test_geographic_rows_keep_their_bounds(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 4326)], "x0 double, y0 double, x1 double, y1 double, epsg int")
    r = bounds_to_utm(df, "x0", "y0", "x1", "y1", "epsg").first()
    assert (r.ux0, r.uy0, r.ux1, r.uy1) == (1.0, 2.0, 3.0, 4.0)


def test_footprint_prefers_the_ring(spark):
    ring = [[1.0, 2.0], [3.0, 2.0], [3.0, 5.0], [1.0, 2.0]]
    rows = [("a", ("Polygon", [ring]), [0.0, 0.0, 9.0, 9.0]), ("b", ("MultiPolygon", [ring]), [0.0, 0.0, 9.0, 9.0]), ("c", None, None)]
    df = spark.createDataFrame(rows, "scene_id string, geometry struct<type:string,coordinates:array<array<array<double>>>>, bbox array<double>")
    got = {r.scene_id: (r.lon_min, r.lat_min, r.lon_max, r.lat_max) for r in footprints(df).collect()}
    assert got == {"a": (1, 2, 3, 5), "b": (0, 0, 9, 9)}


def test_date_range_is_closed_and_cloud_is_strict(spark):
    df = spark.createDataFrame(
        [("a", "2025-05-01 00:00:00", 19.9), ("b", "2025-05-31 23:59:59", 0.0), ("c", "2025-06-01 00:00:00", 0.0), ("d", "2025-05-10 00:00:00", 20.0)],
        "scene_id string, t string, cloud_cover double",
    ).select("scene_id", F.to_timestamp("t").alias("datetime"), "cloud_cover", *[F.lit(v).alias(c) for c, v in zip(assign._BOX, (0.0, 0.0, 1.0, 1.0))])
    got = {r.scene_id for r in search_scenes(df, (1, 1, 2, 2), "2025-05-01", "2025-05-31").collect()}
    assert got == {"a", "b"}
    assert df.where(in_date_range(F.col("datetime"), F.lit("2025-06-01").cast("date"), F.lit("2025-06-01").cast("date"))).count() == 1


def test_download_plan(spark):
    scenes = spark.createDataFrame([("s", {"B02": "u"}), ("t", {"B02": "v", "B03": "w"})], "scene_id string, assets map<string,string>")
    done = spark.createDataFrame([("t_B02.tif",)], "path string")
    got = {(r.path, r.status) for r in download_plan(scenes, ["B02", "B03"], done).collect()}
    assert got == {("s_B02.tif", "todo"), ("s_B03.tif", "missing"), ("t_B03.tif", "todo")}


def test_pixel_window_floor_ceil_and_clamp(spark):
    args = [F.lit(float(v)) for v in (1.5, 0.5, 3.2, 2.0, 1.0, 4.0, 0.5)]
    w = spark.range(1).select(geometry.pixel_window(*args, F.lit(4), F.lit(6)).alias("w")).first().w
    assert tuple(w) == (1, 4, 3, 2)
