"""Labels, geometry text, filters, districts and samples."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from furrow import fixtures as fx
from furrow.functions import geometry, labels, text
from furrow.operators import filters, regions
from furrow.operators.ranking import bucketed_rank, shuffled_rank
from furrow.sources import collections, fields as field_io
from furrow.sources.scenes import check_bbox, parse_aoi, resolve_aoi


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_label(spark):
    got = column(spark, [" Bugdoy ", "bugdoy, other", "BUGDOY, paxta", "other, bugdoy", "paxta, other", "\tx\n", None], labels.normalize_label)
    assert got == ["bugdoy", "bugdoy", "bugdoy", "other", "paxta, other", "x", None]


def test_wkt_bounds(spark):
    wkts = [
        "POLYGON ((1 2, 3 2, 3 5, 1 5, 1 2))",
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((-7.5 -2e1, 4 4, 5 5, -7.5 -20)))",
        "polygon z ((1 2 9, 3 2 9, 3 5 9, 1 2 9))",
        "MULTIPOLYGON EMPTY",
        "POLYGON ((1 x, 2 3, 1 x))",
        "POINT (1 2)",
        "garbage",
        None,
    ]
    got = [tuple(b) if b else None for b in column(spark, wkts, geometry.wkt_bounds)]
    assert got == [(1, 2, 3, 5), (-7.5, -20, 5, 5), (1, 2, 3, 5), None, None, None, None, None]
    assert column(spark, wkts, geometry.is_polygon_wkt) == [True, True, True, True, False, False, False, None]


def test_wkt_coordinates_keep_polygons_and_rings(spark):
    wkt = "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1)), ((20 20, 21 20, 21 21, 20 20)))"
    (got,) = column(spark, [wkt], geometry.wkt_coordinates)
    assert [[len(ring) for ring in poly] for poly in got] == [[4, 4], [4]]
    assert got[0][1][2] == [2.0, 2.0] and got[1][0][0] == [20.0, 20.0]


def test_bbox_rules(spark):
    rows = [(1.0, 2.0, 3.0, 4.0), (3.0, 2.0, 1.0, 4.0), (1.0, 4.0, 3.0, 2.0), (-181.0, 0.0, 1.0, 1.0), (0.0, -91.0, 1.0, 1.0), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "lon_min double, lat_min double, lon_max double, lat_max double")
    got = [r["error"] for r in filters.bbox_check(df).collect()]
    assert got == [
        None,
        "empty in longitude",
        "empty in latitude",
        "longitude out of range",
        "latitude out of range",
        "missing coordinate",
    ]
    for bad in ([1, 2, 3], [3, 2, 1, 4], [0, -91, 1, 1]):
        with pytest.raises(ValueError):
            check_bbox(bad)
    assert resolve_aoi(bbox="1,2,3,4") == (1, 2, 3, 4)
    texts = spark.createDataFrame([("1,2,3,4",), ("1,2,3",), ("1,2,x,4",), ("5,2,3,4",)], "t string")
    assert [r["error"] for r in parse_aoi(texts, "t").collect()] == [
        None, "expected four numbers", "expected four numbers", "empty in longitude",
    ]


def test_bbox_ring_is_closed(spark):
    (ring,) = [r[0] for r in spark.range(1).select(geometry.bbox_ring(*[F.lit(float(v)) for v in (1, 2, 3, 4)])).collect()]
    assert ring == [[1, 2], [3, 2], [3, 4], [1, 4], [1, 2]]


def test_lists_windows_and_asset_names(spark):
    assert column(spark, [" a, ,b,, c "], text.parse_list) == [["a", "b", "c"]]
    (got,) = column(spark, ["2025-04-01:2025-05-31, ,x:y:z, 2025-06-01"], text.parse_windows)
    assert [(str(w["d0"]), w["error"]) for w in got] == [
        ("2025-04-01", None), ("None", "expected start:end"), ("None", "expected start:end"),
    ]
    paths = ["raw/S2_A_B8A.tif", "S2_B_B02.tif", "S2_C.tif"]
    assert column(spark, paths, text.asset_scene) == ["S2_A", "S2_B", "S2_C"]
    assert column(spark, paths, text.asset_band) == ["B8A", "B02", None]


def test_exclusion_replaces_equality_and_keeps_missing_codes(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "field_id long, tuman_code int")
    assert [r.field_id for r in filters.filter_tuman(df, 5, [5]).orderBy("field_id").collect()] == [2, 3]
    assert [r.field_id for r in filters.filter_tuman(df, 5).collect()] == [1]


def test_limit_comes_before_skipping(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "g", "b"), (3, "g", "c")], "field_id long, geom_2 string, crop_type string")
    assert field_io.labelled(filters.limit_fields(df, 2)).count() == 1


def test_top_districts_order(spark):
    rows = [("A", "t1", 1, 5), ("  A", "t2", 2, 9), ("A", "t3", 3, 7), (None, "t4", 4, 1), ("", "t5", 5, 2), (" ", "t6", 6, 3)]
    counts = spark.createDataFrame(rows, "viloyat string, tuman string, tuman_code int, polygons long")
    got = {}
    for r in regions.top_districts(counts, 2).orderBy("region", "rank").collect():
        got.setdefault(r.region, []).append(r.tuman_code)
    # The raw name sorts first inside a region: "  A" comes before "A".
    assert got == {"": [6], "A": [2, 3], "unknown": [4, 5]}


@pytest.mark.parametrize("n", [1, 999, 1000, 1001, 5000])
def test_samples_of_any_size_treat_missing_labels_as_a_class(spark, n):
    label = F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 3 == 1, "a")
    df = spark.range(4500).select(F.col("id").alias("field_id"), label.alias("crop_type"))
    got = {r["crop_type"]: r["count"] for r in regions.sample_per_class(df, n, 3).groupBy("crop_type").count().collect()}
    assert got == {k: min(n, 1500) for k in ("a", "b", None)}
    rows = {tuple(r) for r in regions.sample_per_class(df, n, 3).collect()}
    assert rows == {tuple(r) for r in regions.sample_per_class(df.repartition(7), n, 3).collect()}


def test_open_and_short_rings_are_no_polygons(spark):
    wkts = ["POLYGON 1 2 3 4", "POLYGON ((0 0, 1 0, 1 1, 0 1))", "POLYGON ((0 0, 1 0, 0 0))", "POLYGON ((0 0, 1 0, 1 1, 0.0 0))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 6)))"]
    assert column(spark, wkts, geometry.is_polygon_wkt) == [False, False, False, True, False]
    assert [b is not None for b in column(spark, wkts, geometry.wkt_bounds)] == [False, False, False, True, False]
    df = spark.createDataFrame([(w,) for w in wkts], "geom_2 string")
    assert [r.x0 is not None for r in filters.with_bounds(df).collect()] == [False, False, False, True, False]


def test_geojson_polygons_and_other_types(spark, tmp_path):
    lines = [
        '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[1,2],[3,2],[3,4],[1,2]]]},"properties":{"crop_type":"a"}}',
        '{"type":"Feature","geometry":null,"properties":{"crop_type":"b"}}',
    ]
    (tmp_path / "ok.json").write_text("\n".join(lines))
    got = {r.crop_type: r.geometry for r in field_io.read_geojson(spark, str(tmp_path / "ok.json")).collect()}
    assert got["a"].type == "Polygon" and got["a"].coordinates == [[[[1, 2], [3, 2], [3, 4], [1, 2]]]] and got["b"] is None
    (tmp_path / "bad.json").write_text('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"crop_type":"a"}}')
    with pytest.raises(Exception, match="no polygon"):
        field_io.read_geojson(spark, str(tmp_path / "bad.json")).collect()
    rows = spark.createDataFrame([("POLYGON ((0 0, 1 0, 1 1, 0 0))", "x"), ("MULTIPOLYGON EMPTY", "y")], "geom_2 string, crop_type string")
    field_io.write_geojson(field_io.to_geojson_features(rows), str(tmp_path / "out"))
    text = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert any('"type":"Polygon","coordinates":[[[0.0,0.0]' in t for t in text) and any('"coordinates":[]' in t for t in text)


@pytest.mark.parametrize("parts", [1, 17])
def test_bucketed_rank_equals_plain_rank(spark, parts):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 1000).alias("v"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"))
    got = bucketed_rank(df.repartition(parts), F.floor(F.col("v") / 50), [F.col("v"), F.col("id")], ["g"])
    rows = got.collect()
    for g in ("x", "y"):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: (r.v, r.id))
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        assert {r.group_size for r in mine} == {len(mine)}


def test_shuffled_rank_is_a_permutation(spark):
    a = {r.id: r["rank"] for r in shuffled_rank(spark.range(1000), "id", 1).collect()}
    b = {r.id: r["rank"] for r in shuffled_rank(spark.range(1000).repartition(9), "id", 1).collect()}
    c = {r.id: r["rank"] for r in shuffled_rank(spark.range(1000), "id", 2).collect()}
    assert sorted(a.values()) == list(range(1000)) and a == b and a != c


def test_geojson_collection_and_missing_class_field(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(
        '{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon",\n'
        '"coordinates": [[[[1, 2], [3, 2], [3, 4], [1, 2]]]]}, "properties": {"crop_type": "paxta"}}]}'
    )
    df = field_io.read_geojson(spark, str(path), collection=True)
    assert [r.crop_type for r in df.collect()] == ["paxta"]
    with pytest.raises(Exception, match="not in"):
        field_io.read_geojson(spark, str(path), "other_field", collection=True).collect()
    with pytest.raises(AnalysisException):
        spark.read.parquet(str(tmp_path / "absent"))


def test_extent_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], "x0 double, y0 double, x1 double, y1 double")
    assert tuple(regions.extent(empty).first()) == (None,) * 4


def test_collections_are_read_in_byte_ranges(spark, tmp_path):
    """Cuts anywhere, odd spacing and key order, objects inside texts, objects after the list."""
    rng = random.Random(3)
    text = 'é{"type": "Feature"} 日本'
    features = [
        {"id": i, "type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [i, 1], [1, 1], [0, 0]]]}, "properties": {"crop_type": text * rng.randint(0, 3), "n": i}}
        for i in range(60)
    ]
    head = '{"type": "FeatureCollection", "name": "{x", "crs": {"type": "name", "properties": {"name": "q"}}, "features" :\n[ '
    body = " ,\n ".join(json.dumps(f, ensure_ascii=i % 2 == 0, indent=None if i % 3 else 1) for i, f in enumerate(features))
    (tmp_path / "one.geojson").write_text(head + body + '], "meta": {"a": {"b": 1}}}', encoding="utf-8")
    (tmp_path / "two.geojson").write_text('{"features": []}')
    for split in (64, 777, 1 << 20):
        got = field_io.read_geojson(spark, str(tmp_path), collection=True, split_bytes=split)
        assert sorted((int(r.properties["n"]), r.crop_type) for r in got.collect()) == [(f["properties"]["n"], f["properties"]["crop_type"]) for f in features]
    assert collections.read_features(spark, str(tmp_path), 64).select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("broken", ['{"type": "FeatureCollection"}', '{"features": [{"type": "Feature"}, 5 6]', '{"features": [{"type": "Feature"}, {"type": "Feature"'])
def test_broken_collections_fail(spark, tmp_path, broken):
    (tmp_path / "x.geojson").write_text(broken)
    if "5 6" in broken:  # what follows the list is not read
        assert collections.read_features(spark, str(tmp_path)).count() == 1
        return
    with pytest.raises(Exception, match="features|broken"):
        collections.read_features(spark, str(tmp_path)).collect()


def test_samples_take_one_exchange(spark, sf_dir):
    rows = fx.fields(spark, sf_dir).select("field_id", "crop_type")
    plan = regions.sample_per_class(rows, 50, 7)._jdf.queryExecution().executedPlan().toString()
    own = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(crop_type") == 1 and plan.count("Exchange hashpartitioning") - own.count("Exchange hashpartitioning") <= 1
    assert plan.count("WindowGroupLimit") == 2
    few, many = (regions.sample_per_class(rows, n, 7) for n in (20, 1500))
    per_class = {r.crop_type: r["count"] for r in rows.groupBy("crop_type").count().collect()}
    for n, sample in ((20, few), (1500, many)):
        assert {r.crop_type: r["count"] for r in sample.groupBy("crop_type").count().collect()} == {k: min(n, v) for k, v in per_class.items()}
    assert {r.field_id for r in few.collect()} <= {r.field_id for r in many.collect()}


def test_a_range_reads_little_past_its_end():
    """A small range of a large collection does not fetch a megabyte to finish one feature."""
    import io

    from furrow.sources import collections

    one = '{"type":"Feature","geometry":null,"properties":{"n":"é{\\"%06d"}}'
    data = ('{"type":"FeatureCollection","features":[' + ",\n".join(one % i for i in range(20_000)) + "]}").encode()

    class Handle(io.BytesIO):
        total = 0

        def read_at(self, n, at):
            self.total += n
            return data[at : at + n]

    for split in (1000, 65_536):
        handle = Handle()
        got = [f for at in range(0, len(data), split) for f in collections.features_in(handle, len(data), at, min(at + split, len(data)))]
        assert got == [one % i for i in range(20_000)]
        assert handle.total <= len(data) * (1 + 2 * collections.FIRST_AHEAD / split)
