import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterloom.functions import geo
from rasterloom.operators import places


@pytest.fixture(scope="module")
def gazetteer(spark):
    return places.built_in_locations(spark), places.built_in_aliases(spark)


def names_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name STRING")


@pytest.mark.parametrize("broadcast_bytes", [None, 0])
def test_resolve(spark, gazetteer, broadcast_bytes):
    asked = [" f-8 ", "Centaurus", "NUST H-12", "\tg10\n", "Atlantis", "", None] + ["Blue Area"] * 30
    found = places.resolve(names_of(spark, *asked), *gazetteer, broadcast_bytes=broadcast_bytes).collect()
    codes = {r.name: r.code for r in found}
    assert codes == {
        " f-8 ": "F-8", "Centaurus": "F-8", "NUST H-12": "H-12", "\tg10\n": "G-10",
        "Atlantis": None, "": None, None: None, "Blue Area": "F-6",
    }
    assert len(found) == len(asked) and all(r.resolved == (r.code is not None) for r in found)


def test_codes_come_before_aliases(spark):
    locations = spark.createDataFrame([("A", 1.0, 2.0), ("B", 3.0, 4.0)], "code STRING, lat DOUBLE, lon DOUBLE")
    aliases = spark.createDataFrame([("a", "B"), ("b2", "B"), ("gone", "Z")], "alias STRING, code STRING")
    found = places.resolve(names_of(spark, "a", "B2", "gone"), locations, aliases).collect()
    assert {r.name: r.code for r in found} == {"a": "A", "B2": "B", "gone": None}


def test_strict(spark, gazetteer):
    with pytest.raises(PySparkException, match="Unknown location: Atlantis"):
        places.resolve(names_of(spark, "F-8", "Atlantis"), *gazetteer, strict=True).collect()
    assert places.resolve(names_of(spark, "F-8"), *gazetteer, strict=True).count() == 1


def test_box_and_size(spark, gazetteer):
    boxed = places.with_box(places.resolve(names_of(spark, "centaurus"), *gazetteer))
    row = boxed.select("box.*", geo.native_size(F.col("box")).alias("size")).first()
    expected = (73.02615279500874, 33.70012518384507, 73.05423042539827, 33.723481274394835)
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(row[:4], expected))
    assert tuple(row.size) == (260, 260)
    campus = F.struct(*[F.lit(v).alias(n) for n, v in zip(("west", "south", "east", "north"), (72.977942, 33.633664, 73.005167, 33.662233))])
    assert tuple(spark.range(1).select(geo.native_size(campus)).first()[0]) == (252, 318)


def test_manifest(spark, gazetteer):
    manifest = places.scene_manifest(places.resolve(names_of(spark, "blue area", "Atlantis"), *gazetteer))
    row = manifest.first()
    payload = json.loads(row.payload)
    assert manifest.count() == 1 and row.cache_key == "BLUE_AREA.png"
    assert payload["output"]["width"] == 260 and payload["output"]["responses"][0]["format"]["type"] == "image/png"
    source = payload["input"]["data"][0]
    assert source["type"] == "sentinel-2-l2a" and source["dataFilter"]["mosaickingOrder"] == "leastCC"
    assert source["dataFilter"]["timeRange"] == {"from": "2026-05-01T00:00:00Z", "to": "2026-07-01T00:00:00Z"}
    assert payload["input"]["bounds"]["bbox"] == [row.box.west, row.box.south, row.box.east, row.box.north]
    assert "sample.B04 * 2.5, sample.B03 * 2.5, sample.B02 * 2.5" in payload["evalscript"]
    fixed = places.scene_manifest(places.resolve(names_of(spark, "F-8"), *gazetteer), size=(10, 20)).first()
    assert json.loads(fixed.payload)["output"]["height"] == 20


def test_cache_keys_differ_by_rule(spark):
    keys = spark.range(1).select(*[geo.cache_key(F.lit(" f-8/a b "), rule).alias(rule) for rule in ("slash", "dash")]).first()
    assert (keys.slash, keys.dash) == ("F-8_A_B.png", "F_8/A_B.png")


def test_cache(spark):
    asked = spark.createDataFrame([("a",)] * 5 + [("b",)], "cache_key STRING")
    cache = spark.createDataFrame([("b",), ("b",), ("c",)], "cache_key STRING")
    assert [tuple(r) for r in places.uncached(asked, cache).collect()] == [("a", 5)]
    assert [tuple(r) for r in places.cached(asked, cache).collect()] == [("b", 1)]


@pytest.mark.parametrize("broadcast_bytes", [None, 0])
def test_points_in_boxes(spark, broadcast_bytes):
    points = [(i, 10 + (i * 37 % 100) / 200, 20 + (i * 53 % 100) / 200) for i in range(300)]
    boxes = [("p", 20.1, 10.1, 20.3, 10.2), ("q", 20.25, 10.0, 20.5, 10.5), ("r", -1.0, -1.0, -0.5, -0.5)]
    frame = spark.createDataFrame(points, "id INT, lat DOUBLE, lon DOUBLE")
    table = spark.createDataFrame(
        [(c, (w, s, e, n)) for c, w, s, e, n in boxes],
        "code STRING, box STRUCT<west: DOUBLE, south: DOUBLE, east: DOUBLE, north: DOUBLE>",
    )
    got = {(r.id, r.code) for r in places.points_in_boxes(frame, table, broadcast_bytes=broadcast_bytes).collect()}
    assert got == {(i, c) for i, lat, lon in points for c, w, s, e, n in boxes if w <= lon <= e and s <= lat <= n}


def test_large_boxes_are_listed_under_few_cells(spark):
    boxes = [("world", -180.0, -90.0, 180.0, 90.0), ("point", 1.0, 1.0, 1.0, 1.0), ("wide", -60.0, 0.99, 60.0, 1.01), ("none", 3.0, 3.0, 2.0, 2.0)]
    table = spark.createDataFrame(
        [(c, (w, s, e, n)) for c, w, s, e, n in boxes],
        "code STRING, box STRUCT<west: DOUBLE, south: DOUBLE, east: DOUBLE, north: DOUBLE>",
    )
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 61.0), (2, -90.0, 180.0)], "id INT, lat DOUBLE, lon DOUBLE")
    got = {(r.id, r.code) for r in places.points_in_boxes(points, table).collect()}
    assert got == {(0, "world"), (0, "point"), (0, "wide"), (1, "world"), (2, "world")}
    assert places.points_in_boxes(points, table.limit(0)).count() == 0


def test_literal_tables_are_not_computed_first(spark, gazetteer):
    context = spark.sparkContext
    context.setJobGroup("literal", "literal")
    try:
        found = places.resolve(names_of(spark, "nust"), *gazetteer, literal=True)
        assert not context.statusTracker().getJobIdsForGroup("literal")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert found.first().code == "H-12"


def test_least_cloudy_breaks_ties(spark):
    rows = [(1, "t", "2026-01-01", 5), (2, "t", "2026-02-01", 5), (3, "t", "2026-02-01", 5), (4, "u", "2026-01-01", 90)]
    scenes = spark.createDataFrame(rows, "scene_id BIGINT, tile STRING, day STRING, cloud_pct INT").withColumn(
        "ts", F.to_timestamp("day")
    )
    assert {r.tile: r.scene_id for r in places.least_cloudy(scenes).collect()} == {"t": 2, "u": 4}


def test_scene_filter(spark):
    box = "STRUCT<west: DOUBLE, south: DOUBLE, east: DOUBLE, north: DOUBLE>"
    rows = [
        (1, "2026-05-01", "c", (0.0, 0.0, 1.0, 1.0)),
        (2, "2026-07-01", "c", (0.0, 0.0, 1.0, 1.0)),
        (3, "2026-05-02", "d", (0.0, 0.0, 1.0, 1.0)),
        (4, "2026-05-02", "c", (5.0, 5.0, 6.0, 6.0)),
    ]
    scenes = spark.createDataFrame(rows, f"id INT, day STRING, collection STRING, box {box}").withColumn("ts", F.to_timestamp("day"))
    area = F.struct(*[F.lit(v).alias(n) for n, v in zip(("west", "south", "east", "north"), (0.5, 0.5, 2.0, 2.0))])
    kept = places.scene_filter(scenes, "2026-05-01", "2026-07-01", area, "c")
    assert [r.id for r in kept.collect()] == [1]
