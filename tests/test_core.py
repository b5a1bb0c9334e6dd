"""Lineage cuts, components, geometry kernels, files, and that the engine does without its optional subpackage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from odweave.operators import calibrate, iterate, raster, spatial, windows
from odweave.plans import registry
from odweave.sources import tables
from tests.oracle import compare, connect


@pytest.mark.parametrize("few", [iterate.BROADCAST_ROWS, 0])
def test_components_equal_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(iterate, "BROADCAST_ROWS", few)
    rng = random.Random(4)
    for n, m in ((50, 30), (200, 150), (300, 600)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 70)]
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
        got = {r.node: r.component for r in iterate.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in parent}


def test_components_edge_cases(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 4), (3, 4), (4, 3)], "a long, b long")
    assert sorted((r.node, r.component) for r in iterate.connected_components(df).collect()) == [(1, 1), (3, 3), (4, 3)]
    assert iterate.connected_components(df.limit(0)).count() == 0


def test_fitted_margins(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(1, 9, (6, 6))
    rows, cols = rng.integers(10, 20, 6).astype(float), None
    cols = rows[::-1].copy()
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(6) for j in range(6)], "from_id int, to_id int, value double")
    r = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rows)], "from_id int, total double")
    c = spark.createDataFrame([(i, float(v)) for i, v in enumerate(cols)], "to_id int, total double")
    out = calibrate.fit_margins(cells, r, c)
    got = np.zeros((6, 6))
    for x in out.collect():
        got[x.from_id, x.to_id] = x.value
    assert got.sum(1) == pytest.approx(rows) and got.sum(0) == pytest.approx(cols)


def test_voronoi_tiles_equal_one_task(spark):
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((120, 2)) * 10)], "id int, x double, y double")
    area = lambda per: {r.id: r.a for r in spatial.voronoi(pts, per_tile=per).select("id", spatial.area("ring").alias("a")).collect()}
    one, many = area(10_000), area(8)
    assert set(one) == set(many) == set(range(120))
    assert [many[i] for i in range(120)] == pytest.approx([one[i] for i in range(120)])


def test_convex_clipping():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert spatial.ring_area(spatial.clip_convex(square, square + 1)) == pytest.approx(1)
    assert spatial.ring_area(spatial.clip_convex(square, square + 5)) == 0


def test_dissolve_keeps_large_holes(spark):
    cells = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rows = [(1, [(float(x), float(y)), (x + 1.0, float(y)), (x + 1.0, y + 1.0), (float(x), y + 1.0)]) for x, y in cells]
    df = spark.createDataFrame(rows, "k int, ring array<struct<x double, y double>>")
    got = sorted((r.is_hole, r.a) for r in spatial.dissolve(df, "k").select("is_hole", spatial.area("ring").alias("a")).collect())
    assert got == [(False, 9.0), (True, 1.0)]
    assert spatial.dissolve(df, "k", least_hole=2.0).count() == 1


def test_geohash_of_a_known_place(spark):
    row = spark.range(1).select(spatial.geohash(F.lit(-5.6), F.lit(42.6), 5).alias("g")).first()
    assert row["g"] == "ezs42"


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 14.5, 50.1), (2, None, 49.0)], "id int, X double, Y double")
    tables.write_csv(df, str(tmp_path / "a"))
    back = tables.read_geo(spark, str(tmp_path / "a"))
    got = {r.id: r.geometry for r in back.collect()}
    assert (got[1].x, got[1].y) == (14.5, 50.1) and got[2] is None
    wkt = tables.point_wkt(back)
    tables.write_csv(wkt.select("id", "wkt"), str(tmp_path / "b"))
    assert tables.read_geo(spark, str(tmp_path / "b")).where("id = 1").first().geometry.x == 14.5
    assert "wkt" not in tables.read_nonspatial(spark, str(tmp_path / "b")).columns
    assert tables.read_csv_folder(spark, str(tmp_path / "b")).select("table_name").distinct().count() >= 1


def test_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 14.5, 50.1), (2, None, None, 49.0)], "id int, name string, X double, Y double")
    tables.write_geojson(tables.points(df, drop=True), str(tmp_path / "p.geojson"))
    got = {r.id: (r.name, r.geometry) for r in tables.read_geo(spark, str(tmp_path / "p.geojson"), "id int, name string").collect()}
    assert got[1][0] == "a" and (got[1][1].x, got[1][1].y) == (14.5, 50.1) and got[2] == (None, None)
    rings = spark.createDataFrame([(7, [(0.0, 0.0), (1.0, 0.0), (0.0, 2.5), (0.0, 0.0)])], "id int, ring array<struct<x:double,y:double>>")
    for kind in ("Polygon", "LineString"):
        tables.write_geojson(rings, str(tmp_path / "r.geojson"), "ring", kind)
        row = tables.read_geojson(spark, str(tmp_path / "r.geojson")).first()
        assert row.id == "7" and row.geometry is None and [tuple(p) for p in row.ring] == [(0.0, 0.0), (1.0, 0.0), (0.0, 2.5), (0.0, 0.0)]
    file = tmp_path / "c.geojson"
    file.write_text('{"type": "FeatureCollection",\n "features": [{"type": "Feature", "properties": {"id": 3},\n "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}}]}')
    row = tables.read_geo(spark, str(file), "id int").first()
    assert row.id == 3 and [tuple(p) for p in row.ring] == [(0, 0), (1, 0), (1, 1), (0, 0)]


def test_raster_files(spark, tmp_path):
    np.save(tmp_path / "r.npy", np.arange(6).reshape(2, 3))
    got = sorted((r.row, r.col, r.value) for r in raster.read_raster(spark, str(tmp_path / "r.npy")).collect())
    assert got == [(i, j, float(3 * i + j)) for i in range(2) for j in range(3)]
    world = raster.World.read("2\n0\n0\n-2\n11\n19")
    assert world.geotransform() == (10, 2, 0, 20, 0, -2)


def test_ranks_over_partitions(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(500)]
    got = {r.v: r["rank"] for r in windows.global_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v", parts=7).collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(values, reverse=True))}


def test_mean_times_on_rounding_limits(spark, tmp_path):
    """Single times and pairs whose mean has exactly half a millisecond round as in the SQL; user 420 of sf0.1 has one."""
    times, second = [], 1_000_000
    for i in range(6_000):
        at = i * 14 * second + (2 * (i % 8) + 1) * 62_500  # odd sixteenths of a second
        far = (1 + i * 7 % 14_000) * second
        times += [(i, 0, at), (i, 1, at - min(far, at)), (i, 1, at + min(far, at))]
    rows = [(k, us, user, f'{{"k": {site}}}') for k, (user, site, us) in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, us long, user_id long, props string")
    path = tmp_path / "events.parquet"
    df.select("event_id", F.timestamp_micros(F.col("us") + 19_700 * 86_400 * second).cast("timestamp_ntz").alias("ts"), "user_id", "props").write.parquet(str(path))
    compare(registry.queries()["detect_anchors"](spark, str(tmp_path)), connect(tmp_path), registry.oracle_sql()["detect_anchors"])
