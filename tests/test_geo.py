"""Geometry against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.functions import geo
from veilgrid.functions.geo import Grid
from veilgrid.operators import exposure, joins


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_area_and_haversine(spark):
    g = Grid(10.0, 50.0, 0.5, 0.25)
    r = one(spark, geo.cell_area_m2(g, F.lit(3)), geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)))
    north, south = math.radians(50 - 0.75), math.radians(50 - 1.0)
    assert r[0] == pytest.approx(6_371_000.0**2 * math.radians(0.5) * (math.sin(north) - math.sin(south)), rel=1e-12)
    assert r[1] == pytest.approx(math.pi * 6371)


def test_window_outside_is_null(spark):
    g = Grid(0.0, 10.0, 1.0, 1.0, 5, 5)
    r = one(spark, *geo.index_window(g, F.lit(20.0), F.lit(0.0), F.lit(21.0), F.lit(1.0)))
    assert list(r) == [None] * 4
    r = one(spark, *geo.index_window(g, F.lit(-3.0), F.lit(6.5), F.lit(2.2), F.lit(20.0)))
    assert list(r) == [0, 4, 0, 3]


def grid_frame(spark, rows, cols, values=None):
    rng = np.random.default_rng(1)
    data = [(r, c, float(rng.integers(1, 100)) if values is None else values) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(data, "src_row bigint, src_col bigint, v double")


def test_transfer_conserves_total(spark):
    """A source inside the target is split without loss, whatever the pixel sizes."""
    for px in (0.3, 0.7, 2.6):
        sgrid = Grid(1.05, 8.9, px, px, 3, 3)
        src = grid_frame(spark, 3, 3)
        tgrid = Grid(0.0, 10.0, 0.9, 1.1, 12, 9)
        t = spark.createDataFrame([(r, c) for r in range(9) for c in range(12)], "row bigint, col bigint")
        out = joins.overlap_transfer(t, tgrid, src, sgrid, "v", ("row", "col"))
        got = out.agg(F.sum("transferred")).first()[0]
        assert got == pytest.approx(src.agg(F.sum("v")).first()[0], rel=1e-9)
        assert out.filter("transferred is null and transferred_cover > 0").count() == 0
        assert out.agg(F.max("transferred_cover")).first()[0] <= 1 + 1e-9


def test_transfer_brute_force_with_invalid(spark):
    sgrid, tgrid = Grid(0.0, 4.0, 1.0, 1.0, 4, 4, nodata=-9999.0), Grid(0.5, 3.75, 1.5, 1.25, 2, 2)
    data = [(r, c, -9999.0 if (r, c) == (1, 1) else (-5.0 if (r, c) == (2, 2) else float(r * 4 + c))) for r in range(4) for c in range(4)]
    src = spark.createDataFrame(data, "src_row bigint, src_col bigint, v double")
    t = spark.createDataFrame([(r, c) for r in range(2) for c in range(2)] + [(0, 90)], "row bigint, col bigint")
    got = {(r.row, r.col): r for r in joins.overlap_transfer(t, tgrid, src, sgrid, "v", ("row", "col")).collect()}

    def band(w, a, b):
        return math.radians(w) * abs(math.sin(math.radians(a)) - math.sin(math.radians(b)))

    for tr in range(2):
        for tc in range(2):
            total = cov = 0.0
            for r, c, v in data:
                w, e = max(0.5 + tc * 1.5, c), min(0.5 + tc * 1.5 + 1.5, c + 1)
                n, s = min(3.75 - tr * 1.25, 4 - r), max(3.75 - tr * 1.25 - 1.25, 3 - r)
                if e > w and n > s:
                    a = band(e - w, n, s)
                    cov += a
                    if v != -9999.0 and v >= 0:
                        total += v * a / band(1, 4 - r, 3 - r)
            assert got[tr, tc].transferred == pytest.approx(total)
            assert got[tr, tc].transferred_cover == pytest.approx(cov / band(1.5, 3.75 - tr * 1.25, 3.75 - tr * 1.25 - 1.25))
    assert got[0, 90].transferred is None and got[0, 90].transferred_cover == 0


def test_sample_inside_from_extent(spark):
    g = Grid(0.0, 2.0, 1.0, 1.0, 2, 2, nodata=7.0)
    src = spark.createDataFrame([(0, 0, 5.0), (0, 1, 7.0)], "src_row bigint, src_col bigint, v double")
    p = spark.createDataFrame([(0.5, 1.5), (1.5, 1.5), (0.5, 0.5), (9.0, 1.5), (0.5, 5.0)], "lon double, lat double")
    got = {(r.lon, r.lat): (r.out, r.inside) for r in joins.sample_grid(p, "lon", "lat", src, g, {"v": "out"}).collect()}
    assert got == {(0.5, 1.5): (5.0, True), (1.5, 1.5): (None, True), (0.5, 0.5): (None, True), (9.0, 1.5): (None, False), (0.5, 5.0): (None, False)}


RINGS = "array<array<struct<x: double, y: double>>>"
STAR = [(0.1, 0.0), (3.0, 0.4), (1.7, 1.2), (2.9, 3.1), (1.2, 2.2), (-0.6, 2.8), (0.4, 1.1)]
HOLE = [(0.9, 0.8), (0.9, 1.5), (1.4, 1.5), (1.4, 0.8)]


def clip_area(ring, w, s, e, n):
    """Sutherland-Hodgman and shoelace, as an independent answer."""
    pts = ring
    for axis, limit, keep in ((0, w, 1), (0, e, -1), (1, s, 1), (1, n, -1)):
        out = []
        for a, b in zip(pts, pts[1:] + pts[:1]):
            ina, inb = keep * (a[axis] - limit) >= 0, keep * (b[axis] - limit) >= 0
            if ina != inb:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                cross = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
                out.append(cross)
            if inb:
                out.append(b)
        pts = out
        if not pts:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))) / 2


def test_polygon_box_area(spark):
    poly = spark.createDataFrame([([STAR, HOLE],)], f"rings {RINGS}")
    rng = np.random.default_rng(0)
    for _ in range(12):
        w, s = rng.uniform(-1, 2.5, 2)
        e, n = w + rng.uniform(0.1, 3), s + rng.uniform(0.1, 3)
        got = poly.select(geo.rings_area_in_box(F.col("rings"), F.lit(w), F.lit(s), F.lit(e), F.lit(n))).first()[0]
        assert got == pytest.approx(clip_area(STAR, w, s, e, n) - clip_area(HOLE, w, s, e, n), abs=1e-9)


def inside(x, y, rings):
    hit = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                hit = not hit
    return hit


def test_cells_in_polygon_with_hole(spark):
    grid = Grid(-1.0, 4.0, 0.1, 0.1, 45, 45)
    cells = spark.createDataFrame([(r, c) for r in range(45) for c in range(45)], "row bigint, col bigint")
    poly = spark.createDataFrame([(1, [STAR, HOLE]), (2, [[(50.0, 50.0), (51.0, 50.0), (51.0, 51.0)]])], f"id int, rings {RINGS}")
    got = {(r.row, r.col) for r in joins.cells_in_polygons(cells, "row", "col", grid, poly, tile=8).collect()}
    want = {(r, c) for r in range(45) for c in range(45) if inside(-1 + (c + 0.5) * 0.1, 4 - (r + 0.5) * 0.1, [STAR, HOLE])}
    assert got == want


def test_zonal_coverage(spark):
    grid = Grid(0.0, 4.0, 1.0, 1.0, 4, 4)
    cells = spark.createDataFrame([(r, c, None if (r, c) == (1, 1) else float(r + c - 2)) for r in range(4) for c in range(4)], "row bigint, col bigint, v double")
    poly = spark.createDataFrame([("z", [[(0.0, 1.0), (3.0, 1.0), (3.0, 4.0), (0.0, 4.0)]])], f"id string, rings {RINGS}")
    near = joins.cells_in_polygons(cells, "row", "col", grid, poly, mark="inside")
    r = exposure.zonal_stats(near, ["id"], "v", (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0")), "inside").first()
    assert (r.window_pixels, r.mask_pixels, r.finite_pixels) == (9, 9, 8)
    assert r.coverage_fraction == pytest.approx(8 / 9) and r.min_value == -2 and r.median_value == 0


def test_window_polygon_pairs_once(spark):
    grid = Grid(0.0, 100.0, 1.0, 1.0, 100, 100)
    w = spark.createDataFrame([("w", 0, 90, 0, 90)], "zone string, r0 bigint, r1 bigint, c0 bigint, c1 bigint")
    poly = spark.createDataFrame([("p", [[(5.0, 5.0), (80.0, 5.0), (80.0, 95.0), (5.0, 95.0)]])], f"id string, rings {RINGS}")
    assert joins.windows_meeting_polygons(w, poly, grid, tile=16).count() == 1


def test_segments_and_parts(spark):
    v = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 3, 0.0, 0.1), (1, 9, 0.1, 0.1), (2, 1, 5.0, 5.0)], "way long, seq int, lon double, lat double")
    seg = joins.segments(v, "way", "seq")
    assert sorted((r.way, r.seq) for r in seg.collect()) == [(1, 1), (1, 3)]
    parts = joins.segment_points(seg, 2000.0)
    total = seg.agg(F.sum("seg_km")).first()[0]
    assert parts.agg(F.sum("km")).first()[0] == pytest.approx(total)
    assert parts.agg(F.max("km")).first()[0] <= 2.0


def test_fallback_prefers_plain_name(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    look = spark.createDataFrame([("a", 1.0), ("p:a", 2.0), ("p:b", 3.0)], "name string, v double")
    got = {r.k: r.v for r in joins.fallback_lookup(df, look, "k", "name", "v", "p:", -1.0).collect()}
    assert got == {"a": 1.0, "b": 3.0, "c": -1.0}


def test_values_that_are_not_finite_are_missing(spark):
    from pyspark.sql import functions as F

    from veilgrid.functions import geo, labels, numeric

    grid = geo.Grid(tie_lon=100.0, tie_lat=15.0, px=0.01, py=0.01, width=10, height=10)
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 2.0), (14.995, float("nan"))], "x double, w double")
    rows = df.select(geo.row_index(grid, "x").alias("r"), labels.signal_class("x", "x", "x").alias("s")).collect()
    assert [r["r"] for r in rows] == [None, None, 0]
    assert [r["s"] for r in rows] == ["missing", "missing", "strong_positive"]
    assert df.select(numeric.wsum("w", F.lit(True)).alias("t")).first()["t"] == 3.0
