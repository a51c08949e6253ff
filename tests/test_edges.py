"""Polygon areas as sums over edge rows, against clipping by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from veilgrid.functions.geo import Grid
from veilgrid.operators import joins


def clipped(ring, w, s, e, n):
    """Area of a ring inside a box by clipping at its four sides (convex box, any ring), with sign."""
    for axis, limit, keep in ((0, w, 1), (0, e, -1), (1, s, 1), (1, n, -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ina, inb = (a[axis] - limit) * keep >= 0, (b[axis] - limit) * keep >= 0
            if ina:
                out.append(a)
            if ina != inb:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
        if not ring:
            return 0.0
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def test_area_over_edge_rows_equals_clipping(spark):
    rng = random.Random(4)
    shapes = []
    for i in range(40):
        cx, cy, r = rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0.2, 2)
        outer = [(cx - r, cy - r), (cx + r, cy - 0.8 * r), (cx + 0.9 * r, cy + r), (cx - 0.7 * r, cy + 1.1 * r)]
        hole = [(cx - 0.2 * r, cy - 0.2 * r), (cx - 0.2 * r, cy + 0.3 * r), (cx + 0.3 * r, cy + 0.3 * r), (cx + 0.3 * r, cy - 0.2 * r)]
        shapes.append((i, i % 3, [[{"x": x, "y": y} for x, y in ring] for ring in (outer, hole)]))
    df = spark.createDataFrame(shapes, "poly_id long, group_id long, rings array<array<struct<x:double,y:double>>>")
    want = {i: abs(sum(clipped([(p["x"], p["y"]) for p in ring], 1.0, 1.0, 3.0, 2.5) for ring in rings)) for i, _, rings in shapes}
    got = joins.area_in_boxes(joins.edge_rows(df), ["poly_id"], tuple(F.lit(v) for v in (1.0, 1.0, 3.0, 2.5))).collect()
    assert {r["poly_id"]: r["area"] for r in got} == pytest.approx(want, abs=1e-9)

    grid = Grid(0.0, 5.0, 0.1, 0.1, 50, 50)
    windows = spark.createDataFrame([(1, 10, 30, 5, 25), (2, 0, 50, 0, 50), (3, 40, 41, 40, 41)], "zone long, r0 long, r1 long, c0 long, c1 long")
    found = {(r["zone"], r["poly_id"]): r["area"] for r in joins.windows_on_polygons(windows, "zone", df, ["poly_id", "group_id"], grid, tile=8).collect()}
    assert len(found) == joins.windows_on_polygons(windows, "zone", df, ["poly_id", "group_id"], grid, tile=64).count()
    for zone, r0, r1, c0, c1 in [(1, 10, 30, 5, 25), (2, 0, 50, 0, 50), (3, 40, 41, 40, 41)]:
        for i, _, rings in shapes:
            area = abs(sum(clipped([(p["x"], p["y"]) for p in ring], c0 * 0.1, 5 - r1 * 0.1, c1 * 0.1, 5 - r0 * 0.1) for ring in rings))
            assert found.get((zone, i), 0.0) == pytest.approx(area, abs=1e-9)
