"""Raster stacks of many headers against a loop over rasters and cells."""

import math
import random

from veilgrid.operators import observe


def brute(cells, rasters, pixels, threshold):
    held = {(r, y, x): v for r, y, x, v in pixels}
    by_cell, by_raster = {}, {}
    for name, lon0, lat0, px, py, w, h, nodata, scale in rasters:
        inside = valued = good = odd = 0
        for key, lon, lat in cells:
            if lon is None or lat is None or not math.isfinite(lon) or not math.isfinite(lat) or None in (lon0, lat0, px, py, w, h) or px <= 0 or py <= 0:
                continue
            y, x = math.floor((lat0 - lat) / py), math.floor((lon - lon0) / px)
            if not (0 <= y < h and 0 <= x < w):
                continue
            inside += 1
            v = held.get((name, y, x))
            v = None if v is None or not math.isfinite(v) or v == nodata else v * (1.0 if scale is None else scale)
            valued += v is not None
            ok = v is not None and v >= threshold
            good += ok
            odd += v is not None and not 0 <= v <= 1
            n, m = by_cell.get(key, (0, 0))
            by_cell[key] = (n + ok, m + 1)
        by_raster[name] = (good, inside, valued, odd)
    return by_cell, by_raster


def test_stack_of_headers_equals_loop(spark):
    rng = random.Random(3)
    cells = [(i, rng.uniform(9.5, 13.0), rng.uniform(-1.2, 2.5)) for i in range(400)]
    cells += [(900, None, 0.0), (901, float("nan"), 0.0), (902, 10.0, 2.0), (903, 12.0, 1.0), (904, float("inf"), 1.0)]
    rasters = [
        ("a", 10.0, 2.0, 0.1, 0.1, 20, 10, -1.0, None), ("b", 9.7, 2.4, 0.07, 0.13, 30, 25, None, 0.01), ("c", 100.0, 2.0, 0.1, 0.1, 9, 9, 0.0, None),
        ("d", 10.0, 2.0, 0.0, 0.1, 20, 10, None, None), ("e", 10.0, 2.0, None, 0.1, 20, 10, None, None), ("f", 9.0, 3.0, 0.5, 0.5, 9, 9, float("nan"), None),
    ]
    pixels = []
    for name, *_, w, h, nodata, _scale in rasters:
        for y in range(h):
            for x in range(w):
                if rng.random() < 0.7:
                    pixels.append((name, y, x, rng.choice([rng.random(), rng.random(), -1.0, 0.0, 0.3, 1.5, float("nan"), None, 60.0])))
    head = "raster_id string, tie_lon double, tie_lat double, px double, py double, width long, height long, nodata double, value_scale double"
    by_cell, by_raster = observe.raster_stack(
        spark.createDataFrame(cells, "key long, lon double, lat double"), "key", "lon", "lat", spark.createDataFrame(rasters, head),
        spark.createDataFrame(pixels, "raster_id string, row int, col int, value double"), {"n": 0.3}, tile=0.5)
    want_cells, want_rasters = brute(cells, rasters, pixels, 0.3)
    got = {r["key"]: r for r in by_cell.collect()}
    assert len(got) == len(cells)
    for key, *_ in cells:
        n, m = want_cells.get(key, (0, 0))
        assert (got[key]["n"], got[key]["n_inside"], got[key]["inside_any"]) == (n, m, m > 0)
    assert {r["raster_id"]: (r["n"], r["inside_cells"], r["valued_cells"], r["outside_unit"]) for r in by_raster.collect()} == want_rasters
    assert want_rasters["c"] == (0, 0, 0, 0) and any(m > v for _, m, v, _ in want_rasters.values())


def test_edges_of_an_extent_are_half_open(spark):
    cells = [(1, 0.0, 1.0), (2, 1.0, 0.5), (3, 0.5, 0.0), (4, 0.999, 0.001)]
    rasters = spark.createDataFrame([("r", 0.0, 1.0, 0.5, 0.5, 2, 2, None, None)],
                                    "raster_id string, tie_lon double, tie_lat double, px double, py double, width int, height int, nodata double, value_scale double")
    none = spark.createDataFrame([], "raster_id string, row long, col long, value double")
    by_cell, by_raster = observe.raster_stack(spark.createDataFrame(cells, "key long, lon double, lat double"), "key", "lon", "lat", rasters, none, {"n": 0.1})
    assert sorted(r["key"] for r in by_cell.filter("inside_any").collect()) == [1, 4]
    assert by_raster.first()["inside_cells"] == 2
