"""Missing data of every kind in the two-stage sums, index ranges and transfers."""

import math

import pytest
from pyspark.sql import functions as F

from veilgrid.functions import geo
from veilgrid.functions.geo import Grid
from veilgrid.operators import exposure, joins, observe, resample

NAN, INF = float("nan"), float("inf")
BAD = [NAN, None, INF, -INF, -9999.0, -1.0]


def cells(spark, values):
    rows = [(i, "r", 0, i, -7.0, 5, True, v, v, 1.0 if v == v else NAN) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "cell_id long, region string, row long, col long, vlm_mm_yr double, n_obs int, inside_any boolean, population double, builtup_m2 double, cover_fraction double")
    return observe.screen(observe.observability_flags(df, 7), "vlm_mm_yr", 5.0)


def test_region_account_keeps_what_is_valid(spark):
    out = exposure.region_summary(cells(spark, [100.0, 200.0, *BAD]), ["region"], 7, 0.3).first()
    assert out["strong_sub_5mm_population"] == 300.0 and out["total_population_vlm_grid"] == 300.0 and out["covered_vlm_cells"] == 8
    assert out["strong_sub_5mm_builtup_km2"] == pytest.approx(300.0 / 1e6)


def test_block_and_cube_sums_keep_what_is_valid(spark):
    df = cells(spark, [100.0, 200.0, *BAD])
    cube = resample.threshold_surface(df, [5.0], [0.5], [7], 7).first()
    assert cube["strong_population"] == 300.0 and cube["hidden_population"] == 300.0 and cube["strong_cells"] == 8
    block = resample.block_stats(df, "row", "col", 100).first()
    assert block["strong_pop"] == 300.0 and block["strong_cells"] == 8
    shifted = resample.shifted_blocks(df, "row", "col", [4]).filter("origin_shift = 0").first()
    assert shifted["strong_cells"] == 8 and shifted["strong_hidden_population_fraction"] == 0.0


def test_threshold_closure_totals_survive_nan(spark):
    rows = [(-8.0, 10.0, 1.0), (-1.0, 30.0, 1.0), (-9.0, NAN, 1.0), (0.1, None, 1.0), (0.2, -9999.0, 1.0)]
    points = spark.createDataFrame(rows, "velocity_mm_yr double, population double, builtup double")
    out = exposure.threshold_closure(points, [5.0]).first()
    assert out["strong_population"] == 10.0 and out["strong_population_share"] == 0.25 and out["n_strong_points"] == 2


def test_index_ranges_of_missing_sides_are_null(spark):
    g = Grid(10.0, 5.0, 0.5, 0.5, 8, 8)
    for bad in (NAN, INF, None):
        lo = F.lit(bad).cast("double")
        row = spark.range(1).select(*geo.candidate_rows(g, lo, F.lit(4.0)), *geo.candidate_cols(g, F.lit(10.0), lo)).first()
        assert list(row) == [None] * 4
    assert list(spark.range(1).select(*geo.candidate_rows(g, F.lit(3.0), F.lit(4.0))).first()) == [1, 5]


def test_transfer_by_extent_and_mask(spark):
    source, target = Grid(0.0, 2.0, 1.0, 1.0, 2, 2, -9999.0), Grid(0.0, 2.0, 1.0, 1.0, 3, 2)
    # one source cell is nodata, one is left out, one is not finite
    src = spark.createDataFrame([(0, 0, 8.0), (0, 1, -9999.0), (1, 0, NAN)], "src_row long, src_col long, v double")
    targets = spark.createDataFrame([(r, c, (r, c) != (1, 1)) for r in range(2) for c in range(3)], "row long, col long, wanted boolean")
    got = {(r["row"], r["col"]): (r["x"], r["x_cover"], r["x_valid_cover"]) for r in
           joins.overlap_transfer(targets, target, src, source, "v", ("row", "col"), out="x").collect()}
    assert got[0, 0] == pytest.approx((8.0, 1.0, 1.0)) and got[0, 2] == (None, 0.0, 0.0)
    for key in ((0, 1), (1, 0), (1, 1)):
        assert got[key] == pytest.approx((0.0, 1.0, 0.0))
    masked = {(r["row"], r["col"]): (r["x"], r["x_cover"]) for r in
              joins.overlap_transfer(targets, target, src, source, "v", ("row", "col"), out="x", mask=F.col("wanted")).collect()}
    assert masked[1, 1] == (None, 0.0) and masked[1, 0] == pytest.approx((0.0, 1.0))
    assert math.isclose(masked[0, 0][0], 8.0)
