"""Joins between grids, points, lines, windows and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import Grid
from ..functions.labels import landcover_group
from ..operators import exposure, joins, observe
from . import views as V
from .aggregates import _WINDOWS, _ZONAL, _ZONAL_RND, way_segments, zone_windows
from .geometry import EDGE_AREA_SQL, POLYGON_SQL, polygons
from .registry import query

TALL = Grid(100.0, 15.0, 0.01, 0.01, width=128, height=1 << 20)


@query("join_nearest_grid", """with t as (select cell_id, cast(floor((15.005e0 - (15e0 - (cell_row + 0.5e0) * 0.01e0)) / 0.013e0) as bigint) as r,
         cast(floor((100e0 + (cell_col + 0.5e0) * 0.01e0 - 99.995e0) / 0.013e0) as bigint) as c from fx_grid),
       h as (select max(src_row) + 1 as h from fx_src)
       select cell_id, s.src_value as value, r between 0 and h - 1 and c between 0 and 49 as inside from t cross join h
       left join fx_src s on s.src_row = r and s.src_col = c""", "fx_grid fx_src", "value")
def join_nearest_grid(spark, d):
    """Source value at each target centre; ``inside`` comes from the extent of the source."""
    src = V.source_grid(spark, d)
    height = src.agg(F.max("src_row")).first()[0] + 1
    g = Grid(V.SOURCE.tie_lon, V.SOURCE.tie_lat, V.SOURCE.px, V.SOURCE.py, V.SOURCE.width, height)
    cells = V.grid(spark, d).select("cell_id", geo.center_lon(V.TARGET, "cell_col").alias("lon"), geo.center_lat(V.TARGET, "cell_row").alias("lat"))
    return joins.sample_grid(cells, "lon", "lat", src, g, {"src_value": "value"}).select("cell_id", "value", "inside")


@query("join_points_raster", """select point_id, case when s.src_value = 905e0 then null else s.src_value end as value from fx_points p left join fx_src s
       on s.src_row = floor((15.005e0 - p.lat) / 0.013e0) and s.src_col = floor((p.lon - 99.995e0) / 0.013e0)""", "fx_points fx_src", "value")
def join_points_raster(spark, d):
    """Raster values under points; 905 plays the nodata value."""
    g = Grid(V.SOURCE.tie_lon, V.SOURCE.tie_lat, V.SOURCE.px, V.SOURCE.py, V.SOURCE.width, nodata=905.0)
    return joins.sample_grid(V.points(spark, d), "lon", "lat", V.source_grid(spark, d), g, {"src_value": "value"}).select("point_id", "value")


_AREA = "6371000e0 * 6371000e0 * radians({w}) * abs(sin(radians({a})) - sin(radians({b})))"


@query("join_area_weighted", """with t as (select cell_id, cell_row, cell_col, 100e0 + cell_col * 0.01e0 as w, 100e0 + cell_col * 0.01e0 + 0.01e0 as e, 15e0 - cell_row * 0.01e0 - 0.01e0 as s,
         15e0 - cell_row * 0.01e0 as n from fx_grid),
       c as (select *, unnest(range(greatest(0, cast(floor((15.005e0 - n) / 0.013e0) as bigint) - 1), cast(ceil((15.005e0 - s) / 0.013e0) as bigint) + 2)) as sr from t),
       c2 as (select *, unnest(range(greatest(0, cast(floor((w - 99.995e0) / 0.013e0) as bigint) - 1), cast(ceil((e - 99.995e0) / 0.013e0) as bigint) + 2)) as sc from c),
       j as (select c2.*, src_value, least(e, 99.995e0 + sc * 0.013e0 + 0.013e0) - greatest(w, 99.995e0 + sc * 0.013e0) as dx,
         least(n, 15.005e0 - sr * 0.013e0) as hi, greatest(s, 15.005e0 - sr * 0.013e0 - 0.013e0) as lo from c2 join fx_src on src_row = sr and src_col = sc),
       o as (select cell_id, """ + _AREA.format(w="dx", a="hi", b="lo") + """ as a, src_value,
         """ + _AREA.format(w="0.013e0", a="15.005e0 - sr * 0.013e0", b="15.005e0 - (sr + 1) * 0.013e0") + """ as sa from j where dx > 0 and hi > lo),
       g as (select cell_id, sum(src_value * a / sa) as value, sum(a) as cov from o where a > 0 group by cell_id)
       select t.cell_id, value, coalesce(cov / (""" + _AREA.format(w="0.01e0", a="15e0 - cell_row * 0.01e0", b="15e0 - (cell_row + 1) * 0.01e0") + """), 0e0) as cover
       from t left join g on g.cell_id = t.cell_id""", "fx_grid fx_src", "value:4 cover")
def join_area_weighted(spark, d):
    """Source values split over target cells by shared area."""
    t = V.grid(spark, d).select("cell_id", "cell_row", "cell_col")
    out = joins.overlap_transfer(t, V.TARGET, V.source_grid(spark, d), V.SOURCE, "src_value", ("cell_row", "cell_col"), out="value")
    return out.select("cell_id", "value", F.col("value_cover").alias("cover"))


@query("join_native_pixel", """with s as (select src_value, cast(floor((15e0 - (15.005e0 - (src_row + 0.5e0) * 0.013e0)) / 0.01e0) as bigint) as r,
         cast(floor((99.995e0 + (src_col + 0.5e0) * 0.013e0 - 100e0) / 0.01e0) as bigint) as c from fx_src)
       select f.strong, f.majority, count(*) as source_cells, sum(src_value) as total from s join fx_flags f on f.cell_row = s.r and f.cell_col = s.c and s.c between 0 and 127
       where f.base group by f.strong, f.majority""", "fx_src fx_flags", "total:4")
def join_native_pixel(spark, d):
    cells = V.flags(spark, d, region=False).filter("base")
    return joins.native_pixel_totals(V.source_grid(spark, d), V.SOURCE, "src_value", cells, V.TARGET, ("cell_row", "cell_col"), ["strong", "majority"])


@query("join_observation_stack", """with s as (select g.cell_id, r.raster_id, r.nodata, r.value_scale, r.width, r.height, floor((r.tie_lat - (15e0 - (g.cell_row + 0.5e0) * 0.01e0)) / r.py) as y,
         floor(((100e0 + (g.cell_col + 0.5e0) * 0.01e0) - r.tie_lon) / r.px) as x from fx_grid g, fx_rasters r),
       v as (select cell_id, s.raster_id, case when nodata is null or p.value <> nodata then p.value * coalesce(value_scale, 1e0) end as v from s
         left join fx_pixels p on p.raster_id = s.raster_id and p.row = y and p.col = x where y >= 0 and y < height and x >= 0 and x < width),
       k as (select cell_id, count(*) as n_inside, count(*) filter (where v >= 0.3e0 - 1e-9) as n_obs from v group by 1),
       c as (select coalesce(n_obs, 0) as n_obs, coalesce(n_inside, 0) as n_inside from fx_grid left join k using (cell_id))
       select 'cells' as kind, n_obs as item, count(*) as n, count(*) filter (where n_inside > 0) as n2, sum(n_inside) as n3, 0 as n4 from c group by n_obs
       union all select 'pairs', r.raster_id, count(v.cell_id), count(v.v), count(*) filter (where v.v >= 0.3e0 - 1e-9), count(*) filter (where v.v < 0 or v.v > 1)
         from fx_rasters r left join v using (raster_id) group by r.raster_id""", "fx_grid fx_rasters fx_pixels", ints="item n3 n4")
def join_observation_stack(spark, d):
    """Cells by number of coherent rasters, with those inside any and the pairs inside; rasters by inside, valued, coherent and impossible cells."""
    cells = V.grid(spark, d).select("cell_id", geo.center_lon(V.TARGET, "cell_col").alias("lon"), geo.center_lat(V.TARGET, "cell_row").alias("lat"))
    by_cell, by_raster = observe.raster_stack(cells, "cell_id", "lon", "lat", V.raster_headers(spark, d), V.raster_pixels(spark, d), {"n_obs": V.THRESHOLD}, slack=V.SLACK)
    a = by_cell.groupBy(F.lit("cells").alias("kind"), F.col("n_obs").alias("item")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("inside_any").alias("n2"), F.sum("n_inside").alias("n3"), F.lit(0).alias("n4"))
    b = by_raster.select(F.lit("pairs").alias("kind"), F.col("raster_id").cast("bigint").alias("item"), F.col("inside_cells").alias("n"),
                         F.col("valued_cells").alias("n2"), F.col("n_obs").alias("n3"), F.col("outside_unit").alias("n4"))
    return a.unionByName(b)


@query("join_observation_counts", """with c as (select g.cell_id, coalesce(n_obs, 0) as n_obs, coalesce(n_seen, 0) as n_seen from fx_grid g left join fx_counts k on k.cell_id = g.cell_id)
       select 'cells' as kind, n_obs as item, count(*) as n, count(*) filter (where n_seen > 0) as n2 from c group by n_obs
       union all select 'pairs', pair_id, count(*), count(*) filter (where coherence >= 0.3e0 - 1e-9) from fx_obs group by pair_id""", "fx_grid fx_counts fx_obs", ints="item")
def join_observation_counts(spark, d):
    """The same counts from a table of one row a cell and pair: cells by number of coherent pairs, and pairs by number of cells."""
    o = V.obs(spark, d)
    cells = observe.attach_counts(V.grid(spark, d).select("cell_id"), o, "cell_id", {"n_obs": V.THRESHOLD}, slack=V.SLACK)
    a = cells.groupBy(F.lit("cells").alias("kind"), F.col("n_obs").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.count_if("inside_any").alias("n2"))
    b = observe.pair_totals(o, "pair_id", slack=V.SLACK).select(F.lit("pairs").alias("kind"), F.col("pair_id").cast("bigint").alias("item"), F.col("n_cells").alias("n"), F.col("n_coherent").alias("n2"))
    return a.unionByName(b)


@query("join_window_range", f"""with {_WINDOWS} select w.zone_id, count(*) as n, sum(vlm_mm_yr) as total from fx_grid c join w on c.cell_row >= r0 and c.cell_row < r1 and c.cell_col >= c0 and c.cell_col < c1
       group by w.zone_id""", "fx_grid", "total:4")
def join_window_range(spark, d):
    m = joins.cells_in_windows(V.grid(spark, d).select("cell_row", "cell_col", "vlm_mm_yr"), "cell_row", "cell_col", zone_windows(spark, d), tile=16)
    return m.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.sum("vlm_mm_yr").alias("total"))


_HITS = POLYGON_SQL + """, c as (select cell_id, cell_row, cell_col, 100e0 + (cell_col + 0.5e0) * 0.01e0 as lon, 15e0 - (cell_row + 0.5e0) * 0.01e0 as lat from fx_grid),
       m as (select c.cell_id, e.poly_id, sum(case when (y1 > lat) <> (y2 > lat) and lon < x1 + (x2 - x1) * (lat - y1) / (y2 - y1) then 1 else 0 end) % 2 = 1 as inside
         from c join box b on cell_row >= floor((15e0 - b.n) / 0.01e0) and cell_row < ceil((15e0 - b.s) / 0.01e0) and cell_col >= floor((b.w - 100e0) / 0.01e0) and cell_col < ceil((b.e - 100e0) / 0.01e0)
         join edge e on e.poly_id = b.poly_id group by c.cell_id, e.poly_id)"""


@query("join_polygon_cells", f"with {_HITS} select poly_id, cell_id from m where inside", "fx_grid")
def join_polygon_cells(spark, d):
    cells = V.grid(spark, d).select("cell_id", "cell_row", "cell_col")
    return joins.cells_in_polygons(cells, "cell_row", "cell_col", TALL, polygons(spark, d)).select("poly_id", "cell_id")


@query("zonal_polygon_stats", f"""with {_HITS}, x as (select m.poly_id, m.inside, case when inside then c.builtup_m2 end as x from m join fx_cells c on c.cell_id = m.cell_id),
       px as (select poly_id, (least(1048576, ceil((15e0 - s) / 0.01e0)) - greatest(0, floor((15e0 - n) / 0.01e0))) * (least(128, ceil((e - 100e0) / 0.01e0)) - greatest(0, floor((w - 100e0) / 0.01e0))) as px from box)
       select x.poly_id, max(px) as window_pixels, count(*) filter (where inside) as mask_pixels, {_ZONAL.format(n='max(px)')} from x join px on px.poly_id = x.poly_id group by x.poly_id""",
       "fx_grid fx_cells", _ZONAL_RND, "window_pixels")
def zonal_polygon_stats(spark, d):
    """Statistics of the cells inside each polygon, over the pixels of its bounding window."""
    cells = V.flags(spark, d, region=False).select("cell_row", "cell_col", "builtup_m2")
    near = joins.cells_in_polygons(cells, "cell_row", "cell_col", TALL, polygons(spark, d), mark="inside")
    return exposure.zonal_stats(near, ["poly_id"], "builtup_m2", (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0")), "inside")


@query("argmax_overlap", f"""with {_WINDOWS}, {POLYGON_SQL}, k as (select zone_id, poly_id, group_id, x1, y1, x2, y2, 100e0 + c0 * 0.01e0 as w, 100e0 + c1 * 0.01e0 as e, 15e0 - r1 * 0.01e0 as s, 15e0 - r0 * 0.01e0 as n
         from w cross join edge), {EDGE_AREA_SQL}, q as (select zone_id, group_id, poly_id, abs(sum(part)) as area from share group by all),
       g as (select zone_id, group_id, round(sum(area), 9) as area from q group by all)
       select zone_id, arg_max(group_id, (area, -group_id)) as group_id, max(area) as area from g where area > 1e-8 group by zone_id""", "fx_grid", "area:9")
def argmax_overlap(spark, d):
    """For each zone window the polygon group with the largest shared area (over 1e-8 square degrees); ties to the smallest group."""
    shared = joins.windows_on_polygons(zone_windows(spark, d), "zone_id", polygons(spark, d), ["poly_id", "group_id"], TALL)
    sums = shared.groupBy("zone_id", "group_id").agg(F.round(F.sum("area"), 9).alias("area")).filter("area > 1e-8")
    return exposure.argmax_by(sums, ["zone_id"], "group_id", "area", "group_id")


@query("join_segment_cells", """with seg as (select s.way_id, s.seq, s.seg_km, cast(floor((15e0 - (lat + lat2) / 2e0) / 0.01e0) as bigint) as r, cast(floor(((lon + lon2) / 2e0 - 100e0) / 0.01e0) as bigint) as c
         from fx_segments s join fx_category k on k.way_id = s.way_id where k.category is not null)
       select way_id, seq, f.cell_id, f.strong, f.n_obs, seg_km as km from seg join fx_flags f on f.cell_row = r and f.cell_col = c where c between 0 and 127 and f.base""",
       "fx_segments fx_category fx_flags", "km")
def join_segment_cells(spark, d):
    s = way_segments(spark, d).select("way_id", "seq", "km", geo.row_index(V.TARGET, "mid_lat").alias("cell_row"), geo.col_index(V.TARGET, "mid_lon").alias("cell_col"))
    cells = V.flags(spark, d, region=False).filter("base").select("cell_id", "cell_row", "cell_col", "strong", "n_obs")
    return s.join(cells, ["cell_row", "cell_col"]).drop("cell_row", "cell_col")


@query("join_landcover", """with t as (select point_id, floor((15e0 - lat) / 0.01e0) as r, floor((lon - 100e0) / 0.01e0) as c from fx_points)
       select point_id, coalesce(l.landcover_group, 'other') as landcover_group from t left join fx_grid g on g.cell_row = r and g.cell_col = c and c between 0 and 127
       left join fx_land l on l.landcover_code = g.landcover_code""", "fx_points fx_grid fx_land")
def join_landcover(spark, d):
    p = joins.sample_grid(V.points(spark, d), "lon", "lat", V.grid(spark, d), V.TARGET, {"landcover_code": "code"}, "cell_row", "cell_col")
    return p.select("point_id", landcover_group("code").alias("landcover_group"))
