"""Grid and geometry arithmetic over cells, points, ways and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import Grid
from ..operators import joins
from . import views as V
from .registry import query

FULL = Grid(100.0, 15.0, 0.01, 0.01, width=128, height=64)


@query("grid_centers", "select cell_id, 100e0 + (cell_col + 0.5e0) * 0.01e0 as lon, 15e0 - (cell_row + 0.5e0) * 0.01e0 as lat from fx_grid", "fx_grid", "lon lat")
def grid_centers(spark, d):
    return V.grid(spark, d).select("cell_id", geo.center_lon(V.TARGET, "cell_col").alias("lon"), geo.center_lat(V.TARGET, "cell_row").alias("lat"))


@query("cell_bounds", """select src_id, 99.995e0 + src_col * 0.013e0 as west, 99.995e0 + (src_col + 1) * 0.013e0 as east, 15.005e0 - (src_row + 1) * 0.013e0 as south,
       15.005e0 - src_row * 0.013e0 as north from fx_src""", "fx_src", "west east south north")
def cell_bounds(spark, d):
    g = V.SOURCE
    return V.source_grid(spark, d).select(
        "src_id", geo.west(g, "src_col").alias("west"), geo.east(g, "src_col").alias("east"), geo.south(g, "src_row").alias("south"), geo.north(g, "src_row").alias("north"))


_AREA = "6371000e0 * 6371000e0 * radians({w}) * abs(sin(radians({a})) - sin(radians({b})))"


@query("cell_area_m2", "select cell_id, " + _AREA.format(w="0.01e0", a="15e0 - cell_row * 0.01e0", b="15e0 - (cell_row + 1) * 0.01e0") + " as area from fx_grid", "fx_grid", "area:2")
def cell_area_m2(spark, d):
    return V.grid(spark, d).select("cell_id", geo.cell_area_m2(V.TARGET, "cell_row").alias("area"))


@query("overlap_area_m2", """with p as (select src_id, cast(floor(src_id / 40e0) as bigint) as t_row, src_id % 60 as t_col, src_row, src_col from fx_src),
       b as (select src_id, greatest(100e0 + t_col * 0.01e0, 99.995e0 + src_col * 0.013e0) as w, least(100e0 + t_col * 0.01e0 + 0.01e0, 99.995e0 + src_col * 0.013e0 + 0.013e0) as e,
         greatest(15e0 - t_row * 0.01e0 - 0.01e0, 15.005e0 - src_row * 0.013e0 - 0.013e0) as s, least(15e0 - t_row * 0.01e0, 15.005e0 - src_row * 0.013e0) as n from p)
       select src_id, case when e > w and n > s then """ + _AREA.format(w="e - w", a="n", b="s") + " else 0e0 end as area from b", "fx_src", "area:2")
def overlap_area_m2(spark, d):
    s = V.source_grid(spark, d).withColumn("t_row", F.floor(F.col("src_id") / 40.0)).withColumn("t_col", F.col("src_id") % 60)
    return s.select("src_id", geo.overlap_area_m2(V.TARGET, "t_row", "t_col", V.SOURCE, "src_row", "src_col").alias("area"))


@query("cell_index", """with i as (select point_id, cast(floor((15e0 - lat) / 0.01e0) as bigint) as r, cast(floor((lon - 100e0) / 0.01e0) as bigint) as c from fx_points)
       select point_id, case when r between 0 and 63 then r end as cell_row, case when c between 0 and 127 then c end as cell_col from i""", "fx_points")
def cell_index(spark, d):
    return V.points(spark, d).select("point_id", geo.row_index(FULL, "lat").alias("cell_row"), geo.col_index(FULL, "lon").alias("cell_col"))


_BOX = "p as (select point_id, lon - 0.05e0 as w, lat - weight / 100e0 as s, lon + weight / 50e0 as e, lat + 0.03e0 as n from fx_points)"
_WIN = """i as (select point_id, greatest(0, least(64, cast(floor((15e0 - n) / 0.01e0) as bigint))) as r0, greatest(0, least(64, cast(ceil((15e0 - s) / 0.01e0) as bigint))) as r1,
       greatest(0, least(128, cast(floor((w - 100e0) / 0.01e0) as bigint))) as c0, greatest(0, least(128, cast(ceil((e - 100e0) / 0.01e0) as bigint))) as c1 from p),
       x as (select point_id, case when r1 > r0 and c1 > c0 then r0 end as r0, case when r1 > r0 and c1 > c0 then r1 end as r1,
         case when r1 > r0 and c1 > c0 then c0 end as c0, case when r1 > r0 and c1 > c0 then c1 end as c1 from i)"""


def _boxes(spark, d):
    w = F.col("weight")
    return V.points(spark, d).select("point_id", (F.col("lon") - 0.05).alias("w"), (F.col("lat") - w / 100.0).alias("s"),
                                     (F.col("lon") + w / 50.0).alias("e"), (F.col("lat") + 0.03).alias("n"))


def _window_frame(spark, d):
    bounds = geo.index_window(FULL, "w", "s", "e", "n")
    return _boxes(spark, d).select("point_id", *[b.alias(n) for b, n in zip(bounds, ("r0", "r1", "c0", "c1"))])


@query("bbox_window", f"with {_BOX}, {_WIN} select * from x", "fx_points")
def bbox_window(spark, d):
    return _window_frame(spark, d)


@query("window_regeo", f"""with {_BOX}, {_WIN} select point_id, c1 - c0 as width, r1 - r0 as height, 100e0 + c0 * 0.01e0 as tie_lon, 15e0 - r0 * 0.01e0 as tie_lat,
       100e0 + c0 * 0.01e0 as lon_min, 100e0 + c1 * 0.01e0 as lon_max, 15e0 - r1 * 0.01e0 as lat_min, 15e0 - r0 * 0.01e0 as lat_max from x where r0 is not null""",
       "fx_points", "tie_lon tie_lat lon_min lon_max lat_min lat_max")
def window_regeo(spark, d):
    header = geo.window_header(FULL, "r0", "r1", "c0", "c1")
    return _window_frame(spark, d).filter("r0 is not null").select("point_id", *[c.alias(n) for n, c in header.items()])


@query("expand_bbox", f"with {_BOX} select point_id, w - 0.026e0 as west, s - 0.026e0 as south, e + 0.026e0 as east, n + 0.026e0 as north from p", "fx_points", "west south east north")
def expand_bbox(spark, d):
    out = geo.expand_bbox("w", "s", "e", "n", V.SOURCE.pad)
    return _boxes(spark, d).select("point_id", *[c.alias(n) for c, n in zip(out, ("west", "south", "east", "north"))])


@query("candidate_range", f"""with {_BOX} select point_id, greatest(0, cast(floor((15.005e0 - n) / 0.013e0) as bigint) - 1) as r0, cast(ceil((15.005e0 - s) / 0.013e0) as bigint) + 1 as r1,
       greatest(0, cast(floor((w - 99.995e0) / 0.013e0) as bigint) - 1) as c0, least(49, cast(ceil((e - 99.995e0) / 0.013e0) as bigint) + 1) as c1 from p""", "fx_points")
def candidate_range(spark, d):
    r0, r1 = geo.candidate_rows(V.SOURCE, F.col("s"), F.col("n"))
    c0, c1 = geo.candidate_cols(V.SOURCE, F.col("w"), F.col("e"))
    return _boxes(spark, d).select("point_id", r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"))


@query("haversine_km", """select point_id, 2e0 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians(15e0 - lat) / 2e0), 2) + cos(radians(lat)) * cos(radians(15e0)) * pow(sin(radians(100e0 - lon) / 2e0), 2)))) as km
       from fx_points""", "fx_points", "km")
def haversine_km(spark, d):
    return V.points(spark, d).select("point_id", geo.haversine_km("lon", "lat", F.lit(100.0), F.lit(15.0)).alias("km"))


@query("segment_midpoint", "select way_id, seq, (lon + lon2) / 2e0 as mid_lon, (lat + lat2) / 2e0 as mid_lat, seg_km as km from fx_segments", "fx_segments", "mid_lon:9 mid_lat:9 km")
def segment_midpoint(spark, d):
    s = joins.segments(V.ways(spark, d), "way_id", "seq")
    return joins.segment_midpoints(s).select("way_id", "seq", "mid_lon", "mid_lat", "km")


@query("segment_densify", """with n as (select *, greatest(1, cast(ceil(round(seg_km * 1000e0, 6) / 5000e0) as bigint)) as k from fx_segments),
       x as (select *, unnest(range(0, k)) as part from n)
       select way_id, seq, part, lon + (lon2 - lon) * (part + 0.5e0) / k as mid_lon, lat + (lat2 - lat) * (part + 0.5e0) / k as mid_lat, seg_km / k as km from x""",
       "fx_segments", "mid_lon:9 mid_lat:9 km", "part")
def segment_densify(spark, d):
    s = joins.segments(V.ways(spark, d), "way_id", "seq")
    return joins.segment_points(s, 5000.0).select("way_id", "seq", "part", "mid_lon", "mid_lat", "km")


@query("segment_lead", "select * from (select way_id, seq, lead(seq) over (partition by way_id order by seq) as next_seq, lead(lon) over (partition by way_id order by seq) as next_lon from fx_ways)", "fx_ways", "next_lon")
def segment_lead(spark, d):
    from ..operators.ordering import with_next

    return with_next(V.ways(spark, d).select("way_id", "seq", "lon"), ["way_id"], ["seq"], {"seq": "next_seq", "lon": "next_lon"}).drop("lon")


@query("block_id", "select cell_id, cast(floor(cell_row / 7e0) as bigint) as block_row, cast(floor((cell_col + 3) / 7e0) as bigint) as block_col from fx_grid", "fx_grid")
def block_id(spark, d):
    return V.grid(spark, d).select("cell_id", geo.block_row("cell_row", 7).alias("block_row"), geo.block_row("cell_col", 7, 3).alias("block_col"))


def polygons(spark, d):
    """One polygon per supplier: a skewed quadrilateral with a square hole, at a place and size of its own."""
    k = F.col("s_suppkey")
    cx = F.lit(100.2) + (k % 8) * 0.1
    cy = F.lit(14.9) - (k % 5) * 0.1
    size = F.lit(0.03) + (k % 7) / 100.0
    at = lambda dx, dy: F.struct((cx + F.lit(dx) * size).alias("x"), (cy + F.lit(dy) * size).alias("y"))
    outer = F.array(at(-1.0, -0.6), at(0.9, -1.0), at(1.1, 0.7), at(-0.5, 1.2))
    hole = F.array(at(-0.2, -0.2), at(-0.2, 0.3), at(0.3, 0.3), at(0.3, -0.2))
    return V.table(spark, d, "supplier").select(
        k.alias("poly_id"), (k % 9).alias("group_id"), F.array(outer, hole).alias("rings"))


#: edges of the same polygons as rows
POLYGON_SQL = """poly as (select s_suppkey as poly_id, s_suppkey % 9 as group_id, 100.2e0 + (s_suppkey % 8) * 0.1e0 as cx, 14.9e0 - (s_suppkey % 5) * 0.1e0 as cy,
         0.03e0 + (s_suppkey % 7) / 100e0 as size from supplier),
       shape as (select * from (values (-1e0, -0.6e0, 0.9e0, -1e0), (0.9e0, -1e0, 1.1e0, 0.7e0), (1.1e0, 0.7e0, -0.5e0, 1.2e0), (-0.5e0, 1.2e0, -1e0, -0.6e0),
         (-0.2e0, -0.2e0, -0.2e0, 0.3e0), (-0.2e0, 0.3e0, 0.3e0, 0.3e0), (0.3e0, 0.3e0, 0.3e0, -0.2e0), (0.3e0, -0.2e0, -0.2e0, -0.2e0)) t(ax, ay, bx, bq)),
       edge as (select poly_id, group_id, cx + ax * size as x1, cy + ay * size as y1, cx + bx * size as x2, cy + bq * size as y2 from poly, shape),
       box as (select poly_id, group_id, min(x1) as w, max(x1) as e, min(y1) as s, max(y1) as n from edge group by poly_id, group_id)"""


@query("point_in_polygon", f"""with {POLYGON_SQL}, p as (select point_id, lon, lat, point_id % (select count(*) from supplier) as poly_id from fx_points)
       select point_id, p.poly_id, sum(case when (y1 > lat) <> (y2 > lat) and lon < x1 + (x2 - x1) * (lat - y1) / (y2 - y1) then 1 else 0 end) % 2 = 1 as inside
       from p join edge on edge.poly_id = p.poly_id group by point_id, p.poly_id""", "fx_points")
def point_in_polygon(spark, d):
    """Each point against one polygon."""
    from ..runtime import with_scalars

    count = V.table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("_n"))
    p = with_scalars(V.points(spark, d).select("point_id", "lon", "lat"), count).withColumn("poly_id", F.col("point_id") % F.col("_n"))
    return p.join(polygons(spark, d), "poly_id").select("point_id", "poly_id", geo.point_in_rings(F.col("rings"), "lon", "lat").alias("inside"))


#: signed area of the edges of ``k`` (with their box w, s, e, n) inside the box
EDGE_AREA_SQL = """k1 as (select *, greatest(least(x1, x2), w) as a, least(greatest(x1, x2), e) as b from k),
       k2 as (select *, case when x1 <> x2 and b > a then y1 + (y2 - y1) / (x2 - x1) * (a - x1) end as ya, case when x1 <> x2 and b > a then y1 + (y2 - y1) / (x2 - x1) * (b - x1) end as yb from k1),
       k3 as (select *, greatest(0e0, least(n - s, ya - s)) as ha, greatest(0e0, least(n - s, yb - s)) as hb from k2),
       share as (select *, case when ya is null then 0e0 else sign(x2 - x1) * (b - a) * case when abs(yb - ya) < 1e-12 then ha
         else (hb * hb / 2e0 + (n - s) * greatest(0e0, yb - n) - ha * ha / 2e0 - (n - s) * greatest(0e0, ya - n)) / (yb - ya) end end as part from k3)"""


@query("polygon_window_area", f"""with {POLYGON_SQL}, k as (select poly_id, x1, y1, x2, y2, 100.3e0 as w, 14.5e0 as s, 100.7e0 as e, 14.8e0 as n from edge), {EDGE_AREA_SQL}
       select poly_id, abs(sum(part)) as area from share group by poly_id""", "", "area:9")
def polygon_window_area(spark, d):
    """Area of each polygon inside a fixed window, a sum over its edges."""
    edges = joins.edge_rows(polygons(spark, d).select("poly_id", "rings"))
    return joins.area_in_boxes(edges, ["poly_id"], (F.lit(100.3), F.lit(14.5), F.lit(100.7), F.lit(14.8)))


@query("dissolve_members", f"""with {POLYGON_SQL}, c as (select cell_id, 100e0 + (cell_col + 0.5e0) * 0.01e0 as lon, 15e0 - (cell_row + 0.5e0) * 0.01e0 as lat from fx_grid),
       m as (select c.cell_id, e.poly_id, e.group_id, sum(case when (y1 > lat) <> (y2 > lat) and lon < x1 + (x2 - x1) * (lat - y1) / (y2 - y1) then 1 else 0 end) % 2 = 1 as inside
         from c join box b on lon between b.w and b.e and lat between b.s and b.n join edge e on e.poly_id = b.poly_id group by c.cell_id, e.poly_id, e.group_id)
       select group_id, cell_id from m group by group_id, cell_id having bool_or(inside)""", "fx_grid")
def dissolve_members(spark, d):
    """Cells in the union of each group of polygons."""
    cells = V.grid(spark, d).select("cell_id", "cell_row", "cell_col")
    grid = Grid(100.0, 15.0, 0.01, 0.01, width=128, height=1 << 20)
    hit = joins.cells_in_groups(cells, ["cell_id", "cell_row", "cell_col"], "cell_row", "cell_col", grid, polygons(spark, d), "group_id")
    return hit.select("group_id", "cell_id")
