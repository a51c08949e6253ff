"""Spatial and lookup joins, all turned into equi-joins on computed keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import Grid
from ..functions.numeric import col, finite, valid_value
from ..functions.text import strip_prefix
from .ordering import with_next


def _spread(index: Column, *by: str) -> Column:
    """Keep an index; give rows without one scattered negative keys, which match nothing.

    NULL keys of an outer join would all land in one task.
    """
    return F.coalesce(index, F.lit(-1) - F.pmod(F.xxhash64(*by), F.lit(4096)))


def sample_grid(points: DataFrame, lon: str, lat: str, src: DataFrame, grid: Grid,
                values: dict[str, str], row: str = "src_row", column: str = "src_col",
                inside: str | None = "inside") -> DataFrame:
    """Value of the source cell under each point (left join on the computed index).

    ``values`` maps source columns to output names; nodata becomes NULL. ``inside`` tells
    whether the point is within the grid's extent, whether or not the cell has a value.
    """
    lookup = src.select(
        F.col(row).cast("bigint").alias("_r"), F.col(column).cast("bigint").alias("_c"),
        *[F.when(valid_value(v, grid.nodata), F.col(v) * F.lit(grid.value_scale)).alias(n)
          for v, n in values.items()],
    )
    r, c = geo.row_index(grid, lat), geo.col_index(grid, lon)
    keyed = points.withColumn("_r", _spread(F.when(c.isNotNull(), r), lon, lat)).withColumn(
        "_c", F.coalesce(c, F.lit(-1))
    )
    out = keyed.join(lookup, ["_r", "_c"], "left")
    extra = [] if inside is None else [(r.isNotNull() & c.isNotNull()).alias(inside)]
    return out.select(*points.columns, *extra, *values.values())


def overlap_transfer(targets: DataFrame, tgrid: Grid, src: DataFrame, sgrid: Grid, value: str,
                     target: tuple[str, str], source: tuple[str, str] = ("src_row", "src_col"),
                     out: str = "transferred", mask: Column | None = None) -> DataFrame:
    """Area-weighted transfer: a source value is split over target cells by shared area.

    Each source cell lists the target cells it touches, so the pairs are summed per target with
    map-side combining and never joined. ``<out>_cover`` is the covered share of the target's
    area, where invalid source cells count as cover; ``<out>_valid_cover`` leaves them out. A
    target that nothing covers has a NULL value. If the source's width and height are known its cover is what
    its extent covers, so source cells may be left out of a sparse table; such a target has the value 0. With
    ``mask`` only the targets it holds for are served: the others have a NULL value and no cover.
    """
    sized = sgrid.width is not None and sgrid.height is not None
    trow, tcol = target
    s = src.select(F.col(source[0]).alias("_sr"), F.col(source[1]).alias("_sc"), F.col(value).alias("_v"))
    r0, r1 = geo.candidate_rows(tgrid, geo.south(sgrid, "_sr"), geo.north(sgrid, "_sr"))
    c0, c1 = geo.candidate_cols(tgrid, geo.west(sgrid, "_sc"), geo.east(sgrid, "_sc"))
    pairs = (
        s.withColumn("_tr", F.explode(F.when(r0 <= r1, F.sequence(r0, r1))))
        .withColumn("_tc", F.explode(F.when(c0 <= c1, F.sequence(c0, c1))))
        .withColumn("_a", geo.overlap_area_m2(tgrid, "_tr", "_tc", sgrid, "_sr", "_sc"))
        .filter("_a > 0")
    )
    ok = valid_value("_v", sgrid.nodata) & (F.col("_v") >= 0)
    share = F.coalesce(F.try_divide(F.col("_a"), geo.cell_area_m2(sgrid, "_sr")), F.lit(0.0))
    sums = pairs.groupBy("_tr", "_tc").agg(
        F.coalesce(F.sum(F.when(ok, F.col("_v") * F.lit(sgrid.value_scale) * share)), F.lit(0.0)).alias(out),
        F.sum("_a").alias("_cov"),
        F.coalesce(F.sum(F.when(ok, F.col("_a"))), F.lit(0.0)).alias("_vcov"),
    )
    joined = targets.join(sums, (F.col(trow) == F.col("_tr")) & (F.col(tcol) == F.col("_tc")), "left")
    area = geo.cell_area_m2(tgrid, trow)
    cover = geo.extent_overlap_m2(tgrid, trow, tcol, sgrid) if sized else F.coalesce(F.col("_cov"), F.lit(0.0))
    served = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    return joined.withColumn("_on", served).select(
        *targets.columns, F.when(F.col("_on") & (cover > 0), F.coalesce(F.col(out), F.lit(0.0))).alias(out),
        F.when(F.col("_on"), cover / area).otherwise(F.lit(0.0)).alias(f"{out}_cover"),
        F.when(F.col("_on"), F.coalesce(F.col("_vcov") / area, F.lit(0.0))).otherwise(F.lit(0.0)).alias(f"{out}_valid_cover"),
    )


def native_pixel_totals(src: DataFrame, sgrid: Grid, value: str, targets: DataFrame, tgrid: Grid,
                        target: tuple[str, str], classes: list[str],
                        source: tuple[str, str] = ("src_row", "src_col")) -> DataFrame:
    """Give each source cell whole to the class of the target cell holding its centre."""
    s = src.filter(valid_value(value, sgrid.nodata) & (F.col(value) >= 0)).select(
        geo.row_index(tgrid, geo.center_lat(sgrid, source[0])).alias(target[0]),
        geo.col_index(tgrid, geo.center_lon(sgrid, source[1])).alias(target[1]),
        F.col(value).alias("_v"),
    ).groupBy(*target).agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_v"))
    return s.join(targets.select(*target, *classes), list(target)).groupBy(*classes).agg(
        F.sum("_n").alias("source_cells"), F.sum("_v").alias("total")
    )


def _tiles(df: DataFrame, bounds: tuple[str, str, str, str], tile: int) -> DataFrame:
    """Repeat each window once per tile of cells it touches (bounds are half-open indices)."""
    r0, r1, c0, c1 = (F.col(b) for b in bounds)
    span = lambda a, b: F.explode(F.when(b > a, F.sequence(F.floor(a / tile), F.floor((b - 1) / tile))))
    return df.withColumn("_tr", span(r0, r1)).withColumn("_tc", span(c0, c1))


def cells_in_windows(cells: DataFrame, row: str, column: str, windows: DataFrame,
                     bounds: tuple[str, str, str, str] = ("r0", "r1", "c0", "c1"),
                     tile: int = 64) -> DataFrame:
    """Range join of cells with index windows.

    Both sides are keyed by square tiles, which makes it an equi-join that needs no broadcast;
    the exact bounds are checked on the matches.
    """
    keyed = cells.withColumn("_tr", F.floor(F.col(row) / tile)).withColumn("_tc", F.floor(F.col(column) / tile))
    r0, r1, c0, c1 = (F.col(b) for b in bounds)
    hit = (F.col(row) >= r0) & (F.col(row) < r1) & (F.col(column) >= c0) & (F.col(column) < c1)
    return keyed.join(_tiles(windows, bounds, tile), ["_tr", "_tc"]).filter(hit).drop("_tr", "_tc")


def edge_rows(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """One row for each edge (x1, y1, x2, y2) of each polygon, holes included, so that no later step holds a whole polygon."""
    keep = [c for c in polygons.columns if c != rings]
    return polygons.select(*keep, F.explode(geo.polygon_edges(F.col(rings))).alias("_e")).select(*keep, "_e.*")


def polygon_windows(polygons: DataFrame, rings: str, grid: Grid) -> DataFrame:
    """The polygons without their rings, with the clamped index window of their bounding box."""
    keep = [c for c in polygons.columns if c != rings]
    boxes = edge_rows(polygons, rings).groupBy(*keep).agg(F.min("x1").alias("_w"), F.max("x1").alias("_e"), F.min("y1").alias("_s"), F.max("y1").alias("_n"))
    bounds = geo.index_window(grid, "_w", "_s", "_e", "_n")
    return boxes.select(*keep, *[b.alias(n) for b, n in zip(bounds, ("r0", "r1", "c0", "c1"))])


def polygon_spans(polygons: DataFrame, rings: str, grid: Grid) -> DataFrame:
    """Scanline fill: (polygon columns, _r, _lo, _hi), the stretches of longitude inside a polygon at each row's centre.

    Each edge lists the rows whose centre it crosses; sorted along a row, the crossings open and close by turns (even-odd,
    so holes need no care). A centre is inside if _lo <= lon < _hi. The work is edges times the rows they cross, and no
    polygon is ever one value. The columns besides the rings name a polygon.
    """
    keep = [c for c in polygons.columns if c != rings]
    place = lambda y: (F.lit(grid.tie_lat) - y) / F.lit(grid.py) - 0.5
    top = F.greatest(F.lit(0).cast("bigint"), F.floor(place(F.greatest("y1", "y2"))))
    last = F.ceil(place(F.least("y1", "y2")))
    last = last if grid.height is None else F.least(last, F.lit(grid.height - 1).cast("bigint"))
    sound = finite("x1") & finite("x2") & finite("y1") & finite("y2") & (F.col("y1") != F.col("y2"))
    crossed = edge_rows(polygons, rings).withColumn("_r", F.explode(F.when(sound & (top <= last), F.sequence(top, last)))).withColumn("_lat", geo.center_lat(grid, "_r"))
    crossed = crossed.filter((F.col("y1") > F.col("_lat")) != (F.col("y2") > F.col("_lat")))
    at = F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col("_lat") - F.col("y1")) / (F.col("y2") - F.col("y1"))
    along = W.partitionBy(*keep, "_r").orderBy("_lo")
    paired = crossed.select(*keep, "_r", at.alias("_lo")).withColumn("_hi", F.lead("_lo").over(along)).withColumn("_k", F.row_number().over(along))
    return paired.filter((F.col("_k") % 2 == 1) & (F.col("_lo") < F.col("_hi"))).drop("_k")


def cells_in_polygons(cells: DataFrame, row: str, column: str, grid: Grid, polygons: DataFrame,
                      rings: str = "rings", tile: int = 64, mark: str | None = None) -> DataFrame:
    """Cells whose centre lies in a polygon, met on the row and a tile of columns of the polygon's spans.

    With ``mark`` all cells of the bounding window are kept and the test is a flag column.
    """
    keep = [c for c in polygons.columns if c != rings]
    spans, lon = polygon_spans(polygons, rings, grid), geo.center_lon(grid, column)
    if mark:
        near = cells_in_windows(cells, row, column, polygon_windows(polygons, rings, grid), tile=tile)
        lines = spans.groupBy(*keep, "_r").agg(F.collect_list(F.struct("_lo", "_hi")).alias("_spans"))
        lines = lines.withColumnsRenamed({c: f"_p_{c}" for c in keep})
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in keep], F.col(row) == F.col("_r"))
        flag = F.coalesce(F.exists("_spans", lambda s: (lon >= s["_lo"]) & (lon < s["_hi"])), F.lit(False))
        return near.join(lines, same, "left").withColumn(mark, flag).drop("_r", "_spans", *[f"_p_{c}" for c in keep])
    # a column more on each side, so that rounding cannot lose a cell
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("_lo") - grid.tie_lon) / grid.px - 0.5))
    last = F.ceil((F.col("_hi") - grid.tie_lon) / grid.px - 0.5)
    last = last if grid.width is None else F.least(last, F.lit(grid.width - 1).cast("bigint"))
    tiled = spans.withColumn("_tc", F.explode(F.when(first <= last, F.sequence(F.floor(first / tile), F.floor(last / tile)))))
    keyed = cells.withColumn("_r", F.col(row).cast("bigint")).withColumn("_tc", F.floor(F.col(column) / tile))
    return keyed.join(tiled, ["_r", "_tc"]).filter((lon >= F.col("_lo")) & (lon < F.col("_hi"))).drop("_r", "_tc", "_lo", "_hi")


def area_in_boxes(edges: DataFrame, key: list[str], box: tuple) -> DataFrame:
    """Planar area of each polygon inside its box, as a sum over edge rows that carry the box (w, s, e, n).

    Each edge gives its own signed area inside the box; outer rings and holes must run in opposite senses.
    """
    share = geo.edge_area_in_box("x1", "y1", "x2", "y2", *box)
    return edges.groupBy(*key).agg(F.abs(F.sum(share)).alias("area"))


def windows_meeting_polygons(windows: DataFrame, polygons: DataFrame, grid: Grid, rings: str = "rings",
                             tile: int = 64) -> DataFrame:
    """Window-polygon pairs whose bounding windows share a cell, each pair once; polygons come without their rings.

    Both sides are keyed by tiles; a pair sharing several tiles is kept in its first one.
    """
    w = _tiles(windows, ("r0", "r1", "c0", "c1"), tile)
    boxes = polygon_windows(polygons, rings, grid).withColumnsRenamed({"r0": "_r0", "r1": "_r1", "c0": "_c0", "c1": "_c1"})
    p = _tiles(boxes, ("_r0", "_r1", "_c0", "_c1"), tile)
    first = lambda a, b, key: F.col(key) == F.floor(F.greatest(a, b) / tile)
    meet = (F.col("r0") < F.col("_r1")) & (F.col("_r0") < F.col("r1")) & (F.col("c0") < F.col("_c1")) & (F.col("_c0") < F.col("c1"))
    return w.join(p, ["_tr", "_tc"]).filter(meet & first("r0", "_r0", "_tr") & first("c0", "_c0", "_tc")).drop(
        "_tr", "_tc", "_r0", "_r1", "_c0", "_c1")


def windows_on_polygons(windows: DataFrame, zone: str, polygons: DataFrame, polygon: list[str], grid: Grid,
                        rings: str = "rings", tile: int = 64) -> DataFrame:
    """(zone, polygon columns, area) of the window-polygon pairs whose bounding windows share a cell.

    ``windows`` has index bounds r0, r1, c0, c1. Pairs are found on boxes alone; edges join the pairs afterwards, as rows.
    """
    shapes = polygons.select(*polygon, rings)
    pairs = windows_meeting_polygons(windows.select(zone, "r0", "r1", "c0", "c1"), shapes, grid, rings, tile).select(
        zone, *polygon, geo.west(grid, "c0").alias("w"), geo.north(grid, "r1").alias("s"), geo.west(grid, "c1").alias("e"), geo.north(grid, "r0").alias("n"))
    return area_in_boxes(pairs.join(edge_rows(shapes, rings), polygon), [zone, *polygon], ("w", "s", "e", "n"))


def cells_in_groups(cells: DataFrame, key: list[str], row: str, column: str, grid: Grid,
                    polygons: DataFrame, group: str, rings: str = "rings") -> DataFrame:
    """Union of a group's polygons over cells: in the union if in any member."""
    hit = cells_in_polygons(cells.select(*key, row, column) if row not in key else cells.select(*key),
                            row, column, grid, polygons, rings)
    return hit.groupBy(group, *key).agg(F.count(F.lit(1)).alias("member_hits"))


def segments(vertices: DataFrame, way: str, seq: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Consecutive vertex pairs of each way; ways of any length."""
    nxt = with_next(vertices, [way], [seq], {lon: "lon2", lat: "lat2"})
    return nxt.filter(F.col("lon2").isNotNull()).withColumn(
        "seg_km", geo.haversine_km(lon, lat, "lon2", "lat2")
    )


def segment_midpoints(segs: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One point per segment, carrying its whole length."""
    return segs.withColumn("mid_lon", (F.col(lon) + F.col("lon2")) / 2.0).withColumn(
        "mid_lat", (F.col(lat) + F.col("lat2")) / 2.0
    ).withColumn("km", F.col("seg_km"))


def segment_points(segs: DataFrame, step_m: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Split each segment into equal parts no longer than ``step_m``; one midpoint per part."""
    metres = F.round(F.col("seg_km") * 1000.0, 6)  # rounding noise must not add a part
    n = F.greatest(F.lit(1).cast("bigint"), F.ceil(metres / float(step_m)))
    parts = segs.withColumn("_n", n).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))
    )
    t = (F.col("part") + 0.5) / F.col("_n")
    return (
        parts.withColumn("mid_lon", F.col(lon) + (F.col("lon2") - F.col(lon)) * t)
        .withColumn("mid_lat", F.col(lat) + (F.col("lat2") - F.col(lat)) * t)
        .withColumn("km", F.col("seg_km") / F.col("_n"))
        .drop("_n")
    )


def left_lookup(df: DataFrame, table: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left merge; columns the two tables share get the suffix on the right side."""
    shared = [c for c in table.columns if c != key and c in df.columns]
    return df.join(table.withColumnsRenamed({c: c + suffix for c in shared}), key, "left")


def fallback_lookup(df: DataFrame, table: DataFrame, key: str, lookup: str, value: str,
                    prefix: str, default=None, out: str | None = None) -> DataFrame:
    """Value by key, else by the prefixed key, else the default.

    Both spellings are brought to one normal key first, so a single left join does the work; the
    plain spelling wins when both exist.
    """
    name = out or value
    norm = table.select(
        strip_prefix(lookup, prefix).alias(key), F.col(value).alias("_v"),
        col(lookup).startswith(prefix).alias("_p"),
    ).groupBy(key).agg(F.min_by("_v", F.struct("_p")).alias("_v"))
    joined = df.join(norm, key, "left")
    v = F.col("_v") if default is None else F.coalesce(F.col("_v"), F.lit(default))
    return joined.select(*df.columns, v.alias(name))
