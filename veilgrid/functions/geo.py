"""Grid and geometry arithmetic as column expressions (degrees in, metres out where named)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import finite, col

EARTH_RADIUS_M = 6_371_000.0
EARTH_RADIUS_KM = 6371.0


@dataclass(frozen=True)
class Grid:
    """A north-up grid header: upper-left corner, pixel sizes and, if known, its extent."""

    tie_lon: float
    tie_lat: float
    px: float
    py: float
    width: int | None = None
    height: int | None = None
    nodata: float | None = None
    value_scale: float = 1.0

    @property
    def pad(self) -> float:
        """Margin used when cropping a source to this grid."""
        return 2.0 * max(self.px, self.py)


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def center_lon(g: Grid, c) -> Column:
    return _d(g.tie_lon) + (col(c) + F.lit(0.5)) * _d(g.px)


def center_lat(g: Grid, r) -> Column:
    return _d(g.tie_lat) - (col(r) + F.lit(0.5)) * _d(g.py)


def west(g: Grid, c) -> Column:
    return _d(g.tie_lon) + col(c) * _d(g.px)


def east(g: Grid, c) -> Column:
    return west(g, c) + _d(g.px)


def north(g: Grid, r) -> Column:
    return _d(g.tie_lat) - col(r) * _d(g.py)


def south(g: Grid, r) -> Column:
    return north(g, r) - _d(g.py)


def band_area_m2(lon_width: Column, lat_a: Column, lat_b: Column) -> Column:
    """Area on the sphere between two parallels over a longitude width."""
    return (
        F.lit(EARTH_RADIUS_M * EARTH_RADIUS_M)
        * F.radians(lon_width)
        * F.abs(F.sin(F.radians(lat_a)) - F.sin(F.radians(lat_b)))
    )


def cell_area_m2(g: Grid, r) -> Column:
    r = col(r)
    return band_area_m2(_d(g.px), _d(g.tie_lat) - r * _d(g.py), _d(g.tie_lat) - (r + F.lit(1)) * _d(g.py))


def overlap_area_m2(t: Grid, t_row, t_col, s: Grid, s_row, s_col) -> Column:
    """Area shared by a target and a source cell; 0 when they do not meet."""
    w, e = F.greatest(west(t, t_col), west(s, s_col)), F.least(east(t, t_col), east(s, s_col))
    lo, hi = F.greatest(south(t, t_row), south(s, s_row)), F.least(north(t, t_row), north(s, s_row))
    return F.when((e > w) & (hi > lo), band_area_m2(e - w, hi, lo)).otherwise(F.lit(0.0))


def row_index(g: Grid, lat) -> Column:
    """Row holding a latitude, NULL outside a grid of known height and for a latitude that is not finite."""
    r = F.when(finite(lat), F.floor((_d(g.tie_lat) - col(lat)) / _d(g.py)))
    return r if g.height is None else F.when((r >= 0) & (r < g.height), r)


def col_index(g: Grid, lon) -> Column:
    c = F.when(finite(lon), F.floor((col(lon) - _d(g.tie_lon)) / _d(g.px)))
    return c if g.width is None else F.when((c >= 0) & (c < g.width), c)


def index_window(g: Grid, w, s, e, n) -> list[Column]:
    """(row_start, row_stop, col_start, col_stop) of a bbox, clamped to the grid.

    All four are NULL when the clamped window is empty or a side is not finite.
    """
    clamp = lambda x, top: F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(top).cast("bigint"), x))
    r0 = clamp(F.floor((_d(g.tie_lat) - col(n)) / _d(g.py)), g.height)
    r1 = clamp(F.ceil((_d(g.tie_lat) - col(s)) / _d(g.py)), g.height)
    c0 = clamp(F.floor((col(w) - _d(g.tie_lon)) / _d(g.px)), g.width)
    c1 = clamp(F.ceil((col(e) - _d(g.tie_lon)) / _d(g.px)), g.width)
    ok = finite(w) & finite(s) & finite(e) & finite(n) & (r1 > r0) & (c1 > c0)
    return [F.when(ok, x) for x in (r0, r1, c0, c1)]


def window_header(g: Grid, r0, r1, c0, c1) -> dict[str, Column]:
    """Header columns of the crop [r0, r1) x [c0, c1)."""
    r0, r1, c0, c1 = (col(x) for x in (r0, r1, c0, c1))
    return {
        "width": c1 - c0,
        "height": r1 - r0,
        "tie_lon": _d(g.tie_lon) + c0 * _d(g.px),
        "tie_lat": _d(g.tie_lat) - r0 * _d(g.py),
        "lon_min": _d(g.tie_lon) + c0 * _d(g.px),
        "lon_max": _d(g.tie_lon) + c1 * _d(g.px),
        "lat_min": _d(g.tie_lat) - r1 * _d(g.py),
        "lat_max": _d(g.tie_lat) - r0 * _d(g.py),
    }


def expand_bbox(w, s, e, n, pad: float) -> list[Column]:
    return [col(w) - _d(pad), col(s) - _d(pad), col(e) + _d(pad), col(n) + _d(pad)]


def candidate_rows(s: Grid, lat_lo: Column, lat_hi: Column) -> tuple[Column, Column]:
    """Inclusive source row range that can touch [lat_lo, lat_hi]; NULL if a side is not finite."""
    return _clamped(
        finite(lat_lo) & finite(lat_hi),
        F.floor((_d(s.tie_lat) - lat_hi) / _d(s.py)) - F.lit(1),
        F.ceil((_d(s.tie_lat) - lat_lo) / _d(s.py)) + F.lit(1),
        s.height,
    )


def candidate_cols(s: Grid, lon_lo: Column, lon_hi: Column) -> tuple[Column, Column]:
    return _clamped(
        finite(lon_lo) & finite(lon_hi),
        F.floor((lon_lo - _d(s.tie_lon)) / _d(s.px)) - F.lit(1),
        F.ceil((lon_hi - _d(s.tie_lon)) / _d(s.px)) + F.lit(1),
        s.width,
    )


def _clamped(ok: Column, start: Column, stop: Column, limit: int | None) -> tuple[Column, Column]:
    start = F.greatest(start, F.lit(0).cast("bigint"))
    stop = stop if limit is None else F.least(stop, F.lit(limit - 1).cast("bigint"))
    return F.when(ok, start), F.when(ok, stop)


def extent_overlap_m2(t: Grid, t_row, t_col, s: Grid) -> Column:
    """Area of a target cell inside the whole extent of a source of known width and height."""
    w, e = F.greatest(west(t, t_col), _d(s.tie_lon)), F.least(east(t, t_col), _d(s.tie_lon) + F.lit(float(s.width)) * _d(s.px))
    lo, hi = F.greatest(south(t, t_row), _d(s.tie_lat) - F.lit(float(s.height)) * _d(s.py)), F.least(north(t, t_row), _d(s.tie_lat))
    return F.when((e > w) & (hi > lo), band_area_m2(e - w, hi, lo)).otherwise(F.lit(0.0))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = (col(x) for x in (lon1, lat1, lon2, lat2))
    half_lat, half_lon = F.radians(lat2 - lat1) / F.lit(2.0), F.radians(lon2 - lon1) / F.lit(2.0)
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), F.lit(2.0)
    )
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def block_row(r, size: int, shift: int = 0) -> Column:
    return F.floor((col(r) + F.lit(shift)) / F.lit(float(size)))


def ring_edges(ring: Column) -> Column:
    """array<struct<x,y>> -> array<struct<x1,y1,x2,y2>>, closing the ring."""
    n = F.size(ring)
    follow = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(
        ring, follow,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def polygon_edges(rings: Column) -> Column:
    """All edges of a polygon, holes included, as one array."""
    return F.flatten(F.transform(rings, ring_edges))


def point_in_edges(edges: Column, x, y) -> Column:
    """Even-odd test of a point against the edges of a polygon."""
    x, y = col(x), col(y)

    def flips(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + flips(e)) % 2 == 1


def point_in_rings(rings: Column, x, y) -> Column:
    return point_in_edges(polygon_edges(rings), x, y)


def edge_area_in_box(x1, y1, x2, y2, w, s, e, n) -> Column:
    """Signed share of one polygon edge in the planar area of polygon and box.

    It is the integral of the edge's height, held inside [s, n] and measured from s, over the
    part of [w, e] the edge spans. Summed over all edges of a closed ring it gives the area of
    the intersection, up to the ring's orientation; no clipping of vertices is needed.
    """
    x1, y1, x2, y2, w, s, e, n = (col(v) for v in (x1, y1, x2, y2, w, s, e, n))
    a = F.greatest(F.least(x1, x2), w)
    b = F.least(F.greatest(x1, x2), e)
    slope = F.try_divide(y2 - y1, x2 - x1)
    ya, yb = y1 + slope * (a - x1), y1 + slope * (b - x1)
    hold = lambda u: F.greatest(F.lit(0.0), F.least(n - s, u - s))
    # antiderivative of the held height: quadratic inside the box, linear above it
    anti = lambda u: hold(u) * hold(u) / F.lit(2.0) + (n - s) * F.greatest(F.lit(0.0), u - n)
    flat = F.abs(yb - ya) < F.lit(1e-12)
    area = F.when(flat, hold(ya) * (b - a)).otherwise((b - a) * (anti(yb) - anti(ya)) / (yb - ya))
    return F.when((x1 != x2) & (b > a), F.signum(x2 - x1) * area).otherwise(F.lit(0.0))


def edges_area_in_box(edges: Column, w, s, e, n) -> Column:
    """Planar area of polygon and box; outer rings and holes must run in opposite senses."""
    total = F.aggregate(
        edges, F.lit(0.0),
        lambda acc, d: acc + edge_area_in_box(d["x1"], d["y1"], d["x2"], d["y2"], w, s, e, n),
    )
    return F.abs(total)


def rings_area_in_box(rings: Column, w, s, e, n) -> Column:
    return edges_area_in_box(polygon_edges(rings), w, s, e, n)
