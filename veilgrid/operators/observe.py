"""Observation stacks: how often each cell was seen well enough."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import Grid
from ..functions.labels import landcover_group
from ..functions.numeric import finite, valid_exposure, valid_value
from ..runtime import cut


def coherent(value: str = "coherence", threshold: float = 0.3, slack: float = 0.0) -> Column:
    """Finite and at least the threshold; ``slack`` allows for rounding of derived values."""
    return finite(value) & (F.col(value) >= F.lit(threshold - slack))


def observation_counts(obs: DataFrame, key: str, thresholds: dict[str, float],
                       value: str = "coherence", slack: float = 0.0) -> DataFrame:
    """Per cell: coherent observations at each threshold, and ``n_seen`` = pairs that cover it."""
    return obs.groupBy(key).agg(
        *[F.count_if(coherent(value, t, slack)).alias(name) for name, t in thresholds.items()],
        F.count(F.lit(1)).alias("n_seen"),
    )


def attach_counts(cells: DataFrame, obs: DataFrame, key: str, thresholds: dict[str, float],
                  value: str = "coherence", slack: float = 0.0) -> DataFrame:
    """Cells with their counts; a cell no pair covers has 0 and is not ``inside_any``.

    Takes one row for each cell and pair that covers it; ``raster_stack`` works from headers and pixels instead.
    """
    counts = observation_counts(obs, key, thresholds, value, slack)
    joined = cells.join(counts, key, "left")
    names = [*thresholds, "n_seen"]
    return joined.select(
        *cells.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names],
        (F.coalesce(F.col("n_seen"), F.lit(0)) > 0).alias("inside_any"),
    )


def pair_totals(obs: DataFrame, pair: str, value: str = "coherence", threshold: float = 0.3, slack: float = 0.0) -> DataFrame:
    return obs.groupBy(pair).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(coherent(value, threshold, slack)).alias("n_coherent")
    )


#: columns of a raster catalogue: one header a row; nodata and value_scale may be NULL
HEADER = ["tie_lon", "tie_lat", "px", "py", "width", "height", "nodata", "value_scale"]


def covering_rasters(points: DataFrame, lon: str, lat: str, rasters: DataFrame, raster: str = "raster_id",
                     tile: float = 1.0) -> DataFrame:
    """Each point with every raster whose extent holds it, and the pixel (``_r``, ``_c``) it falls in.

    Headers are data, so any number of rasters with grids of their own is met by one join. Both sides are keyed by
    tiles of ``tile`` degrees, an equi-join; the pixel index then decides exactly. Points that are not finite and
    headers with a NULL, non-finite or non-positive size cover nothing.
    """
    head = rasters.select(raster, *HEADER)
    east, south = F.col("tie_lon") + F.col("width") * F.col("px"), F.col("tie_lat") - F.col("height") * F.col("py")
    sound = finite("tie_lon") & finite("tie_lat") & finite("px") & finite("py") & (F.col("px") > 0) & (F.col("py") > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    # a tile more on each side, so that rounding at an edge cannot lose a point
    span = lambda a, b: F.explode(F.sequence(F.floor(a / tile) - 1, F.floor(b / tile) + 1))
    tiles = head.filter(sound).withColumn("_tx", span(F.col("tie_lon"), east)).withColumn("_ty", span(south, F.col("tie_lat")))
    grid = Grid(F.col("tie_lon"), F.col("tie_lat"), F.col("px"), F.col("py"), F.col("width"), F.col("height"))
    keyed = points.filter(finite(lon) & finite(lat)).withColumn("_tx", F.floor(F.col(lon) / tile)).withColumn("_ty", F.floor(F.col(lat) / tile))
    met = keyed.join(tiles, ["_tx", "_ty"]).withColumn("_r", geo.row_index(grid, lat)).withColumn("_c", geo.col_index(grid, lon))
    return met.filter(F.col("_r").isNotNull() & F.col("_c").isNotNull()).select(*points.columns, raster, "nodata", "value_scale", "_r", "_c")


def stack_samples(cells: DataFrame, key: str, lon: str, lat: str, rasters: DataFrame, pixels: DataFrame,
                  raster: str = "raster_id", row: str = "row", column: str = "col", value: str = "value",
                  tile: float = 1.0) -> DataFrame:
    """(key, raster, value): one row for each cell centre inside a raster; value is NULL where it has none.

    Pixels may be sparse: a pixel that is left out, nodata or not finite has no value, but its cell is inside.
    """
    met = covering_rasters(cells.select(key, lon, lat), lon, lat, rasters, raster, tile)
    held = pixels.select(raster, F.col(row).cast("bigint").alias("_r"), F.col(column).cast("bigint").alias("_c"), F.col(value).cast("double").alias("_v"))
    got = met.join(held, [raster, "_r", "_c"], "left")
    ok = valid_value("_v", F.col("nodata").cast("double"))
    return got.select(key, raster, F.when(ok, F.col("_v") * F.coalesce(F.col("value_scale").cast("double"), F.lit(1.0))).alias(value))


def raster_stack(cells: DataFrame, key: str, lon: str, lat: str, rasters: DataFrame, pixels: DataFrame,
                 thresholds: dict[str, float], raster: str = "raster_id", value: str = "value",
                 slack: float = 0.0, **names) -> tuple[DataFrame, DataFrame]:
    """Counts by cell and by raster of a stack of rasters, each with its own header.

    By cell: coherent rasters at each threshold, ``n_inside`` and ``inside_any`` (the centre lies in an extent, whether or
    not there is a value). By raster, also those that cover no cell: ``inside_cells``, ``valued_cells``, the coherent
    cells of each threshold, and ``outside_unit``, the values that are no coherence because they leave [0, 1]. Values
    outside [0, 1] still count by the thresholds. Both tables come from one frozen set of sums.
    """
    samples = stack_samples(cells, key, lon, lat, rasters, pixels, raster, value=value, **names)
    v = F.col(value)
    figures = [
        *[F.count_if(coherent(value, t, slack)).alias(n) for n, t in thresholds.items()], F.count(F.lit(1)).alias("_inside"), F.count(v).alias("_valued"),
        F.count_if((v < 0) | (v > 1)).alias("_outside"),
    ]
    # each sample is read once; both groupings are summed before the shuffle
    sums = cut(samples.groupingSets([[key], [raster]], key, raster).agg(F.grouping(key).alias("_by_raster"), *figures))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    by_cell = cells.join(sums.filter("_by_raster = 0").select(key, *thresholds, "_inside"), key, "left").select(
        *cells.columns, *[zero(n).alias(n) for n in thresholds], zero("_inside").alias("n_inside"), (zero("_inside") > 0).alias("inside_any"))
    by_raster = rasters.select(raster).join(sums.filter("_by_raster = 1").select(raster, *thresholds, "_inside", "_valued", "_outside"), raster, "left").select(
        raster, *[zero(n).alias(n) for n in thresholds], zero("_inside").alias("inside_cells"), zero("_valued").alias("valued_cells"), zero("_outside").alias("outside_unit"))
    return by_cell, by_raster


def majority_need(n_pairs: int) -> int:
    return math.ceil(n_pairs / 2)


def observability_flags(df: DataFrame, n_pairs: int, count: str = "n_obs") -> DataFrame:
    """Add the observable fraction and the any / majority / stable75 / low25 flags.

    low25 is n < ceil(P/4), which for whole n is the same as n/P < 1/4.
    """
    n = F.col(count)
    return df.withColumns({
        "obs_fraction": n / F.lit(float(max(1, n_pairs))),
        "any_obs": n >= 1,
        "majority": n >= majority_need(n_pairs),
        "stable75": n >= math.ceil(n_pairs * 0.75),
        "low25": n < math.ceil(n_pairs * 0.25),
    })


def screen(df: DataFrame, velocity: str, threshold: float = 5.0, require_exposure: tuple[str, ...] = (),
           require_inside: bool = True) -> DataFrame:
    """Add ``base`` (usable cell), ``strong`` and ``nonstrong`` by the deformation screen."""
    base = finite(velocity)
    if require_inside:
        base = base & F.col("inside_any")
    for e in require_exposure:
        base = base & F.coalesce(valid_exposure(e), F.lit(False))
    strong = F.coalesce(F.col(velocity) <= -threshold, F.lit(False))
    return df.withColumn("base", base).withColumn("strong", F.col("base") & strong).withColumn(
        "nonstrong", F.col("base") & ~F.col("strong")
    )


def cell_table(df: DataFrame, grid: Grid, row: str, column: str, velocity: str, population: str,
               builtup: str, pop_cover: str, built_cover: str, count: str = "n_obs") -> DataFrame:
    """The 15-column projection of usable cells; flags become 0/1 integers."""
    flag = lambda c: F.col(c).cast("int")
    return df.filter("base").select(
        F.col(row).alias("row"), F.col(column).alias("col"),
        geo.center_lon(grid, column).alias("lon_center"), geo.center_lat(grid, row).alias("lat_center"),
        F.col(velocity).alias("vlm_mm_yr"), F.col(count).alias("observable_count"),
        F.col("obs_fraction").alias("observable_fraction"), flag("any_obs").alias("any_observable"),
        flag("majority").alias("majority_observable"),
        (~F.col("majority")).cast("int").alias("not_majority_observable"),
        flag("strong").alias("strong_sub_5mm"),
        F.col(population).alias("population_weighted"), F.col(pop_cover).alias("population_cover_fraction"),
        F.col(builtup).alias("builtup_m2_weighted"), F.col(built_cover).alias("builtup_cover_fraction"),
    )


def with_landcover(df: DataFrame, code: str = "landcover_code") -> DataFrame:
    return df.withColumn("landcover_group", landcover_group(code))
