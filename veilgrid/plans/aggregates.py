"""Grouped statistics: exposure accounts, closures, rollups, zones, networks, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import haldane_or, ratio0, wmean, wsum
from ..operators import binomial, exposure, joins, meta, observe, ordering, resample
from ..runtime import attach_to_rows
from . import views as V
from .registry import query

HIDDEN_SQL = {"never_observable": "not any_obs", "not_majority": "not majority", "not_stable75": "not stable75"}
CLASS_SQL = {"any_observable": "any_obs", "majority_observable": "majority", "not_majority_observable": "not majority",
             "never_observable": "not any_obs", "obs_lt_0p25": "low25"}


def _account_sql(group: str, classes: bool) -> tuple[str, str]:
    """SQL and rounding list of the exposure account over a CTE ``f`` with flags and w columns."""
    n = lambda m: f"count(*) filter (where {m})"
    s = lambda x, m: f"coalesce(sum({x}) filter (where {m}), 0e0)"
    r = lambda a, b: f"coalesce(({a}) / nullif({b}, 0), 0e0)"
    strong_n = f"({n('strong')})"
    cols = {
        "coherence_threshold": "0.3e0", "n_pairs": "7", "valid_vlm_cells": n("vlm_mm_yr is not null"),
        "covered_vlm_cells": n("base"), "strong_sub_5mm_cells": n("strong"),
        "strong_sub_5mm_fraction": r(n("strong"), n("base")),
        "strong_sub_5mm_mean_vlm_mm_yr": "avg(vlm_mm_yr) filter (where strong)",
        "strong_sub_5mm_mean_observability": "avg(obs_fraction) filter (where strong)",
        "strong_sub_5mm_obs_lt_0p25_fraction": r(n("strong and low25"), strong_n),
        "strong_vs_nonstrong_not_majority_odds_ratio":
            f"({n('strong and not majority')} + 0.5e0) * ({n('nonstrong and majority')} + 0.5e0) / "
            f"(({n('strong and majority')} + 0.5e0) * ({n('nonstrong and not majority')} + 0.5e0))",
    }
    for h, m in HIDDEN_SQL.items():
        cols[f"strong_sub_5mm_{h}_fraction"] = r(n(f"strong and {m}"), strong_n)
    for name, w, unit, div in (("population", "pop_w", "", ""), ("builtup", "built_w", "_km2", " / 1e6")):
        cols[f"total_{name}{unit}_vlm_grid"] = s(w, "base") + div
        cols[f"strong_sub_5mm_{name}{unit}"] = s(w, "strong") + div
        cols[f"strong_sub_5mm_{name}_fraction"] = r(s(w, "strong"), s(w, "base"))
        for h, m in HIDDEN_SQL.items():
            cols[f"strong_sub_5mm_{name}_{h}{unit}"] = s(w, f"strong and {m}") + div
            cols[f"strong_sub_5mm_{name}_{h}_fraction"] = r(s(w, f"strong and {m}"), s(w, "strong"))
        if classes:
            for c, m in CLASS_SQL.items():
                cols[f"{name}_{c}{unit}"] = s(w, f"base and {m}") + div
                cols[f"{name}_{c}_fraction"] = r(s(w, f"base and {m}"), s(w, "base"))
            cols[f"{name}_weighted_mean_observability"] = r(s(f"{w} * obs_fraction", "base"), s(w, "base"))
    if classes:
        for c in ("pop", "built"):
            cols[f"mean_{c}_cover_fraction"] = "avg(cover_fraction) filter (where base)"
    else:
        cols["nonstrong_not_majority_fraction"] = r(n("nonstrong and not majority"), n("nonstrong"))
    whole = {"n_pairs", "valid_vlm_cells", "covered_vlm_cells", "strong_sub_5mm_cells", "coherence_threshold"}
    rnd = " ".join(c + ":8" * ("_km2" in c) for c in cols if c not in whole)
    body = ", ".join(f"{e} as {c}" for c, e in cols.items())
    return f"select {group}, {body} from f group by {group}", rnd


_full, _full_rnd = _account_sql("region_id", True)
_INTS = "n_pairs valid_vlm_cells covered_vlm_cells strong_sub_5mm_cells"


@query("hidden_exposure_summary",
       f"with f as (select *, population as pop_w, builtup_m2 as built_w from fx_flags) {_full}", "fx_flags", _full_rnd, _INTS)
def hidden_exposure_summary(spark, d):
    """Flagship: the full account per region."""
    return exposure.hidden_exposure_summary(V.flags(spark, d), ["region_id"], V.N_PAIRS, V.THRESHOLD)


_multi, _multi_rnd = _account_sql("region_id", False)


@query("multi_region_summary", f"""with f as (select * replace (inside_any as base, inside_any and vlm_mm_yr <= -5e0 as strong,
       inside_any and vlm_mm_yr > -5e0 as nonstrong), coalesce(population, 0e0) as pop_w, coalesce(builtup_m2, 0e0) as built_w
       from fx_flags) {_multi}""", "fx_flags", _multi_rnd, _INTS)
def multi_region_summary(spark, d):
    """Per-region account where missing exposure counts as 0."""
    return exposure.region_summary(V.flags(spark, d, require_exposure=()), ["region_id"], V.N_PAIRS, V.THRESHOLD)


@query("contingency_or", """select region_id, count(*) filter (where strong and not majority) as a,
       count(*) filter (where strong and majority) as b, count(*) filter (where nonstrong and not majority) as c,
       count(*) filter (where nonstrong and majority) as d,
       (count(*) filter (where strong and not majority) + 0.5e0) * (count(*) filter (where nonstrong and majority) + 0.5e0) /
       ((count(*) filter (where strong and majority) + 0.5e0) * (count(*) filter (where nonstrong and not majority) + 0.5e0)) as odds_ratio
       from fx_flags group by region_id""", "fx_flags", "odds_ratio")
def contingency_or(spark, d):
    t = V.flags(spark, d).groupBy("region_id").agg(*exposure.contingency())
    return t.withColumn("odds_ratio", haldane_or("a", "b", "c", "d"))


_PTS = """p as (select velocity_mm_yr as v, s.src_value as population, p.weight as builtup, p.lon, p.lat
          from fx_points p left join fx_src s on s.src_row = floor((15.005e0 - p.lat) / 0.013e0) and s.src_col = floor((p.lon - 99.995e0) / 0.013e0)
            and floor((p.lon - 99.995e0) / 0.013e0) between 0 and 49)"""


def _sampled_points(spark, d):
    pts = V.points(spark, d).withColumnRenamed("weight", "builtup")
    return joins.sample_grid(pts, "lon", "lat", V.source_grid(spark, d), V.SOURCE, {"src_value": "population"}, inside=None)


def _closed_points(spark, d):
    return _sampled_points(spark, d).filter("velocity_mm_yr is not null and population is not null and builtup is not null")


@query("threshold_closure", f"""with {_PTS}, b as (select * from p where v is not null and population is not null and builtup is not null),
       t as (select unnest([2e0, 5e0, 10e0, 15e0]) as threshold_mm_per_year),
       c as (select quantile_cont(v, 0.5e0) as cv, quantile_cont(population, 0.5e0) as cp, quantile_cont(builtup, 0.5e0) as cb
             from b where v > -0.5e0 and v < 0.5e0)
       select threshold_mm_per_year, count(*) as n_valid_points, count(*) filter (where v <= -threshold_mm_per_year) as n_strong_points,
         count(*) filter (where v > -0.5e0 and v < 0.5e0) as n_control_points,
         count(*) filter (where v <= -threshold_mm_per_year) / cast(count(*) as double) as strong_point_fraction,
         coalesce(sum(population) filter (where v <= -threshold_mm_per_year), 0e0) as strong_population,
         coalesce(sum(builtup) filter (where v <= -threshold_mm_per_year), 0e0) as strong_builtup,
         coalesce(sum(population) filter (where v <= -threshold_mm_per_year), 0e0) / nullif(sum(population), 0e0) as strong_population_share,
         coalesce(sum(builtup) filter (where v <= -threshold_mm_per_year), 0e0) / nullif(sum(builtup), 0e0) as strong_builtup_share,
         quantile_cont(v, 0.5e0) filter (where v <= -threshold_mm_per_year) as strong_velocity_mm_yr_median,
         quantile_cont(population, 0.5e0) filter (where v <= -threshold_mm_per_year) as strong_population_median,
         quantile_cont(builtup, 0.5e0) filter (where v <= -threshold_mm_per_year) as strong_builtup_median,
         max(cv) as control_velocity_mm_yr_median, max(cp) as control_population_median, max(cb) as control_builtup_median
       from b, t, c group by threshold_mm_per_year""", "fx_points fx_src",
       "strong_point_fraction strong_population:4 strong_builtup:4 strong_population_share strong_builtup_share strong_velocity_mm_yr_median "
       "strong_population_median strong_builtup_median control_velocity_mm_yr_median control_population_median control_builtup_median")
def threshold_closure(spark, d):
    return exposure.threshold_closure(_closed_points(spark, d), [2.0, 5.0, 10.0, 15.0])


@query("closure_summary", f"""with {_PTS} select count(*) as n_input_rows, count(*) as n_valid_xy_rows,
       count(*) filter (where population is not null) as n_valid_closure_rows,
       coalesce(sum(population) filter (where population is not null), 0e0) as total_population,
       coalesce(sum(builtup) filter (where population is not null), 0e0) as total_builtup,
       min(lon) as lon_min, max(lon) as lon_max, min(lat) as lat_min, max(lat) as lat_max,
       quantile_cont(v, 0.05e0) filter (where population is not null) as velocity_q05,
       quantile_cont(v, 0.5e0) filter (where population is not null) as velocity_median,
       quantile_cont(v, 0.95e0) filter (where population is not null) as velocity_q95 from p""", "fx_points fx_src",
       "total_population:4 total_builtup:4 lon_min lon_max lat_min lat_max velocity_q05 velocity_median velocity_q95")
def closure_summary(spark, d):
    return exposure.closure_summary(_sampled_points(spark, d), "lon", "lat", "velocity_mm_yr", ("population", "builtup"))


@query("weighted_sum", """select region_id, coalesce(sum(population) filter (where strong), 0e0) as strong_population,
       coalesce(sum(builtup_m2) filter (where strong and not majority), 0e0) as hidden_builtup from fx_flags group by region_id""",
       "fx_flags", "strong_population:2 hidden_builtup:2")
def weighted_sum(spark, d):
    s = F.col("strong")
    return V.flags(spark, d).groupBy("region_id").agg(
        wsum("population", s).alias("strong_population"), wsum("builtup_m2", s & ~F.col("majority")).alias("hidden_builtup")
    )


@query("weighted_mean", """select landcover_code, sum(vlm_mm_yr * population) filter (where population > 0) /
       nullif(sum(population) filter (where population > 0), 0e0) as mean_velocity,
       sum(obs_fraction * builtup_m2) filter (where builtup_m2 > 0) / nullif(sum(builtup_m2) filter (where builtup_m2 > 0), 0e0) as mean_observability
       from fx_flags group by landcover_code""", "fx_flags", "mean_velocity mean_observability", "landcover_code")
def weighted_mean(spark, d):
    return V.flags(spark, d, region=False).groupBy("landcover_code").agg(
        wmean("vlm_mm_yr", "population").alias("mean_velocity"), wmean("obs_fraction", "builtup_m2").alias("mean_observability")
    )


@query("weighted_or", """select region_id, exp(sum(log_or / var) / sum(1e0 / var)) as inverse_variance,
       exp(sum(log_or * n_cells) / sum(n_cells)) as by_cells, exp(sum(log_or * strong_cells) filter (where strong_cells > 0) /
       sum(strong_cells) filter (where strong_cells > 0)) as by_strong_cells,
       exp(sum(log_or * strong_pop) filter (where strong_pop > 0) / sum(strong_pop) filter (where strong_pop > 0)) as by_strong_population
       from fx_studies group by region_id""", "fx_studies", "inverse_variance by_cells by_strong_cells by_strong_population")
def weighted_or(spark, d):
    s = V.studies(spark, d).withColumn("odds", F.exp("log_or")).withColumn("precision", 1.0 / F.col("var"))
    return exposure.weighted_odds_ratio(s, "odds", {
        "inverse_variance": "precision", "by_cells": "n_cells", "by_strong_cells": "strong_cells", "by_strong_population": "strong_pop",
    }, ["region_id"])


@query("quantiles_linear", """select landcover_code, avg(builtup_m2) as mean, quantile_cont(builtup_m2, 0.025e0) as q025,
       quantile_cont(builtup_m2, 0.5e0) as q50, quantile_cont(builtup_m2, 0.975e0) as q975 from fx_cells
       where builtup_m2 is not null group by landcover_code""", "fx_cells", "mean:4 q025:4 q50:4 q975:4", "landcover_code")
def quantiles_linear(spark, d):
    """Mean and quantiles; the values are neither sorted nor stored."""
    g = V.flags(spark, d, region=False).filter("builtup_m2 is not null").select("landcover_code", "builtup_m2")
    mean = g.groupBy("landcover_code").agg(F.avg("builtup_m2").alias("mean"))
    return mean.join(ordering.exact_quantiles(g, "builtup_m2", resample.INTERVAL, ["landcover_code"]), "landcover_code")


def _stats_sql(q: str) -> str:
    return f"""count(*) as finite_count, min(x) as min, {q}, avg(x) as mean, max(x) as max,
       avg(case when x < -5e0 then 1e0 else 0e0 end) as fraction_lt_minus_5,
       avg(case when x < -10e0 then 1e0 else 0e0 end) as fraction_lt_minus_10"""


_PROBS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
_STAT_RND = "min p05 p25 median mean p75 p95 max fraction_lt_minus_5 fraction_lt_minus_10"


@query("distribution_stats", "with v as (select region_id, vlm_mm_yr as x from fx_cells where vlm_mm_yr is not null) select region_id, "
       + _stats_sql(", ".join(f"quantile_cont(x, {p}e0) as {n}" for n, p in _PROBS.items())) + " from v group by region_id",
       "fx_cells", _STAT_RND)
def distribution_stats(spark, d):
    return exposure.distribution_stats(V.placed(spark, d, V.grid(spark, d)), "vlm_mm_yr", ["region_id"])


@query("quantiles_nearest_rank", "with v as (select velocity_mm_yr as x, row_number() over (order by velocity_mm_yr) - 1 as i, count(*) over () as n "
       "from fx_points where velocity_mm_yr is not null) select "
       + _stats_sql(", ".join(f"max(x) filter (where i = round_even({p}e0 * (n - 1), 0)) as {n}" for n, p in _PROBS.items()))
       + " from v", "fx_points", _STAT_RND)
def quantiles_nearest_rank(spark, d):
    return exposure.distribution_stats(V.points(spark, d), "velocity_mm_yr", nearest=True)


_NET_SQL = """with seg as (select s.*, c.category, cast(floor((15e0 - (lat + lat2) / 2e0) / 0.01e0) as bigint) as cell_row,
         cast(floor(((lon + lon2) / 2e0 - 100e0) / 0.01e0) as bigint) as cell_col
       from fx_segments s join fx_category c on c.way_id = s.way_id where c.category is not null),
     used as (select seg.category, seg.seg_km, f.cell_id, f.strong from seg join fx_flags f on f.cell_row = seg.cell_row and f.cell_col = seg.cell_col
       where seg.cell_col between 0 and 127 and f.base),
     both_cats as (select * from used union all select 'transport_total', seg_km, cell_id, strong from used),
     pairs as (select distinct pair_id from fx_obs),
     long as (select p.pair_id, b.*, coalesce(o.coherence >= 0.3e0 - 1e-9, false) as seen from both_cats b cross join pairs p
       left join fx_obs o on o.cell_id = b.cell_id and o.pair_id = p.pair_id),
     net as (select pair_id, category, sum(seg_km) as transport_km_valid,
       coalesce(sum(seg_km) filter (where strong), 0e0) as transport_km_strong_subsidence,
       coalesce(sum(seg_km) filter (where strong and not seen), 0e0) as transport_km_hidden_strong_subsidence,
       coalesce(coalesce(sum(seg_km) filter (where strong and not seen), 0e0) / nullif(sum(seg_km) filter (where strong), 0e0), 0e0)
         as hidden_strong_subsidence_transport_fraction from long group by pair_id, category) """
_NET_VIEWS = "fx_segments fx_category fx_flags fx_obs"


def way_segments(spark, d):
    """Segments of all ways that have a transport category."""
    from ..functions.text import transport_category

    tags = V.way_tags(spark, d).select("way_id", transport_category(F.col("tags")).alias("category"))
    mids = joins.segment_midpoints(joins.segments(V.ways(spark, d), "way_id", "seq"))
    return mids.join(tags.filter("category is not null"), "way_id")


def _network(spark, d):
    return exposure.network_exposure(way_segments(spark, d), V.TARGET, V.flags(spark, d, region=False), "cell_id", "cell_row",
                                     "cell_col", V.obs(spark, d), "pair_id", slack=V.SLACK)


@query("network_exposure", _NET_SQL + "select * from net", _NET_VIEWS,
       "transport_km_valid:4 transport_km_strong_subsidence:4 transport_km_hidden_strong_subsidence:4 hidden_strong_subsidence_transport_fraction", "pair_id")
def network_exposure(spark, d):
    return _network(spark, d)


@query("transport_spread", _NET_SQL + """select avg(x) as mean, quantile_cont(x, 0.5e0) as median, min(x) as min, max(x) as max
       from (select hidden_strong_subsidence_transport_fraction as x from net where category = 'transport_total')""", _NET_VIEWS, "mean median min max")
def transport_spread(spark, d):
    x = F.col("hidden_strong_subsidence_transport_fraction")
    # one row per pair of the stack: a small fixed number
    return _network(spark, d).filter("category = 'transport_total'").agg(
        F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.min(x).alias("min"), F.max(x).alias("max")
    )


@query("tag_counters", """with seg as (select s.way_id, c.category, c.highway, floor((15e0 - (lat + lat2) / 2e0) / 0.01e0) as r,
         floor(((lon + lon2) / 2e0 - 100e0) / 0.01e0) as c from fx_segments s join fx_category c on c.way_id = s.way_id where c.category is not null),
       used as (select count(*) as n from seg join fx_flags f on f.cell_row = seg.r and f.cell_col = seg.c where seg.c between 0 and 127 and f.base)
       select 'way_category' as counter, category as item, count(*) as n from fx_category where category is not null group by category
       union all select 'highway', highway, count(*) from fx_category where category is not null group by highway
       union all select 'segments', 'total', count(*) from seg union all select 'segments', 'used', n from used""", "fx_segments fx_category fx_flags")
def tag_counters(spark, d):
    from ..functions import geo
    from ..functions.text import transport_category

    tags = V.way_tags(spark, d).withColumn("category", transport_category(F.col("tags"))).filter("category is not null")
    by_cat = tags.groupBy(F.lit("way_category").alias("counter"), F.col("category").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    by_tag = tags.groupBy(F.lit("highway").alias("counter"), F.try_element_at("tags", F.lit("highway")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    segs = way_segments(spark, d).select(geo.row_index(V.TARGET, "mid_lat").alias("cell_row"), geo.col_index(V.TARGET, "mid_lon").alias("cell_col"))
    per_cell = segs.groupBy("cell_row", "cell_col").agg(F.count(F.lit(1)).alias("n"))
    valid = V.flags(spark, d, region=False).filter("base").select("cell_row", "cell_col", F.lit(True).alias("ok"))
    seg = per_cell.join(valid, ["cell_row", "cell_col"], "left").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("used")
    ).unpivot([], ["total", "used"], "item", "n").withColumn("counter", F.lit("segments"))
    return by_cat.unionByName(by_tag).unionByName(seg)


_ROLL = """count(*) as cells, avg(case when strong then 1e0 else 0e0 end) as strong_share, sum(failure_count) / cast(sum(n_pairs) as double) as failure_rate,
       sum(failure_count) filter (where strong) / cast(sum(n_pairs) filter (where strong) as double) as strong_failure_rate,
       sum(failure_count) filter (where not strong) / cast(sum(n_pairs) filter (where not strong) as double) as nonstrong_failure_rate"""


@query("landcover_rollup", f"""with r as (select cast(region_id as varchar) as region, landcover_group, {_ROLL} from fx_model group by region_id, landcover_group
       union all select 'ALL', landcover_group, {_ROLL} from fx_model group by landcover_group)
       select *, cells / cast(sum(cells) over (partition by region) as double) as cell_fraction_in_region from r""", "fx_model",
       "cell_fraction_in_region strong_share failure_rate strong_failure_rate nonstrong_failure_rate")
def landcover_rollup(spark, d):
    return exposure.landcover_rollup(V.model_cells(spark, d).withColumnRenamed("region_id", "region"))


@query("region_rollup", """with r as (select cast(region_id as varchar) as region, * from fx_model union all select 'ALL' as region, * from fx_model)
       select region, count(*) as n_cells, count(distinct concat(region_id, '|', floor(cell_row / 5e0), '|', floor(cell_col / 5e0))) as n_blocks,
         sum(failure_count) / cast(sum(n_pairs) as double) as failure_rate, avg(case when strong then 1e0 else 0e0 end) as strong_share,
         sum(failure_count) filter (where strong) / cast(sum(n_pairs) filter (where strong) as double) as strong_failure_rate,
         sum(failure_count) filter (where not strong) / cast(sum(n_pairs) filter (where not strong) as double) as nonstrong_failure_rate,
         avg(n_obs) as mean_observable_pairs, avg(n_pairs) as mean_pairs from r group by region""", "fx_model",
       "failure_rate strong_share strong_failure_rate nonstrong_failure_rate mean_observable_pairs mean_pairs")
def region_rollup(spark, d):
    cells = V.model_cells(spark, d).withColumnRenamed("region_id", "region")
    cells = cells.withColumn("block_row", F.floor(F.col("cell_row") / 5.0)).withColumn("block_col", F.floor(F.col("cell_col") / 5.0))
    return exposure.region_rollup(cells, "region", ["block_row", "block_col"])


@query("argmax_group", """with g as (select region_id, landcover_group, count(*) / cast(sum(count(*)) over (partition by region_id) as double) as frac,
         sum(failure_count) / cast(sum(n_pairs) as double) as fail from fx_model group by region_id, landcover_group),
       o as (select *, case landcover_group when 'other' then 0 when 'cropland' then 1 when 'built_up' then 2 when 'water_wetland_mangrove' then 3
         when 'vegetation_non_crop' then 4 else 5 end as pos from g)
       select region_id, max(frac) as dominant_fraction, arg_max(landcover_group, frac - pos * 1e-9) as dominant_landcover,
         max(fail) as max_failure_rate, arg_max(landcover_group, fail - pos * 1e-9) as max_failure_landcover from o group by region_id""",
       "fx_model", "dominant_fraction max_failure_rate")
def argmax_group(spark, d):
    roll = exposure.landcover_rollup(V.model_cells(spark, d).withColumn("region", F.col("region_id"))).filter("region <> 'ALL'")
    order = ["other", *labels.LANDCOVER_CODES]
    roll = roll.withColumn("pos", F.array_position(F.array(*[F.lit(o) for o in order]), F.col("landcover_group")))
    dom = exposure.argmax_by(roll, ["region"], "landcover_group", "cell_fraction_in_region", "pos")
    worst = exposure.argmax_by(roll, ["region"], "landcover_group", "failure_rate", "pos")
    return dom.select("region", F.col("landcover_group").alias("dominant_landcover"), F.col("cell_fraction_in_region").alias("dominant_fraction")).join(
        worst.select("region", F.col("landcover_group").alias("max_failure_landcover"), F.col("failure_rate").alias("max_failure_rate")), "region"
    ).select(F.col("region").cast("int").alias("region_id"), "dominant_landcover", "dominant_fraction", "max_failure_landcover", "max_failure_rate")


_BLOCK = """count(*) filter (where strong) as strong_cells, count(*) filter (where strong and not majority) as strong_not_majority,
       count(*) filter (where strong and majority) as strong_majority, count(*) filter (where nonstrong) as nonstrong_cells,
       count(*) filter (where nonstrong and not majority) as nonstrong_not_majority, count(*) filter (where nonstrong and majority) as nonstrong_majority,
       coalesce(sum(population) filter (where strong), 0e0) as strong_pop, coalesce(sum(population) filter (where strong and not majority), 0e0) as strong_pop_not_majority,
       coalesce(sum(builtup_m2) filter (where strong), 0e0) as strong_built, coalesce(sum(builtup_m2) filter (where strong and not majority), 0e0) as strong_built_not_majority"""


@query("block_stats", f"""select cast(floor(cell_row / 10e0) as bigint) as block_row, cast(floor(cell_col / 10e0) as bigint) as block_col, {_BLOCK}
       from fx_flags where base group by 1, 2""", "fx_flags", "strong_pop:2 strong_pop_not_majority:2 strong_built:2 strong_built_not_majority:2")
def block_stats(spark, d):
    return resample.block_stats(V.flags(spark, d, region=False), "cell_row", "cell_col", 10)


@query("combine_blocks", f"""with b as (select region_id, {_BLOCK} from fx_flags where base group by region_id)
       select region_id, coalesce(strong_not_majority / nullif(cast(strong_cells as double), 0), 0e0) as strong_not_majority_fraction,
         coalesce(strong_pop_not_majority / nullif(strong_pop, 0), 0e0) as strong_population_not_majority_fraction,
         coalesce(strong_built_not_majority / nullif(strong_built, 0), 0e0) as strong_builtup_not_majority_fraction,
         (strong_not_majority + 0.5e0) * (nonstrong_majority + 0.5e0) / ((strong_majority + 0.5e0) * (nonstrong_not_majority + 0.5e0))
           as strong_vs_nonstrong_not_majority_odds_ratio from b""", "fx_flags", " ".join(resample.METRICS))
def combine_blocks(spark, d):
    stats = resample.block_stats(V.flags(spark, d), "cell_row", "cell_col", 10, ["region_id"])
    return resample.metrics(resample.resum(stats, ["region_id"]), ["region_id"])


@query("share_gt_one", """select region_id, avg(case when exp(log_or) > 1e0 then 1e0 else 0e0 end) as share_gt_one, min(exp(log_or)) as min_value,
       avg(exp(log_or)) as mean_value, max(exp(log_or)) as max_value, max(abs(log_or)) as max_abs_log from fx_studies group by region_id""",
       "fx_studies", "share_gt_one min_value mean_value max_value max_abs_log")
def share_gt_one(spark, d):
    return meta.share_above_one(V.studies(spark, d).withColumn("odds", F.exp("log_or")), "odds", ["region_id"])


@query("subnational_spread", """with s as (select n.n_regionkey as region_id, s_suppkey, s_acctbal, row_number() over (partition by n.n_regionkey order by s_suppkey) as i
         from supplier join nation n on s_nationkey = n.n_nationkey)
       select region_id, max(s_acctbal) filter (where i = 1) as national_value, count(*) filter (where i > 1) as subnational_count,
         coalesce(min(s_acctbal) filter (where i > 1), max(s_acctbal)) as subnational_min,
         coalesce(quantile_cont(s_acctbal, 0.5e0) filter (where i > 1), max(s_acctbal)) as subnational_median,
         coalesce(max(s_acctbal) filter (where i > 1), max(s_acctbal)) as subnational_max from s group by region_id""",
       rnd="national_value subnational_min subnational_median subnational_max")
def subnational_spread(spark, d):
    """First row of a region is its national value; the rest spread around it."""
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region_id"))
    s = V.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").join(n, "s_nationkey")
    first = ordering.first_by(s, ["region_id"], [F.col("s_suppkey")], ["s_suppkey", "s_acctbal"]).withColumnsRenamed(
        {"s_suppkey": "_first", "s_acctbal": "national_value"})
    rest = attach_to_rows(s, first, ["region_id"]).filter(F.col("s_suppkey") != F.col("_first"))
    agg = rest.groupBy("region_id").agg(F.count(F.lit(1)).alias("subnational_count"), F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    med = ordering.exact_quantiles(rest, "s_acctbal", {"mid": 0.5}, ["region_id"])
    out = first.join(agg, "region_id", "left").join(med, "region_id", "left")
    nat = F.col("national_value")
    return out.select("region_id", "national_value", F.coalesce("subnational_count", F.lit(0)).alias("subnational_count"),
                      F.coalesce("lo", nat).alias("subnational_min"), F.coalesce("mid", nat).alias("subnational_median"),
                      F.coalesce("hi", nat).alias("subnational_max"))


@query("hidden_amounts", """with t as (select region_id, coalesce(sum(population) filter (where strong), 0e0) as strong_amount,
         coalesce(sum(population) filter (where strong and not majority), 0e0) / nullif(sum(population) filter (where strong), 0e0) as hidden_fraction,
         count(*) filter (where strong and not majority) / nullif(cast(count(*) filter (where strong) as double), 0) as not_majority
       from fx_flags group by region_id)
       select *, strong_amount * hidden_fraction as hidden_amount, 1e0 - not_majority as observable_fraction from t""", "fx_flags",
       "strong_amount:2 hidden_fraction not_majority hidden_amount:2 observable_fraction")
def hidden_amounts(spark, d):
    s, m = F.col("strong"), F.col("majority")
    t = V.flags(spark, d).groupBy("region_id").agg(
        wsum("population", s).alias("strong_amount"), F.try_divide(wsum("population", s & ~m), wsum("population", s)).alias("hidden_fraction"),
        F.try_divide(F.count_if(s & ~m).cast("double"), F.count_if(s)).alias("not_majority"),
    )
    return exposure.hidden_amounts(t, "strong_amount", "hidden_fraction", "not_majority")


@query("support_score", """select region_id, avg(case when exp(log_or) > 1e0 then 1e0 else 0e0 end) as support_score, count(*) as n_rows,
       sum(strong_cells) as total_hits from fx_studies group by region_id""", "fx_studies", "support_score", "total_hits")
def support_score(spark, d):
    return V.studies(spark, d).groupBy("region_id").agg(
        F.avg((F.exp("log_or") > 1).cast("double")).alias("support_score"), F.count(F.lit(1)).alias("n_rows"), F.sum("strong_cells").alias("total_hits")
    )


@query("infer_trials", """select round_even(quantile_cont(round(n_obs / obs_fraction, 6), 0.5e0), 0) as n_pairs from fx_flags where obs_fraction > 0e0""",
       "fx_flags", "n_pairs")
def infer_trials(spark, d):
    return binomial.infer_trials(V.flags(spark, d, region=False), "n_obs", "obs_fraction")


@query("pivot_grid", """select landcover_group, avg(n_obs) filter (where region_id = 0) as r0, avg(n_obs) filter (where region_id = 1) as r1,
       avg(n_obs) filter (where region_id = 2) as r2, avg(n_obs) filter (where region_id = 3) as r3, avg(n_obs) filter (where region_id = 4) as r4
       from fx_model group by landcover_group""", "fx_model", "r0 r1 r2 r3 r4")
def pivot_grid(spark, d):
    p = V.model_cells(spark, d).groupBy("landcover_group").pivot("region_id", [0, 1, 2, 3, 4]).agg(F.avg("n_obs"))
    return p.withColumnsRenamed({str(i): f"r{i}" for i in range(5)})


@query("distinct_values", """select region_id, count(distinct nation_id) as n_nations, count(distinct landcover_code) as n_landcovers,
       count(distinct concat(floor(cell_row / 5e0), '|', floor(cell_col / 5e0))) as n_blocks from fx_cells group by region_id""", "fx_cells")
def distinct_values(spark, d):
    """Distinct counts by reducing to the distinct keys first, without Spark's row expansion."""
    g = V.placed(spark, d, V.grid(spark, d)).select(
        "region_id", "nation_id", "landcover_code", F.floor(F.col("cell_row") / 5.0).alias("br"), F.floor(F.col("cell_col") / 5.0).alias("bc"))
    n = g.groupBy("region_id").agg(F.collect_set("nation_id").alias("n"), F.collect_set("landcover_code").alias("l"))  # bounded code sets
    blocks = g.select("region_id", "br", "bc").distinct().groupBy("region_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    return n.join(blocks, "region_id").select(
        "region_id", F.size("n").cast("bigint").alias("n_nations"), F.size("l").cast("bigint").alias("n_landcovers"), "n_blocks")


_WINDOWS = """w as (select n_nationkey as zone_id, (n_nationkey % 5) * 20 as c0, (n_nationkey % 5) * 20 + 40 as c1,
       (n_nationkey // 5) * 15 as r0, (n_nationkey // 5) * 15 + 30 as r1 from nation)"""
_ZONAL = """count(*) filter (where x is not null) as finite_pixels, coalesce(count(x) / nullif(cast({n} as double), 0), 0e0) as coverage_fraction,
       min(x) as min_value, max(x) as max_value, avg(x) as mean_value, avg(case when x > 0 then 1e0 when x is not null then 0e0 end) as positive_fraction,
       quantile_cont(x, 0.5e0) as median_value"""
_ZONAL_RND = "coverage_fraction min_value max_value mean_value positive_fraction median_value"


def zone_windows(spark, d):
    n = F.col("n_nationkey")
    five = F.floor(n / 5)
    return V.table(spark, d, "nation").select(
        n.alias("zone_id"), ((n % 5) * 20).cast("bigint").alias("c0"), ((n % 5) * 20 + 40).cast("bigint").alias("c1"),
        (five * 15).alias("r0"), (five * 15 + 30).alias("r1"))


@query("zonal_window_stats", f"""with {_WINDOWS}, m as (select w.zone_id, (r1 - r0) * (c1 - c0) as px, builtup_m2 as x from fx_cells c
         join w on c.cell_row >= w.r0 and c.cell_row < w.r1 and c.cell_col >= w.c0 and c.cell_col < w.c1)
       select zone_id, max(px) as window_pixels, {_ZONAL.format(n='max(px)')} from m group by zone_id""", "fx_cells", _ZONAL_RND, "window_pixels")
def zonal_window_stats(spark, d):
    cells = V.flags(spark, d, region=False).select("cell_row", "cell_col", "builtup_m2")
    members = joins.cells_in_windows(cells, "cell_row", "cell_col", zone_windows(spark, d), tile=16)
    return exposure.zonal_stats(members, ["zone_id"], "builtup_m2", (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0")))


@query("fold_vs_global", """with g as (select avg(population) as gp, avg(builtup_m2) as gb, avg(cover_fraction) as gc from fx_cells),
       z as (select nation_id, avg(population) as p, avg(builtup_m2) as b, avg(cover_fraction) as c from fx_cells group by nation_id),
       f as (select nation_id, unnest([p / gp, b / gb, c / gc]) as f from z, g)
       select nation_id, count(f) as n_layers, avg(f) as mean_fold, quantile_cont(f, 0.5e0) as median_fold from f group by nation_id""", "fx_cells", "mean_fold median_fold")
def fold_vs_global(spark, d):
    return exposure.fold_vs_global(V.flags(spark, d), ["nation_id"], ["population", "builtup_m2", "cover_fraction"])
