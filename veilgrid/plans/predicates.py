"""Projections, filters and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions import numeric as N
from ..operators import exposure, observe
from ..runtime import attach_to_rows
from ..sources import readers
from . import views as V
from .registry import query


@query("resolve_columns", "select lon as longitude, lat as latitude, velocity_mm_yr as velocity_mm_per_year, weight as temporal_coherence from fx_points",
       "fx_points", "longitude latitude velocity_mm_per_year temporal_coherence")
def resolve_columns(spark, d):
    """Odd names are found by alias, exact first and then as part of a name."""
    odd = V.points(spark, d).select(
        "point_id", F.col("lon").alias("Lon Deg"), F.col("lat").alias("LAT"), F.col("velocity_mm_yr").alias("Mean Velocity (mm/yr)"),
        F.col("weight").alias("temp_coh"))
    return readers.resolve_points(odd)


@query("coerce_numeric", """with t as (select event_id, case event_id % 4 when 0 then cast(value as varchar) when 1 then '' when 2 then 'nan' else concat('x', event_type) end as raw from events)
       select event_id, raw, case when isnan(try_cast(raw as double)) then null else try_cast(raw as double) end as number from t""", rnd="number")
def coerce_numeric(spark, d):
    i = F.col("event_id") % 4
    raw = F.when(i == 0, F.col("value").cast("string")).when(i == 1, "").when(i == 2, "nan").otherwise(F.concat(F.lit("x"), "event_type"))
    return V.table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("number", N.coerce_double("raw"))


def _dirty(spark, d):
    """Point values where some are NaN, infinite, nodata or out of range."""
    i = F.col("point_id") % 11
    x = (F.when(i == 0, float("nan")).when(i == 1, float("inf")).when(i == 2, -9999.0).when(i == 3, 1e30).when(i == 4, None)
         .otherwise(F.col("velocity_mm_yr")))
    return V.points(spark, d).select("point_id", "lon", "lat", "weight", x.cast("double").alias("x"))


_DIRTY = """dirty as (select point_id, lon, lat, weight, case point_id % 11 when 0 then cast('nan' as double) when 1 then cast('infinity' as double)
       when 2 then -9999e0 when 3 then 1e30 when 4 then null else velocity_mm_yr end as x from fx_points)"""
_FINITE = "x is not null and not isnan(x) and not isinf(x)"


@query("finite_filter", f"with {_DIRTY} select point_id, x from dirty where {_FINITE}", "fx_points", "x:4")
def finite_filter(spark, d):
    p = _dirty(spark, d).filter(N.finite("lon") & N.finite("lat"))
    return p.filter(N.finite("x") & N.finite("weight")).select("point_id", "x")


@query("valid_mask", f"with {_DIRTY} select point_id, coalesce({_FINITE} and x <> -9999e0, false) as valid from dirty", "fx_points")
def valid_mask(spark, d):
    return _dirty(spark, d).select("point_id", F.coalesce(N.valid_value("x", -9999.0), F.lit(False)).alias("valid"))


@query("exposure_valid", f"with {_DIRTY} select point_id, coalesce({_FINITE} and x >= 0 and x <> -9999e0, false) as valid, "
       f"coalesce({_FINITE} and x >= 0 and x <> -9999e0 and weight > 20e0, false) as covered from dirty", "fx_points")
def exposure_valid(spark, d):
    p = _dirty(spark, d).withColumn("cover", F.greatest(F.lit(0.0), F.col("weight") - 20.0))
    no = lambda c: F.coalesce(c, F.lit(False))
    return p.select("point_id", no(N.valid_exposure("x", -9999.0)).alias("valid"), no(N.valid_exposure("x", -9999.0, "cover")).alias("covered"))


@query("sentinel_filter", f"with {_DIRTY} select point_id, x from dirty where {_FINITE} and x > -1e20 and x < 1e20 and x <> -9999e0", "fx_points", "x:4")
def sentinel_filter(spark, d):
    return _dirty(spark, d).filter(N.within_sentinel("x", -9999.0)).select("point_id", "x")


@query("unit_scale", "select cell_id, vlm_mm_yr / 10e0 * 10e0 as vlm_mm, builtup_m2 / 1e6 as builtup_km2 from fx_cells", "fx_cells", "vlm_mm builtup_km2:8")
def unit_scale(spark, d):
    return V.flags(spark, d, region=False).select(
        "cell_id", (F.col("vlm_mm_yr") / 10.0 * 10.0).alias("vlm_mm"), (F.col("builtup_m2") / exposure.M2_PER_KM2).alias("builtup_km2"))


@query("strong_screen", "select cell_id, base, strong, nonstrong from fx_flags", "fx_flags")
def strong_screen(spark, d):
    return V.flags(spark, d, region=False).select("cell_id", "base", "strong", "nonstrong")


@query("control_band", "select point_id, velocity_mm_yr from fx_points where velocity_mm_yr > -0.5e0 and velocity_mm_yr < 0.5e0", "fx_points", "velocity_mm_yr")
def control_band(spark, d):
    v = F.col("velocity_mm_yr")
    return V.points(spark, d).filter((v > -0.5) & (v < 0.5)).select("point_id", "velocity_mm_yr")


@query("observability_flags", "select cell_id, n_obs, n_seen, obs_fraction, any_obs, majority, stable75, low25 from fx_flags", "fx_flags", "obs_fraction")
def observability_flags(spark, d):
    return V.flags(spark, d, region=False).select("cell_id", "n_obs", "n_seen", "obs_fraction", "any_obs", "majority", "stable75", "low25")


@query("cell_classes", """select case when strong and majority then 'visible_exposure' when strong then 'hidden_exposure_retained'
       when majority then 'observable_background' else 'low_support_background' end as class, count(*) as n_cells, sum(population) as population
       from fx_flags where base group by 1""", "fx_flags", "population:2")
def cell_classes(spark, d):
    f = V.flags(spark, d, region=False).filter("base")
    return f.groupBy(labels.exposure_account("strong", "majority").alias("class")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("population").alias("population"))


@query("cell_table", """select cell_row as row, cell_col as col, 100e0 + (cell_col + 0.5e0) * 0.01e0 as lon_center, 15e0 - (cell_row + 0.5e0) * 0.01e0 as lat_center,
       vlm_mm_yr, n_obs as observable_count, obs_fraction as observable_fraction, cast(any_obs as int) as any_observable, cast(majority as int) as majority_observable,
       cast(not majority as int) as not_majority_observable, cast(strong as int) as strong_sub_5mm, population as population_weighted,
       cover_fraction as population_cover_fraction, builtup_m2 as builtup_m2_weighted, cover_fraction as builtup_cover_fraction from fx_flags where base""",
       "fx_flags", "lon_center lat_center vlm_mm_yr observable_fraction population_weighted population_cover_fraction builtup_m2_weighted:2 builtup_cover_fraction")
def cell_table(spark, d):
    f = V.flags(spark, d, region=False)
    return observe.cell_table(f, V.TARGET, "cell_row", "cell_col", "vlm_mm_yr", "population", "builtup_m2", "cover_fraction", "cover_fraction")


@query("code_map", """select nation_id, case when s = 'inconclusive' then 0e0 when s = 'positive' then 1e0 when s = 'strong_positive' then 2e0 end as signal_code
       from (select nation_id, case when log_or > 0.2e0 then 'strong_positive' when log_or > 0e0 then 'positive' when log_or > -0.1e0 then 'inconclusive'
         else 'negative' end as s from fx_studies)""", "fx_studies", "signal_code")
def code_map(spark, d):
    x = F.col("log_or")
    s = F.when(x > 0.2, "strong_positive").when(x > 0, "positive").when(x > -0.1, "inconclusive").otherwise("negative")
    return V.studies(spark, d).select("nation_id", labels.code_map(s, labels.SIGNAL_CODES).alias("signal_code"))


@query("category_codes", """select p_partkey, p_brand, dense_rank() over (order by p_brand) - 1 as code from part""")
def category_codes(spark, d):
    """Codes by sorted category: only the distinct categories are ordered."""
    from ..operators.ordering import global_rank

    part = V.table(spark, d, "part").select("p_partkey", "p_brand")
    codes = global_rank(part.select("p_brand").distinct(), ["p_brand"], out="code")
    return attach_to_rows(part, codes.withColumn("code", F.col("code") - 1), ["p_brand"])


@query("landcover_group", "select cell_id, coalesce(landcover_group, 'other') as landcover_group from fx_grid g left join fx_land l on l.landcover_code = g.landcover_code", "fx_grid fx_land")
def landcover_group(spark, d):
    return V.grid(spark, d).select("cell_id", labels.landcover_group("landcover_code").alias("landcover_group"))


_SIGNAL = """s as (select nation_id, exp(log_or) as odds, case when nation_id % 7 = 0 then null else exp(log_or - 1.96e0 * sqrt(var)) end as lo, exp(log_or + 1.96e0 * sqrt(var)) as hi from fx_studies),
       sig as (select *, case when odds is null or lo is null or hi is null then 'missing' when lo > 1e0 and odds >= 3e0 then 'strong_positive' when lo > 1e0 then 'positive'
         when hi < 1e0 then 'negative' else 'inconclusive' end as signal from s)"""


def signals(spark, d):
    se = F.sqrt("var")
    s = V.studies(spark, d).select(
        "nation_id", F.exp("log_or").alias("odds"), F.when(F.col("nation_id") % 7 != 0, F.exp(F.col("log_or") - 1.96 * se)).alias("lo"),
        F.exp(F.col("log_or") + 1.96 * se).alias("hi"))
    return s.withColumn("signal", labels.signal_class("odds", "lo", "hi"))


@query("classify_signal", f"with {_SIGNAL} select nation_id, odds, lo, hi, signal from sig", "fx_studies", "odds lo hi")
def classify_signal(spark, d):
    return signals(spark, d)


_STATIONS = """st as (select s_nationkey as nation_id, count(*) as n, quantile_cont(s_acctbal, 0.5e0) / 1000e0 as median from supplier group by s_nationkey)"""


def stations(spark, d):
    """Anchor stations of each nation, with their median."""
    from ..operators.ordering import exact_quantiles

    s = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation_id"), (F.col("s_acctbal") / 1000.0).alias("up"))
    n = s.groupBy("nation_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(exact_quantiles(s, "up", {"median": 0.5}, ["nation_id"]), "nation_id", "left")


@query("classify_readiness", f"""with {_SIGNAL}, {_STATIONS}
       select sig.nation_id, signal, coalesce(st.n, 0) as n_anchor, case when signal in ('positive', 'strong_positive') and st.n >= 5 and sig.nation_id % 2 = 0 then 'conditional_nature_go_after_egms'
         when signal in ('positive', 'strong_positive') and st.n >= 5 then 'benchmark_v0_landed_needs_dense_truth'
         when signal in ('positive', 'strong_positive') then 'statistical_signal_needs_independent_anchor'
         when signal = 'inconclusive' then 'control_or_specification_case' else 'do_not_lead' end as readiness
       from sig left join st on st.nation_id = sig.nation_id""", "fx_studies")
def classify_readiness(spark, d):
    s = signals(spark, d).join(stations(spark, d), "nation_id", "left").withColumn("n_anchor", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("nation_id") % 2 == 0, labels.PENDING_STATUS).otherwise("not_applicable")
    return s.select("nation_id", "signal", "n_anchor", labels.readiness_class("signal", "n_anchor", status).alias("readiness"))


_CANDIDATE = """c as (select nation_id, case nation_id % 5 when 0 then 'Mexico_City' when 1 then 'Japan_Niigata' when 2 then 'Central_Valley_large' when 3 then 'Japan_Kanto'
         else concat('Zone_', nation_id) end as candidate, n, median - 5e0 as median from st)"""


@query("priority_tier", f"""with {_STATIONS}, {_CANDIDATE}
       select nation_id, candidate, case when n >= 20 then 'A' when n >= 5 then 'B' else 'C' end as priority,
         case when candidate = 'Mexico_City' then 'extreme_subsidence_anchor_case' when candidate like 'Japan%' then 'japan_licsbas_extension_case'
           when candidate = 'Central_Valley_large' then 'dense_us_control_and_methods_validation' when n >= 20 and median < -1e0 then 'strong_gnss_subsidence_candidate'
           when n >= 20 then 'dense_gnss_deformation_candidate' else 'secondary_candidate' end as role,
         case when candidate like 'Japan%' then 'selective Zenodo LiCSBAS city zip download plus GEONET/GSI or NGL station overlay'
           when candidate = 'Mexico_City' then 'open InSAR deformation product plus GHSL/Google buildings exposure overlay'
           when candidate = 'Central_Valley_large' then 'area-weighted exposure overlay and source-data packaging'
           else 'independent dense deformation benchmark and exposure overlay' end as next_data_needed,
         case when candidate <> 'Japan_Niigata' then '' when nation_id % 3 = 0 then 'not_run' when nation_id % 2 = 0 then 'niigata_h5_velocity_ingested'
           else 'niigata_zip_downloaded' end as probe_status from c""")
def priority_tier(spark, d):
    i = F.col("nation_id")
    name = (F.when(i % 5 == 0, "Mexico_City").when(i % 5 == 1, "Japan_Niigata").when(i % 5 == 2, "Central_Valley_large")
            .when(i % 5 == 3, "Japan_Kanto").otherwise(F.concat(F.lit("Zone_"), i.cast("string"))))
    c = stations(spark, d).withColumn("candidate", name).withColumn("median", F.col("median") - 5.0)
    c = c.withColumn("probes", i % 3).withColumn("filtered", i % 2 == 0)
    return c.select(
        "nation_id", "candidate", labels.priority_tier("n").alias("priority"), labels.candidate_role("candidate", "n", "median").alias("role"),
        labels.next_data_needed("candidate").alias("next_data_needed"), labels.probe_status("candidate", "probes", "filtered").alias("probe_status"))


@query("transfer_rules", f"""with {_SIGNAL}, f as (select nation_id, avg(case when vlm_mm_yr < -5e0 then 1e0 else 0e0 end) as frac, count(*) as n, quantile_cont(population, 0.5e0) as median
         from fx_cells group by nation_id)
       select sig.nation_id, case when signal in ('positive', 'strong_positive') and sig.nation_id % 2 = 0 then 'supported' when signal = 'inconclusive' then 'control' else 'partial' end as status,
         cast(signal in ('positive', 'strong_positive') and sig.nation_id % 2 = 0 as int) as directional_support, cast(sig.nation_id % 2 = 0 as int) as token_required,
         frac >= 0.15e0 and n > 10000 as subsidence_ok, n > 1000000 and median = 0e0 as coverage_ok from sig join f on f.nation_id = sig.nation_id""", "fx_studies fx_cells")
def transfer_rules(spark, d):
    from ..operators.ordering import exact_quantiles

    cells = V.flags(spark, d)
    f = cells.groupBy("nation_id").agg(F.avg((F.col("vlm_mm_yr") < -5).cast("double")).alias("frac"), F.count(F.lit(1)).alias("n"))
    f = f.join(exact_quantiles(cells, "population", {"median": 0.5}, ["nation_id"]), "nation_id", "left")
    status = F.when(F.col("nation_id") % 2 == 0, labels.PENDING_STATUS).otherwise("none")
    rules = labels.transfer_status("signal", status)
    return signals(spark, d).join(f, "nation_id").select(
        "nation_id", *[c.alias(n) for n, c in rules.items()], labels.subsidence_supported("frac", "n").alias("subsidence_ok"),
        labels.coverage_supported("n", "median").alias("coverage_ok"))


@query("group_label", f"""with {_SIGNAL}, m as (select *, case nation_id % 4 when 0 then 'summary_only_meta' when 1 then 'blocked_equal_area_v1' when 2 then 'hierarchical_anchor_stack' else 'x_stack' end as family from sig)
       select nation_id, case when signal in ('positive', 'strong_positive') then 'signal_positive' when signal = 'inconclusive' then 'control_spec' else 'other' end as grp,
         case when family = 'summary_only_meta' then 'summary_only' when family like 'blocked_equal_area%' then 'region_level' when family = 'hierarchical_anchor_stack' then 'cell_anchored'
           else 'stratified_control' end as category from m""", "fx_studies")
def group_label(spark, d):
    i = F.col("nation_id") % 4
    family = F.when(i == 0, "summary_only_meta").when(i == 1, "blocked_equal_area_v1").when(i == 2, "hierarchical_anchor_stack").otherwise("x_stack")
    return signals(spark, d).withColumn("family", family).select(
        "nation_id", labels.signal_group("signal").alias("grp"), labels.family_category("family").alias("category"))


@query("aoi_validate", """with b as (select point_id, lon as w, lat as s, lon + (weight - 10e0) / 10e0 as e, lat + weight / 20e0 as n from fx_points)
       select point_id, e - w as width, n - s as height, case when e - w <= 0 or n - s <= 0 then 'invalid_bbox' when e - w > 5e0 or n - s > 5e0 then 'exceeds_side_limit' end as reason
       from b where e - w <= 0 or n - s <= 0 or e - w > 5e0 or n - s > 5e0""", "fx_points", "width height")
def aoi_validate(spark, d):
    """The reject table: boxes that are empty or too wide."""
    b = V.points(spark, d).select(
        "point_id", F.col("lon").alias("w"), F.col("lat").alias("s"), (F.col("lon") + (F.col("weight") - 10.0) / 10.0).alias("e"),
        (F.col("lat") + F.col("weight") / 20.0).alias("n"))
    b = b.withColumn("reason", labels.bbox_reject_reason("w", "s", "e", "n")).filter("reason is not null")
    return b.select("point_id", (F.col("e") - F.col("w")).alias("width"), (F.col("n") - F.col("s")).alias("height"), "reason")


@query("safe_ratio", """select cell_id, coalesce(builtup_m2 / nullif(n_obs, 0), 0e0) as ratio_zero, builtup_m2 / nullif(n_obs, 0) as ratio_null from fx_flags""",
       "fx_flags", "ratio_zero:4 ratio_null:4")
def safe_ratio(spark, d):
    return V.flags(spark, d, region=False).select(
        "cell_id", N.ratio0("builtup_m2", "n_obs").alias("ratio_zero"), N.ratio_null("builtup_m2", "n_obs").alias("ratio_null"))


@query("clamp_normalize", "select cell_id, case when population is null then null else greatest(0e0, least(1e0, (population - 60e0) / 80e0)) end as score from fx_cells", "fx_cells", "score")
def clamp_normalize(spark, d):
    return V.flags(spark, d, region=False).select("cell_id", N.clamp01(F.col("population") - 60.0, 80.0).alias("score"))


@query("log1p_clip", "select point_id, ln(1e0 + greatest(velocity_mm_yr, 0e0)) as log_value from fx_points", "fx_points", "log_value")
def log1p_clip(spark, d):
    return V.points(spark, d).select("point_id", N.log1p_pos("velocity_mm_yr").alias("log_value"))
