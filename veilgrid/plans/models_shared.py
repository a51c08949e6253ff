"""The region evidence table, shared by several queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import Z95
from ..operators import exposure
from . import views as V
from .predicates import _STATIONS, stations


def evidence(spark, d):
    """One row per nation from effect, land-cover and station tables, with the classifiers."""
    cells = V.model_cells(spark, d).withColumn("region", F.col("nation_id"))
    roll = exposure.landcover_rollup(cells).filter("region <> 'ALL'")
    order = F.array(*[F.lit(o) for o in ["other", *labels.LANDCOVER_CODES]])
    roll = roll.withColumn("pos", F.array_position(order, F.col("landcover_group")))
    share = lambda g: F.coalesce(F.max(F.when(F.col("landcover_group") == g, F.col("cell_fraction_in_region"))), F.lit(0.0))
    best = lambda score: F.max_by("landcover_group", F.struct(F.col(score), -F.col("pos")))
    land = roll.groupBy("region").agg(
        best("cell_fraction_in_region").alias("dominant_landcover"), F.max("cell_fraction_in_region").alias("dominant_landcover_fraction"),
        *[share(g).alias(f"{g}_fraction") for g in ("cropland", "built_up", "water_wetland_mangrove")],
        best("failure_rate").alias("max_failure_landcover"), F.max("failure_rate").alias("max_failure_rate"),
    ).withColumn("nation_id", F.col("region").cast("int")).drop("region")
    se = F.sqrt("var")
    s = V.studies(spark, d).select(
        "nation_id", "n_cells", F.exp("log_or").alias("adjusted_or"), F.exp(F.col("log_or") - Z95 * se).alias("boot_q025"), F.exp(F.col("log_or") + Z95 * se).alias("boot_q975"))
    names = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("region"))
    st = stations(spark, d).withColumnsRenamed({"n": "station_count", "median": "station_median_up"})
    out = names.join(s, "nation_id", "left").join(land, "nation_id", "left").join(st, "nation_id", "left").fillna(0, ["station_count"])
    out = out.withColumn("signal", labels.signal_class("adjusted_or", "boot_q025", "boot_q975"))
    status = F.when(F.col("nation_id") % 2 == 0, labels.PENDING_STATUS).otherwise("not_applicable")
    return out.withColumns({
        "n_pairs": F.lit(V.N_PAIRS), "bias_or_minus_one_proxy": F.col("adjusted_or") - 1.0, "truth_status": status,
        "anchor_status": F.when(F.col("station_count") >= 5, "sparse_gnss_anchor").otherwise("weak_or_missing_gnss_anchor"),
        "readiness": labels.readiness_class("signal", "station_count", status),
    })


EVIDENCE_VIEWS = "fx_studies fx_model"
EVIDENCE_SQL = f"""with {_STATIONS}, g as (select nation_id, landcover_group, count(*) / cast(sum(count(*)) over (partition by nation_id) as double) as frac,
         sum(failure_count) / cast(sum(n_pairs) as double) as fail from fx_model group by nation_id, landcover_group),
       o as (select *, case landcover_group when 'other' then 0 when 'cropland' then 1 when 'built_up' then 2 when 'water_wetland_mangrove' then 3 when 'vegetation_non_crop' then 4 else 5 end as pos from g),
       l as (select nation_id, arg_max(landcover_group, frac - pos * 1e-9) as dominant_landcover, max(frac) as dominant_landcover_fraction,
         coalesce(max(frac) filter (where landcover_group = 'cropland'), 0e0) as cropland_fraction, coalesce(max(frac) filter (where landcover_group = 'built_up'), 0e0) as built_up_fraction,
         coalesce(max(frac) filter (where landcover_group = 'water_wetland_mangrove'), 0e0) as water_wetland_mangrove_fraction,
         arg_max(landcover_group, fail - pos * 1e-9) as max_failure_landcover, max(fail) as max_failure_rate from o group by nation_id),
       s as (select nation_id, n_cells, exp(log_or) as adjusted_or, exp(log_or - 1.96e0 * sqrt(var)) as boot_q025, exp(log_or + 1.96e0 * sqrt(var)) as boot_q975 from fx_studies),
       j as (select n.n_nationkey as nation_id, n.n_name as region, s.n_cells, s.adjusted_or, s.boot_q025, s.boot_q975, l.dominant_landcover, l.dominant_landcover_fraction, l.cropland_fraction,
         l.built_up_fraction, l.water_wetland_mangrove_fraction, l.max_failure_landcover, l.max_failure_rate, coalesce(st.n, 0) as station_count, st.median as station_median_up,
         case when s.adjusted_or is null then 'missing' when s.boot_q025 > 1e0 and s.adjusted_or >= 3e0 then 'strong_positive' when s.boot_q025 > 1e0 then 'positive' when s.boot_q975 < 1e0 then 'negative'
           else 'inconclusive' end as signal from nation n left join s on s.nation_id = n.n_nationkey left join l on l.nation_id = n.n_nationkey left join st on st.nation_id = n.n_nationkey)
       select *, 7 as n_pairs, adjusted_or - 1e0 as bias_or_minus_one_proxy, case when nation_id % 2 = 0 then 'query_pack_ready_token_required' else 'not_applicable' end as truth_status,
         case when station_count >= 5 then 'sparse_gnss_anchor' else 'weak_or_missing_gnss_anchor' end as anchor_status,
         case when signal in ('positive', 'strong_positive') and station_count >= 5 and nation_id % 2 = 0 then 'conditional_nature_go_after_egms'
           when signal in ('positive', 'strong_positive') and station_count >= 5 then 'benchmark_v0_landed_needs_dense_truth'
           when signal in ('positive', 'strong_positive') then 'statistical_signal_needs_independent_anchor' when signal = 'inconclusive' then 'control_or_specification_case' else 'do_not_lead' end as readiness
       from j"""
