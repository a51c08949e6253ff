"""Ranks, scores, sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, numeric
from ..operators import exposure, meta, ordering
from ..runtime import attach_to_rows
from . import views as V
from .registry import query


@query("zscore", """select cell_id, (vlm_mm_yr - avg(vlm_mm_yr) over w) / coalesce(nullif(stddev_pop(vlm_mm_yr) over w, 0e0), 1e0) as vlm_mm_yr_z,
       (ln(1e0 + population) - avg(ln(1e0 + population)) over w) / coalesce(nullif(stddev_pop(ln(1e0 + population)) over w, 0e0), 1e0) as log_pop_z
       from fx_cells window w as (partition by region_id)""", "fx_cells", "vlm_mm_yr_z log_pop_z")
def zscore(spark, d):
    """Scores inside each region, by aggregate and join instead of a window per region."""
    f = V.flags(spark, d).withColumn("log_pop", F.log1p("population"))
    return ordering.zscore(f, ["vlm_mm_yr", "log_pop"], ["region_id"]).select("cell_id", "vlm_mm_yr_z", "log_pop_z")


@query("zscore_train_test", """with t as (select avg(population) as mp, stddev_pop(population) as sp, avg(vlm_mm_yr) as mv, stddev_pop(vlm_mm_yr) as sv from fx_cells where region_id <> 2)
       select cell_id, coalesce((population - mp) / sp, 0e0) as population_z, coalesce((vlm_mm_yr - mv) / sv, 0e0) as vlm_mm_yr_z from fx_cells, t""", "fx_cells", "population_z vlm_mm_yr_z")
def zscore_train_test(spark, d):
    """Region 2 is held out: statistics come from the rest, missing values get their mean."""
    f = V.flags(spark, d)
    out = ordering.zscore(f, ["population", "vlm_mm_yr"], train=F.col("region_id") != 2)
    return out.select("cell_id", "population_z", "vlm_mm_yr_z")


@query("rank_first", """select cell_id, row_number() over (order by coalesce(population, 9999e0), cell_id) as model_rank from fx_cells""", "fx_cells")
def rank_first(spark, d):
    """Missing values rank last; ties keep their original order."""
    f = V.flags(spark, d, region=False).select("cell_id", F.coalesce("population", F.lit(9999.0)).alias("v"))
    return ordering.global_rank(f, ["v", "cell_id"], out="model_rank").drop("v")


_SCORE = """with s as (select nation_id, avg(case when exp(log_or) > 1e0 then 1e0 else 0e0 end) as g, exp(avg(log_or)) as pooled, greatest(0e0, least(1e0, (sum(c) / cast(sum(c + d) as double)) / 0.9e0)) as hidden,
       least(1e0, exp(min(log_or)) / exp(avg(log_or))) as transfer from fx_studies group by nation_id),
     k as (select *, g * least(1e0, pooled / 2e0) as effect_stability, 0.35e0 * g * least(1e0, pooled / 2e0) + 0.25e0 * hidden + 0.20e0 * transfer + 0.1e0 + 0.1e0 as composite_score from s)"""


def scoreboard(spark, d):
    s = V.studies(spark, d).groupBy("nation_id").agg(
        F.avg((F.exp("log_or") > 1).cast("double")).alias("g"), F.exp(F.avg("log_or")).alias("pooled"),
        numeric.clamp01(F.sum("c") / F.sum(F.col("c") + F.col("d")), 0.9).alias("hidden"),
        F.least(F.lit(1.0), F.exp(F.min("log_or")) / F.exp(F.avg("log_or"))).alias("transfer"))
    one = F.lit(1.0)
    return s.withColumns(labels.composite_score("g", "pooled", "hidden", "transfer", one, one))


@query("composite_score", _SCORE + " select nation_id, effect_stability, composite_score from k", "fx_studies", "effect_stability composite_score")
def composite_score(spark, d):
    return scoreboard(spark, d).select("nation_id", "effect_stability", "composite_score")


@query("rank_score", _SCORE + " select nation_id, composite_score, row_number() over (order by round(composite_score, 9) desc, nation_id) as rank from k", "fx_studies", "composite_score")
def rank_score(spark, d):
    s = scoreboard(spark, d).select("nation_id", "composite_score").withColumn("_s", F.round("composite_score", 9))
    return ordering.global_rank(s, [F.col("_s").desc(), F.col("nation_id")], out="rank").drop("_s")


@query("first_row", """select region_id, arg_min(cell_id, cell_id) as cell_id, arg_min(vlm_mm_yr, cell_id) as vlm_mm_yr from fx_cells where vlm_mm_yr <= -15e0 group by region_id""", "fx_cells", "vlm_mm_yr")
def first_row(spark, d):
    """First match per region in a stated order."""
    g = V.placed(spark, d, V.grid(spark, d)).filter("vlm_mm_yr <= -15")
    return ordering.first_by(g, ["region_id"], [F.col("cell_id")], ["cell_id", "vlm_mm_yr"])


@query("group_share", """select region_id, landcover_code, count(*) / cast(sum(count(*)) over (partition by region_id) as double) as share from fx_cells group by region_id, landcover_code""", "fx_cells", "share", "landcover_code")
def group_share(spark, d):
    from pyspark.sql import Window as W

    n = V.placed(spark, d, V.grid(spark, d)).groupBy("region_id", "landcover_code").agg(F.count(F.lit(1)).alias("n"))
    # a few rows per region are left at this point
    return n.select("region_id", "landcover_code", (F.col("n") / F.sum("n").over(W.partitionBy("region_id"))).alias("share"))


@query("loo_totals", """select cell_id, sum(population) over (partition by region_id) - coalesce(population, 0e0) as population_without, count(*) over (partition by region_id) - 1 as cells_without from fx_cells""", "fx_cells", "population_without:2")
def loo_totals(spark, d):
    f = V.flags(spark, d).select("cell_id", "region_id", "population")
    t = f.groupBy("region_id").agg(F.sum("population").alias("tp"), F.count(F.lit(1)).alias("tn"))
    return attach_to_rows(f, t, ["region_id"]).select(
        "cell_id", (F.col("tp") - F.coalesce("population", F.lit(0.0))).alias("population_without"), (F.col("tn") - 1).alias("cells_without"))


@query("sort_multi", """with o as (select s_suppkey, s_nationkey, s_acctbal, case s_nationkey % 5 when 3 then 0 when 1 then 1 when 4 then 2 else 9 end as pos from supplier)
       select s_suppkey, pos, row_number() over (order by pos, s_acctbal desc, s_suppkey) as place from o""", ints="pos")
def sort_multi(spark, d):
    """Listed groups in their own order, unknown groups last, then balance descending."""
    pos = F.array_position(F.array(*[F.lit(x) for x in (3, 1, 4)]), F.col("s_nationkey") % 5)
    o = V.table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.when(pos == 0, 9).otherwise(pos - 1).alias("pos"))
    return ordering.global_rank(o, [F.col("pos"), F.col("s_acctbal").desc(), F.col("s_suppkey")], out="place").drop("s_acctbal")


@query("topk_smallest_match", "select doc_id, source, n_chars from documents where contains(lower(text), 'the') and n_chars <= 2000 order by n_chars, doc_id limit 25")
def topk_smallest_match(spark, d):
    """Smallest documents whose whole text holds a word and whose size is under the limit."""
    docs = V.table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("the")) & (F.col("n_chars") <= 2000))
    return docs.select("doc_id", "source", "n_chars").orderBy("n_chars", "doc_id").limit(25)


@query("topk_largest", "select doc_id, source, n_chars from documents order by n_chars desc, doc_id limit 20")
def topk_largest(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(20)


_FAMILY = """with f as (select p_brand as family, avg(abs(p_retailprice - 1000e0 - 10e0 * p_size)) as mae0, avg(p_retailprice) as pooled_or from part group by p_brand),
     g as (select family, case when ends_with(family, '5') then null else mae0 end as loo_mae, pooled_or from f)"""


@query("best_family", _FAMILY + """ select family, loo_mae, pooled_or, row_number() over (order by loo_mae asc nulls last, pooled_or desc) as by_error,
       row_number() over (order by coalesce(loo_mae, 1e308), family) as ladder from g""", rnd="loo_mae:4 pooled_or:4")
def best_family(spark, d):
    """Families by error (missing last) then effect, and the plain ladder by name."""
    err = F.abs(F.col("p_retailprice") - 1000.0 - 10.0 * F.col("p_size"))
    f = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("family")).agg(F.avg(err).alias("m"), F.avg("p_retailprice").alias("pooled_or"))
    f = f.select("family", F.when(~F.col("family").endswith("5"), F.col("m")).alias("loo_mae"), "pooled_or")
    a = ordering.global_rank(f, [F.col("loo_mae").asc_nulls_last(), F.col("pooled_or").desc()], out="by_error")
    return ordering.global_rank(a, [F.col("loo_mae").asc_nulls_last(), F.col("family")], out="ladder")


_BUDGET = """with pool as (select cell_id, {x} as x, not majority as hidden from fx_flags where strong),
       a as (select cell_id, x, hidden, row_number() over (order by x desc nulls last, cell_id) as ra from pool),
       v as (select cell_id, row_number() over (order by x desc nulls last, cell_id) as rv from pool where not hidden),
       b as (select unnest([100, 250, 500, 1000, 2000]) as budget_cells),
       m as (select b.budget_cells, x, hidden, ra <= budget_cells as ina, coalesce(rv <= budget_cells, false) as inv from a left join v on v.cell_id = a.cell_id cross join b)
       select '{x}' as exposure_layer, budget_cells, count(*) filter (where ina and inv) as overlap_cells, count(*) filter (where ina and not inv) as aware_only_cells,
         count(*) filter (where inv and not ina) as visible_only_cells, coalesce(sum(x) filter (where ina), 0e0) as aware_top_total_exposure,
         coalesce(sum(x) filter (where inv), 0e0) as visible_top_total_exposure, coalesce(sum(x) filter (where ina and hidden), 0e0) as aware_top_hidden_exposure,
         coalesce(sum(x) filter (where inv and hidden), 0e0) as visible_top_hidden_exposure, coalesce(sum(x) filter (where ina and not inv and hidden), 0e0) as aware_only_hidden_exposure,
         coalesce(sum(x) filter (where inv and not ina and hidden), 0e0) as visible_only_hidden_exposure, count(*) filter (where ina and inv) / cast(budget_cells as double) as overlap_fraction,
         coalesce(sum(x) filter (where ina and hidden), 0e0) - coalesce(sum(x) filter (where inv and hidden), 0e0) as hidden_exposure_gain_aware_minus_visible
       from m group by budget_cells"""


@query("budget_ranking", f"select * from ({_BUDGET.format(x='population')}) union all select * from ({_BUDGET.format(x='builtup_m2')})", "fx_flags",
       "aware_top_total_exposure:2 visible_top_total_exposure:2 aware_top_hidden_exposure:2 visible_top_hidden_exposure:2 aware_only_hidden_exposure:2 "
       "visible_only_hidden_exposure:2 overlap_fraction hidden_exposure_gain_aware_minus_visible:2", "budget_cells")
def budget_ranking(spark, d):
    """Top-k lists with and without the cells the product hides."""
    f = V.flags(spark, d, region=False).withColumn("hidden", ~F.col("majority"))
    budgets = [100, 250, 500, 1000, 2000]
    out = [exposure.budget_ranking(f, "cell_id", x, budgets).withColumn("exposure_layer", F.lit(x)) for x in ("population", "builtup_m2")]
    return ordering.union_all(out)
