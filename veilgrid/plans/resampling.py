"""Bootstrap, sweeps, surfaces, shifted blocks, placebo shuffles and Monte Carlo scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import haldane_or
from ..operators import ordering, permute, resample
from ..runtime import with_scalars
from . import views as V
from .aggregates import _BLOCK
from .registry import query

SEED = 20260709
_Q = {"q025": "0.025e0", "q50": "0.5e0", "q975": "0.975e0"}
_BOOT = ", ".join(f"quantile_cont({m}, {p}) as {m}_{n}" for m in resample.METRICS for n, p in _Q.items()) + ", " + ", ".join(
    f"avg({m}) as {m}_boot_mean" for m in resample.METRICS)
_BOOT_RND = " ".join(f"{m} {m}_q025 {m}_q50 {m}_q975 {m}_boot_mean" for m in resample.METRICS)
_METRICS = """coalesce({s}strong_not_majority) / nullif(cast({s}strong_cells) as double), 0), 0e0) as strong_not_majority_fraction,
       coalesce({s}strong_pop_not_majority) / nullif({s}strong_pop), 0), 0e0) as strong_population_not_majority_fraction,
       coalesce({s}strong_built_not_majority) / nullif({s}strong_built), 0), 0e0) as strong_builtup_not_majority_fraction,
       ({s}strong_not_majority) + 0.5e0) * ({s}nonstrong_majority) + 0.5e0) / (({s}strong_majority) + 0.5e0) * ({s}nonstrong_not_majority) + 0.5e0))
         as strong_vs_nonstrong_not_majority_odds_ratio"""


def _bootstrap_sql(group: str, reps: int) -> str:
    """Over a CTE ``b`` of block statistics with block_row, block_col and the group columns."""
    keys = [g for g in group.split(", ") if g]
    part = f"partition by {group}" if keys else ""
    sel = f"{group}, " if keys else ""
    by = f"group by {group}" if keys else ""
    text = "".join(f", cast({g} as varchar)" for g in keys)
    using = f"using ({', '.join([*keys, 'idx'])})"
    final = f"obs join boot using ({group})" if keys else "obs, boot"
    return f"""i as (select *, row_number() over ({part} order by block_row, block_col) as idx, count(*) over ({part}) as n_blocks from b),
       dr as (select {sel} rep, cast('0x' || substr(md5(concat_ws('|', '{SEED}'{text}, cast(rep as varchar), cast(idx as varchar))), 1, 8) as bigint) % n_blocks + 1 as idx
         from i, (select unnest(range({reps})) as rep)),
       rp as (select {sel} rep, {_METRICS.format(s='sum(')} from dr join i {using} group by {sel} rep),
       boot as (select {sel} {_BOOT} from rp {by}),
       obs as (select {sel} count(*) as n_blocks, {_METRICS.format(s='sum(')} from b {by})
       select *, {reps} as n_bootstrap from {final}"""


@query("bootstrap_blocks", f"""with b as (select cast(floor(cell_row / 10e0) as bigint) as block_row, cast(floor(cell_col / 10e0) as bigint) as block_col, {_BLOCK}
       from fx_flags where base group by 1, 2), {_bootstrap_sql('', 400)}""", "fx_flags", _BOOT_RND, "n_bootstrap")
def bootstrap_blocks(spark, d):
    """400 replicates of 10x10 blocks."""
    stats = resample.block_stats(V.flags(spark, d, region=False), "cell_row", "cell_col", 10)
    return resample.bootstrap_table(stats, [], 400, SEED)


_SWEEP = """s as (select * from (values (0.2e0), (0.3e0), (0.4e0)) t(threshold), (values (3e0), (5e0), (10e0)) u(strong_threshold), (values (5), (10), (20)) v(block_size)),
       f as (select s.*, cast(floor(cell_row / cast(block_size as double)) as bigint) as block_row, cast(floor(cell_col / cast(block_size as double)) as bigint) as block_col, population, builtup_m2,
         vlm_mm_yr <= -strong_threshold as strong, not (vlm_mm_yr <= -strong_threshold) as nonstrong,
         (case when threshold = 0.2e0 then n_obs_20 when threshold = 0.3e0 then n_obs else n_obs_40 end) >= 4 as majority from fx_flags, s where base)"""


@query("robustness_sweep", f"""with {_SWEEP}, b as (select threshold, strong_threshold, block_size, block_row, block_col, {_BLOCK} from f group by all),
       {_bootstrap_sql('threshold, strong_threshold, block_size', 400).replace('select *, 400 as n_bootstrap', 'select *, 400 as n_bootstrap, 7 as n_pairs')}""",
       "fx_flags", _BOOT_RND, "block_size n_bootstrap n_pairs")
def robustness_sweep(spark, d):
    """27 specifications with 400 replicates each."""
    counts = {"n_obs": 0.3, "n_obs_20": 0.2, "n_obs_40": 0.4}
    cells = V.flags(spark, d, region=False, thresholds=counts)
    return resample.robustness_sweep(cells, {t: n for n, t in counts.items()}, [3.0, 5.0, 10.0], [5, 10, 20], V.N_PAIRS, 400, SEED, "cell_row", "cell_col")


_DEF, _FRAC, _MIN = [3.0, 4.0, 5.0, 6.0, 7.0, 10.0], [0.25, 0.33, 0.5, 0.67, 0.75], [1, 2, 4, 6]


@query("threshold_surface", f"""with s as (select * from (select unnest({_DEF}::double[]) as df), (select unnest({_FRAC}::double[]) as fr), (select unnest({_MIN}) as mc)),
       f as (select s.*, population, builtup_m2, vlm_mm_yr <= -df as st, vlm_mm_yr <= -df and (n_obs / 7e0 < fr or n_obs < mc) as hd from fx_flags, s where base)
       select (list_position({_DEF}::double[], df) - 1) * 20 + (list_position({_FRAC}::double[], fr) - 1) * 4 + list_position({_MIN}, mc) - 1 as run, df as deformation_abs_threshold_mm_yr,
         fr as observability_fraction_threshold, mc as min_observable_count, count(*) filter (where st) as strong_cells, count(*) filter (where hd) as hidden_strong_cells,
         coalesce(sum(population) filter (where st), 0e0) as strong_population, coalesce(sum(population) filter (where hd), 0e0) as hidden_population,
         coalesce(coalesce(sum(population) filter (where hd), 0e0) / nullif(sum(population) filter (where st), 0e0), 0e0) as hidden_population_fraction,
         coalesce(sum(builtup_m2) filter (where st), 0e0) / 1e6 as strong_builtup_km2, coalesce(sum(builtup_m2) filter (where hd), 0e0) / 1e6 as hidden_builtup_km2,
         coalesce(coalesce(sum(builtup_m2) filter (where hd), 0e0) / nullif(sum(builtup_m2) filter (where st), 0e0), 0e0) as hidden_builtup_fraction
       from f group by df, fr, mc""", "fx_flags",
       "strong_population:2 hidden_population:2 hidden_population_fraction strong_builtup_km2:8 hidden_builtup_km2:8 hidden_builtup_fraction", "run min_observable_count")
def threshold_surface(spark, d):
    """120 rules from one cube."""
    return resample.threshold_surface(V.flags(spark, d, region=False), _DEF, _FRAC, _MIN, V.N_PAIRS)


@query("maup_shifted_blocks", """with s as (select b as block_size, unnest([0, b // 2]) as origin_shift from (select unnest([3, 5, 10, 20]) as b)),
       k as (select block_size, origin_shift, floor((cell_row + origin_shift) / cast(block_size as double)) as br, floor((cell_col + origin_shift) / cast(block_size as double)) as bc,
         count(*) as cells, count(*) filter (where not majority) as hid, sum(population) as pop, coalesce(sum(population) filter (where not majority), 0e0) as pop_h,
         sum(builtup_m2) as built, coalesce(sum(builtup_m2) filter (where not majority), 0e0) as built_h from fx_flags, s where strong group by 1, 2, 3, 4)
       select block_size, origin_shift, count(*) as n_blocks, sum(cells) as strong_cells, sum(hid) as hidden_cells, coalesce(sum(pop_h) / nullif(sum(pop), 0e0), 0e0) as strong_hidden_population_fraction,
         coalesce(sum(built_h) / nullif(sum(built), 0e0), 0e0) as strong_hidden_builtup_fraction, avg(hid / cast(cells as double)) as mean_block_hidden_share from k group by 1, 2""",
       "fx_flags", "strong_hidden_population_fraction strong_hidden_builtup_fraction mean_block_hidden_share", "block_size origin_shift strong_cells hidden_cells")
def maup_shifted_blocks(spark, d):
    return resample.shifted_blocks(V.flags(spark, d, region=False), "cell_row", "cell_col", [3, 5, 10, 20])


_REPS = 5000


def _null_sql(model: str, universe: str, label: str, stratum: str, metrics: dict[str, tuple[str, str]]) -> str:
    """SQL of one null model: metric name -> (value of a replicate, observed value)."""
    rep = permute.shuffled_sums_sql(
        f"(select *, cast(not majority as int) as h_flag from ranked where {universe})", label, stratum, model,
        {"hid": "h_flag", "pop": "population", "built": "builtup_m2"}, _REPS, SEED, "cell_id").replace(" as built from x", " / 1e6 as built from x")
    out = []
    for name, (value, observed) in metrics.items():
        out.append(f"""select '{model}' as null_model, '{name}' as metric, any_value(o) as observed, avg(m) as null_mean, quantile_cont(m, 0.025e0) as null_q025, quantile_cont(m, 0.975e0) as null_q975,
          count(*) as n_reps, least(1e0, 2e0 * (least(count(*) filter (where m >= o), count(*) filter (where m <= o)) + 1) / (count(*) + 1)) as two_sided_empirical_p
          from (select {value} as m, {observed} as o from {rep} x, tot)""")
    return " union all ".join(out)


_OR = {"strong_notmajority_or": (
    "round((cast(hid as double) + 0.5e0) * (nb - ns - (nh - hid) + 0.5e0) / ((ns - hid + 0.5e0) * (nh - hid + 0.5e0)), 9)",
    "round((sh + 0.5e0) * (nb - ns - (nh - sh) + 0.5e0) / ((ns - sh + 0.5e0) * (nh - sh + 0.5e0)), 9)")}
_TOT = {"hidden_population_in_strong": ("round(pop, 4)", "round(sp, 4)"), "hidden_builtup_in_strong_km2": ("round(built, 6)", "round(sb, 6)")}
_GRID = "concat(cell_row // {0}, '_', cell_col // {0})"
_PLACEBO = f"""with ranked as (select *, ntile(10) over (partition by strong order by vlm_mm_yr, cell_id) as decile, ntile(5) over (partition by strong order by vlm_mm_yr, cell_id) as quint from fx_flags where base),
       tot as (select count(*) as nb, count(*) filter (where strong) as ns, count(*) filter (where not majority) as nh, count(*) filter (where strong and not majority) as sh,
         sum(population) filter (where strong and not majority) as sp, sum(builtup_m2) filter (where strong and not majority) / 1e6 as sb from ranked) """ + " union all ".join([
    _null_sql("strong_label_global", "true", "strong", "'all'", _OR),
    _null_sql("strong_label_spatial_8x8", "true", "strong", _GRID.format(16), _OR),
    _null_sql("hidden_mask_global", "strong", "not majority", "'all'", _TOT),
    _null_sql("hidden_mask_spatial_8x8", "strong", "not majority", _GRID.format(16), _TOT),
    _null_sql("hidden_mask_deformation_decile", "strong", "not majority", "cast(decile as varchar)", _TOT),
    _null_sql("hidden_mask_spatial4_deformation5", "strong", "not majority", f"concat({_GRID.format(32)}, '_', quint)", _TOT),
])


@query("placebo_permutation", _PLACEBO, "fx_flags", "observed null_mean null_q025 null_q975 two_sided_empirical_p")
def placebo_permutation(spark, d):
    """Labels or masks shuffled 5,000 times globally and inside strata; the null range of each metric."""
    from ..runtime import cut

    cols = ["cell_id", "cell_row", "cell_col", "vlm_mm_yr", "strong", "majority", "population", "builtup_m2"]
    base = V.flags(spark, d, region=False).filter("base").select(*cols).withColumn("hidden", ~F.col("majority"))
    ranked = ordering.global_rank(base, ["vlm_mm_yr", "cell_id"], ["strong"], out="_r", total="_n")
    ranked = cut(ranked.withColumn("decile", ordering.ntile_of("_r", "_n", 10)).withColumn("quint", ordering.ntile_of("_r", "_n", 5)))
    text = lambda c: F.col(c).cast("string")
    block = lambda b: F.concat(F.floor(F.col("cell_row") / b).cast("string"), F.lit("_"), F.floor(F.col("cell_col") / b).cast("string"))
    strong, hidden = F.col("strong"), F.col("hidden")
    model = lambda name, label, stratum, universe: F.when(universe, F.struct(F.lit(name).alias("null_model"), label.alias("label"), stratum.alias("stratum")))
    always = F.lit(True)
    models = F.array(
        model("strong_label_global", strong, F.lit("all"), always), model("strong_label_spatial_8x8", strong, block(16), always),
        model("hidden_mask_global", hidden, F.lit("all"), strong), model("hidden_mask_spatial_8x8", hidden, block(16), strong),
        model("hidden_mask_deformation_decile", hidden, text("decile"), strong),
        model("hidden_mask_spatial4_deformation5", hidden, F.concat(block(32), F.lit("_"), text("quint")), strong),
    )
    rows = ranked.withColumn("m", F.explode(F.filter(models, lambda x: x.isNotNull()))).select("cell_id", "hidden", "population", "builtup_m2", "m.*")
    hid = hidden.cast("bigint")
    # a model sums what its metrics read: labels the strong cells that are seen (the others are hidden), masks the exposure
    of_labels = F.col("null_model").startswith("strong_label")
    sums = {"seen": F.when(of_labels, 1 - hid), "pop": F.when(~of_labels, F.col("population")), "built": F.when(~of_labels, F.col("builtup_m2"))}
    draws = permute.shuffled_sums(rows, "cell_id", "label", sums, _REPS, SEED, "stratum", ["null_model"])
    draws = draws.withColumn("shown", F.round("seen").cast("bigint")).drop("seen")
    both = strong & hidden
    tot = ranked.agg(
        F.count(F.lit(1)).alias("nb"), F.count_if(strong).alias("ns"), F.sum(hid).alias("nh"), F.count_if(both).alias("sh"),
        F.sum(F.when(both, F.col("population"))).alias("sp"), F.sum(F.when(both, F.col("builtup_m2"))).alias("sb"))
    ns, nh, nb = F.col("ns"), F.col("nh"), F.col("nb")
    odds = lambda h: F.round(haldane_or(h, ns - h, nh - h, nb - ns - (nh - h)), 9)
    entry = lambda name, value, observed: F.struct(F.lit(name).alias("metric"), value.alias("value"), observed.alias("seen"))
    of_label = F.array(entry("strong_notmajority_or", odds(ns - F.col("shown")), odds(F.col("sh"))))
    of_mask = F.array(
        entry("hidden_population_in_strong", F.round("pop", 4), F.round("sp", 4)),
        entry("hidden_builtup_in_strong_km2", F.round(F.col("built") / 1e6, 6), F.round(F.col("sb") / 1e6, 6)))
    metrics = F.when(F.col("null_model").startswith("strong_label"), of_label).otherwise(of_mask)
    long = with_scalars(draws, tot).select("null_model", F.explode(metrics).alias("e")).select("null_model", "e.*")
    return resample.null_summary(long, "value", "seen", ["null_model", "metric"])


_MC = 5000


@query("monte_carlo_scenarios", f"""with u as (select i, cast('0x' || substr(md5(concat_ws('|', '{SEED}', 'threshold', cast(i as varchar))), 1, 8) as bigint) / 4294967296e0 as a,
         cast('0x' || substr(md5(concat_ws('|', '{SEED}', 'count', cast(i as varchar))), 1, 8) as bigint) / 4294967296e0 as b,
         cast('0x' || substr(md5(concat_ws('|', '{SEED}', 'scale', cast(i as varchar))), 1, 8) as bigint) / 4294967296e0 as c from (select unnest(range({_MC})) as i)),
       s as (select i, 3e0 + a * 5e0 as threshold, 2 + cast(floor(b * 4e0) as int) as cnt, 0.8e0 + c * 0.4e0 as scale from u),
       k as (select -vlm_mm_yr as fall, n_obs, sum(population) as pop, sum(builtup_m2) as built from fx_flags where base group by 1, 2),
       r as (select s.i, coalesce(sum(pop), 0e0) * any_value(scale) as pop, coalesce(sum(built), 0e0) * any_value(scale) / 1e6 as built from s left join k on k.fall >= s.threshold and k.n_obs < s.cnt group by s.i),
       l as (unpivot (select i, pop as hidden_population, built as hidden_builtup_km2 from r) on hidden_population, hidden_builtup_km2 into name metric value v)
       select metric, quantile_cont(v, 0.05e0) as p05, quantile_cont(v, 0.5e0) as p50, quantile_cont(v, 0.95e0) as p95 from l group by metric""", "fx_flags", "p05:4 p50:4 p95:4")
def monte_carlo_scenarios(spark, d):
    """5,000 scenarios of threshold, support and exposure scale."""
    mc = resample.monte_carlo(V.flags(spark, d, region=False), _MC, SEED, V.N_PAIRS, (3.0, 8.0), (2, 5), (0.8, 1.2))
    long = mc.unpivot("iteration", ["hidden_population", "hidden_builtup_km2"], "metric", "v")
    return long.groupBy("metric").agg(*ordering.bounded_quantiles("v", {"p05": 0.05, "p50": 0.5, "p95": 0.95}))
