"""Binomial models, pooling of effects and ridge regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import labels, numeric
from ..functions.geo import block_row
from ..operators import binomial as B
from ..operators import joins, meta, ordering
from ..operators import regression as R
from ..runtime import cut
from . import views as V
from .models_shared import evidence
from .registry import query

_STD = "({x} - avg({x}) over ()) / coalesce(nullif(stddev_pop({x}) over (), 0e0), 1e0)"
_Z = {"pz": "ln(1e0 + greatest(population, 0e0))", "bz": "ln(1e0 + greatest(builtup_m2, 0e0))", "rz": "cast(cell_row as double)", "cz": "cast(cell_col as double)"}
_ZSQL = ", ".join(f"{_STD.format(x=e)} as {n}" for n, e in _Z.items())


_MODEL_COLS = ["cell_id", "cell_row", "cell_col", "region_id", "landcover_group", "strong", "majority", "n_obs", "n_pairs", "failure_count", "population", "builtup_m2"]

#: Cells on a side of the blocks of the single-region and of the multi-region model.
_LEAD_BLOCK, _MULTI_BLOCK = 5, 10


def lead_design(spark, d):
    cells = cut(V.model_cells(spark, d).select(*_MODEL_COLS))  # read for the scores, then for the features
    carry = ["cell_id", "n_obs", "n_pairs", "majority", "strong_sub_5mm", "block_row", "block_col", "region_id"]
    cells = cells.withColumn("strong_sub_5mm", F.col("strong").cast("int"))
    cells = cells.withColumn("block_row", block_row("cell_row", _LEAD_BLOCK)).withColumn("block_col", block_row("cell_col", _LEAD_BLOCK))
    return B.design_lead(cells, "strong_sub_5mm", "population", "builtup_m2", "cell_row", "cell_col", carry)


@query("design_lead", f"""with z as (select cell_id, cast(strong as int) as s, {_ZSQL} from fx_model)
       select cell_id, 1e0 as x0, cast(s as double) as x1, pz as x2, bz as x3, rz as x4, cz as x5, s * pz as x6, s * bz as x7 from z""", "fx_model", "x0 x1 x2 x3 x4 x5 x6 x7")
def design_lead(spark, d):
    return lead_design(spark, d).select("cell_id", *[F.col("x")[i].alias(f"x{i}") for i in range(len(B.LEAD_TERMS))])


_GROUPS = list(labels.LANDCOVER_CODES)


def multi_design(spark, d, strong_landcover: bool = False, identified: bool = True):
    cells = cut(V.model_cells(spark, d).select(*_MODEL_COLS))
    cells = cells.withColumn("block_row", block_row("cell_row", _MULTI_BLOCK)).withColumn("block_col", block_row("cell_col", _MULTI_BLOCK))
    regions = sorted(r[0] for r in V.table(spark, d, "region").select("r_regionkey").collect())  # levels of the model
    groups = B.identified_groups(cells, "landcover_group", _GROUPS) if identified else _GROUPS
    design, terms = B.design_multi(
        cells, "region_id", regions, "landcover_group", groups, "strong", "population", "builtup_m2",
        ["cell_id", "failure_count", "n_pairs", "block_row", "block_col"], strong_landcover)
    return design, terms, regions


def _multi_sql() -> tuple[str, str]:
    cols = ["1e0", "s", "pz", "bz"]
    for r in range(1, 5):
        cols += [f"cast(region_id = {r} as int)", f"s * cast(region_id = {r} as int)"]
    for g in _GROUPS:
        cols += [f"cast(landcover_group = '{g}' as int)", f"s * cast(landcover_group = '{g}' as int)"]
    cols += ["s * pz", "s * bz"]
    body = ", ".join(f"cast({c} as double) as x{i}" for i, c in enumerate(cols))
    return f"with z as (select cell_id, region_id, landcover_group, cast(strong as int) as s, {_ZSQL} from fx_model) select cell_id, {body} from z", " ".join(f"x{i}" for i in range(len(cols)))


@query("design_multi", _multi_sql()[0], "fx_model", _multi_sql()[1])
def design_multi(spark, d):
    design, terms, _ = multi_design(spark, d, True, False)
    return design.select("cell_id", *[F.col("x")[i].alias(f"x{i}") for i in range(len(terms))])


def _coefs(spark, beta, cov, terms):
    df = spark.createDataFrame(B.coefficient_rows(beta, cov, terms), "position int, term string, beta double, se double")
    return R.coefficient_columns(df)


@query("irls_binomial", rnd="beta se z odds_ratio odds_ratio_ci_low odds_ratio_ci_high log_likelihood:3")
def irls_binomial(spark, d):
    """The single-region model on observation counts, and on the majority flag."""
    rows = B.prepare(lead_design(spark, d), "n_obs", "n_pairs", ["majority"])
    binary = rows.select("x", (~F.col("majority")).cast("double").alias("y"), F.lit(1.0).alias("t"))
    out = []
    for name, data in (("binomial", rows), ("binary", binary)):
        fit = B.fit_binomial(data, len(B.LEAD_TERMS))
        table = _coefs(spark, fit.beta[0], fit.cov[0], B.LEAD_TERMS)
        out.append(table.withColumns({"model": F.lit(name), "converged": F.lit(bool(fit.converged[0])), "log_likelihood": F.lit(float(fit.log_likelihood[0]))}))
    return ordering.union_all(out)


@query("coef_table", """select nation_id, log_or as beta, sqrt(var) as se, log_or / sqrt(var) as z, exp(log_or) as odds_ratio, exp(log_or - 1.96e0 * sqrt(var)) as odds_ratio_ci_low,
       exp(log_or + 1.96e0 * sqrt(var)) as odds_ratio_ci_high from fx_studies""", "fx_studies", "beta se z odds_ratio odds_ratio_ci_low odds_ratio_ci_high")
def coef_table(spark, d):
    s = V.studies(spark, d).select("nation_id", F.col("log_or").alias("beta"), F.sqrt("var").alias("se"))
    return R.coefficient_columns(s)


def _multi_fit(spark, d):
    design, terms, regions = multi_design(spark, d)
    rows = B.prepare(design, "failure_count", "n_pairs", ["region_id", "landcover_group", "pop_z", "built_z", "block_row", "block_col"])
    fit = B.fit_binomial(rows, len(terms))
    return rows, terms, regions, fit


@query("cluster_cov", rnd="beta se z odds_ratio odds_ratio_ci_low odds_ratio_ci_high")
def cluster_cov(spark, d):
    """Multi-region coefficients with block-clustered errors."""
    rows, terms, _, fit = _multi_fit(spark, d)
    cov = B.sandwich(rows, ["region_id", "block_row", "block_col"], fit.beta[0], fit.cov[0])
    return _coefs(spark, fit.beta[0], cov, terms)


def _effects(spark, name, weights, beta, cov):
    rows = [(f"{name}:{k}", *B.linear_combination(w, beta, cov)) for k, w in weights.items()]
    return R.coefficient_columns(spark.createDataFrame(rows, "effect string, beta double, se double"))


@query("avg_effects", rnd="beta se z odds_ratio odds_ratio_ci_low odds_ratio_ci_high")
def avg_effects(spark, d):
    """Strong effect averaged over the cells of each region and over all."""
    rows, terms, regions, fit = _multi_fit(spark, d)
    cov = B.sandwich(rows, ["region_id", "block_row", "block_col"], fit.beta[0], fit.cov[0])
    weights = B.mean_effect_weights(rows, "region_id", regions, "landcover_group", terms)
    return _effects(spark, "avg_strong_effect", weights, fit.beta[0], cov)


@query("marginal_effects", rnd="beta se z odds_ratio odds_ratio_ci_low odds_ratio_ci_high")
def marginal_effects(spark, d):
    """Strong effect of each region at mean exposure."""
    rows, terms, regions, fit = _multi_fit(spark, d)
    cov = B.sandwich(rows, ["region_id", "block_row", "block_col"], fit.beta[0], fit.cov[0])
    return _effects(spark, "strong_subsidence_at_mean_exposure", B.marginal_weights(regions, terms), fit.beta[0], cov)


_LEAD_REPS, _STRATA_REPS = 200, 1000


@query("bootstrap_glm", rnd="odds_ratio_boot_mean odds_ratio_boot_q025 odds_ratio_boot_q50 odds_ratio_boot_q975")
def bootstrap_glm(spark, d):
    """All replicates of the single-region model share each pass over the cells."""
    rows = B.prepare(lead_design(spark, d), "n_obs", "n_pairs", ["block_row", "block_col"])
    p = len(B.LEAD_TERMS)
    base = B.fit_binomial(rows, p)
    fit = B.bootstrap_fits(rows, p, ["block_row", "block_col"], [], _LEAD_REPS, 20260709, start=base.beta[0])
    ok = fit.converged & np.isfinite(fit.beta).all(axis=1)
    return B.summarize_draws(spark, {t: np.exp(fit.beta[:, i]) for i, t in enumerate(B.LEAD_TERMS) if i}, ok)


@query("bootstrap_glm_stratified", rnd="odds_ratio_boot_mean odds_ratio_boot_q025 odds_ratio_boot_q50 odds_ratio_boot_q975")
def bootstrap_glm_stratified(spark, d):
    """Blocks resampled inside each region: strong effects at mean exposure, and averaged over the cells drawn."""
    rows, terms, regions, base = _multi_fit(spark, d)
    block = ["block_row", "block_col"]
    drawn = B.drawn_blocks(rows, block, ["region_id"], _STRATA_REPS, 20260709)
    fit = B.bootstrap_fits(rows, len(terms), block, ["region_id"], _STRATA_REPS, 20260709, start=base.beta[0], drawn=drawn)
    ok = fit.converged & np.isfinite(fit.beta).all(axis=1)
    draws = {str(k): np.exp(fit.beta @ w) for k, w in B.marginal_weights(regions, terms).items()}
    draws |= {t: np.exp(fit.beta[:, terms.index(t)]) for t in ("strong_x_population_z", "strong_x_builtup_z")}
    averaged = B.replicate_effect_weights(rows, block, "region_id", regions, "landcover_group", terms, _STRATA_REPS, drawn)
    draws |= {f"avg_strong_effect:{k}": np.exp((fit.beta * w).sum(axis=1)) for k, w in averaged.items()}
    return B.summarize_draws(spark, draws, ok, "effect")


@query("leave_block_out", rnd="strong_beta strong_odds_ratio strong_ci_low strong_ci_high")
def leave_block_out(spark, d):
    """Refit without each spatial block."""
    rows = B.prepare(lead_design(spark, d), "n_obs", "n_pairs", ["block_row", "block_col"])
    p = len(B.LEAD_TERMS)
    base = B.fit_binomial(rows, p)
    fits = B.leave_block_out(rows, p, ["block_row", "block_col"], start=base.beta[0])
    return left_out_effect(fits, B.LEAD_TERMS.index("strong_sub_5mm"), p)


def left_out_effect(fits, i: int, p: int):
    """Estimate ``i`` of each left-out fit as an odds ratio with its interval."""
    b, s = F.col("strong_beta"), F.sqrt(F.greatest(F.col("cov")[i * p + i], F.lit(0.0)))
    return fits.withColumn("strong_beta", F.col("beta")[i]).select(
        "block_row", "block_col", "n_cells_left_out", "converged", "strong_beta", F.exp(b).alias("strong_odds_ratio"),
        F.exp(b - 1.96 * s).alias("strong_ci_low"), F.exp(b + 1.96 * s).alias("strong_ci_high"))


_META_COLS = "fixed_log_or fixed_or fixed_ci_low fixed_ci_high random_log_or random_or random_ci_low random_ci_high q tau2 i2"


def _meta_sql(source: str, group: str) -> str:
    """Pooled effects of a CTE with y, v and a group column."""
    return f"""m0 as (select {group}, count(*) as k, sum(1e0 / v) as s0, sum(y / v) / sum(1e0 / v) as fe, sum(1e0 / (v * v)) as sw2 from {source} group by {group}),
       m1 as (select m0.*, (select sum((y - fe) * (y - fe) / v) from {source} x where x.{group} = m0.{group}) as q, greatest(k - 1, 1) * 1e0 as df, s0 - sw2 / s0 as c from m0),
       m2 as (select *, case when c > 0 then greatest(0e0, (q - df) / c) else 0e0 end as tau2, case when q > 0 then greatest(0e0, (q - df) / q) else 0e0 end as i2 from m1),
       m3 as (select m2.*, r.r0, r.r1 from m2 join (select x.{group}, sum(1e0 / (v + tau2)) as r0, sum(y / (v + tau2)) as r1 from {source} x join m2 t on t.{group} = x.{group} group by x.{group}) r on r.{group} = m2.{group})
       select {group}, k, fe as fixed_log_or, exp(fe) as fixed_or, exp(fe - 1.96e0 * sqrt(1e0 / s0)) as fixed_ci_low, exp(fe + 1.96e0 * sqrt(1e0 / s0)) as fixed_ci_high,
         r1 / r0 as random_log_or, exp(r1 / r0) as random_or, exp(r1 / r0 - 1.96e0 * sqrt(1e0 / r0)) as random_ci_low, exp(r1 / r0 + 1.96e0 * sqrt(1e0 / r0)) as random_ci_high, q, tau2, i2, df from m3"""


@query("meta_fixed_random", f"with s as (select region_id, log_or as y, var as v from fx_studies), {_meta_sql('s', 'region_id')}", "fx_studies", _META_COLS)
def meta_fixed_random(spark, d):
    return meta.pooled_effects(V.studies(spark, d), group=["region_id"])


@query("meta_subgroups", f"""with s as (select subset, log_or as y, var as v from (select *, unnest(['all', case when log_or > 0 then 'positive' else 'other' end, case when n_cells >= 600 then 'large' else 'small' end]) as subset
         from fx_studies)), {_meta_sql('s', 'subset')}""", "fx_studies", _META_COLS)
def meta_subgroups(spark, d):
    """Overlapping subsets of the studies, all in one job."""
    pos, big = F.col("log_or") > 0, F.col("n_cells") >= 600
    return meta.pooled_subsets(V.studies(spark, d), {"all": F.lit(True), "positive": pos, "other": ~pos, "large": big, "small": ~big})


_LOO = "s as (select a.nation_id as left_out, b.log_or as y, b.var as v from fx_studies a join fx_studies b on a.nation_id <> b.nation_id)"


@query("meta_loo", f"with {_LOO}, p as (with {_meta_sql('s', 'left_out')}) select left_out, random_or as pooled_random_or, random_ci_low as pooled_random_ci_low, random_ci_high as pooled_random_ci_high, tau2, i2 from p",
       "fx_studies", "pooled_random_or pooled_random_ci_low pooled_random_ci_high tau2 i2")
def meta_loo(spark, d):
    return meta.pooled_without_each(V.studies(spark, d), "nation_id")


@query("se_from_ci", "select nation_id, (ln(exp(log_or + 1.96e0 * sqrt(var))) - ln(exp(log_or - 1.96e0 * sqrt(var)))) / (2e0 * 1.96e0) as se from fx_studies", "fx_studies", "se")
def se_from_ci(spark, d):
    se = F.sqrt("var")
    s = V.studies(spark, d).select("nation_id", F.exp(F.col("log_or") - 1.96 * se).alias("lo"), F.exp(F.col("log_or") + 1.96 * se).alias("hi"))
    return s.select("nation_id", numeric.se_from_ci("lo", "hi").alias("se"))


@query("anchor_substitute", """with a as (select region_id * 5 as nation_id, avg(log_or) as log_or, avg(var) as var from fx_studies group by region_id)
       select s.nation_id, coalesce(a.log_or, s.log_or) as log_or, coalesce(a.var, s.var) as var, case when a.log_or is not null then 1e0 else 0e0 end as cell_level
       from fx_studies s left join a on a.nation_id = s.nation_id""", "fx_studies", "log_or var")
def anchor_substitute(spark, d):
    """One study per region gets the estimate of a closer model."""
    s = V.studies(spark, d).select("nation_id", "region_id", "log_or", "var")
    anchors = s.groupBy((F.col("region_id") * 5).alias("nation_id")).agg(F.avg("log_or").alias("log_or"), F.avg("var").alias("var"))
    return meta.substitute_estimate(s.drop("region_id"), anchors, "nation_id", ["log_or", "var"])


_RIDGE = 0.5
_XY = "xy as (select region_id, nation_id, log_or as y, ln(1e0 + n_cells) - 6e0 as x, 1e0 / var as w from fx_studies)"


def _regression_studies(spark, d):
    return V.studies(spark, d).withColumn("x", F.log1p("n_cells") - 6.0).withColumn("w", 1.0 / F.col("var"))


@query("wls_ridge", f"""with {_XY}, m as (select region_id, sum(w) as a, sum(w * x) as b, sum(w * x * x) + {_RIDGE}e0 as c, sum(w * y) as g0, sum(w * x * y) as g1 from xy group by region_id),
       f as (select region_id, a * c - b * b as det, * exclude (region_id) from m),
       t as (select region_id, 0 as position, 'intercept' as term, (c * g0 - b * g1) / det as beta, sqrt(c / det) as se from f
         union all select region_id, 1, 'x', (a * g1 - b * g0) / det, sqrt(a / det) from f)
       select *, beta / se as z, exp(beta) as odds_ratio, exp(beta - 1.96e0 * se) as odds_ratio_ci_low, exp(beta + 1.96e0 * se) as odds_ratio_ci_high from t""", "fx_studies",
       "beta se z odds_ratio odds_ratio_ci_low odds_ratio_ci_high", "position")
def wls_ridge(spark, d):
    return R.wls_ridge(_regression_studies(spark, d), ["x"], "log_or", F.col("w"), _RIDGE, ["region_id"])


_LOO_FIT = f"""{_XY}, m as (select i.nation_id, i.y as yi, i.x as xi, sum(j.w) as a, sum(j.w * j.x) as b, sum(j.w * j.x * j.x) + {_RIDGE}e0 as c, sum(j.w * j.y) as g0, sum(j.w * j.x * j.y) as g1
         from xy i join xy j on i.nation_id <> j.nation_id group by i.nation_id, i.y, i.x),
       p as (select nation_id, yi as observed_log_or, ((c * g0 - b * g1) + xi * (a * g1 - b * g0)) / (a * c - b * b) as predicted_log_or, sqrt((c - 2e0 * xi * b + xi * xi * a) / (a * c - b * b)) as predicted_se from m)"""


@query("wls_loo_predict", f"""with {_LOO_FIT} select *, observed_log_or - predicted_log_or as residual_log_or, exp(predicted_log_or) as predicted_or,
       exp(predicted_log_or - 1.96e0 * predicted_se) as predicted_or_ci_low, exp(predicted_log_or + 1.96e0 * predicted_se) as predicted_or_ci_high from p""", "fx_studies",
       "observed_log_or predicted_log_or predicted_se residual_log_or predicted_or predicted_or_ci_low predicted_or_ci_high")
def wls_loo_predict(spark, d):
    return R.wls_leave_one_out(_regression_studies(spark, d), "nation_id", ["x"], "log_or", F.col("w"), _RIDGE)


@query("loo_error", f"with {_LOO_FIT} select avg(abs(predicted_log_or - observed_log_or)) as loo_mae, max(abs(predicted_log_or - observed_log_or)) as loo_max_abs_error from p",
       "fx_studies", "loo_mae loo_max_abs_error")
def loo_error(spark, d):
    return R.loo_error(wls_loo_predict(spark, d))


@query("family_ladder", rnd="reference_or reference_ci_low reference_ci_high loo_mae loo_max_abs_error", ints="n_terms")
def family_ladder(spark, d):
    """Five covariate families compared by leave-one-out error."""
    e = evidence(spark, d).select("nation_id", "cropland_fraction", "built_up_fraction", "water_wetland_mangrove_fraction", "dominant_landcover", "station_count", "signal")
    s = V.studies(spark, d).join(e, "nation_id").withColumns({
        "n_cells_log": F.log1p("n_cells"), "strong_cells_log": F.log1p("strong_cells"), "hidden_share": F.col("a") / (F.col("a") + F.col("b")),
        "signal_code": labels.code_map("signal", labels.SIGNAL_CODES), "station_log": F.log1p("station_count"),
        "lc_built": (F.col("dominant_landcover") == "built_up").cast("double"), "lc_water": (F.col("dominant_landcover") == "water_wetland_mangrove").cast("double"),
    })
    s = cut(s)
    families = {
        "summary_only_meta": [],
        "landcover_size_stack": ["signal_code", "station_log", "n_cells_log", "lc_built", "lc_water"],
        "exposure_composition_stack": ["signal_code", "station_log", "n_cells_log", "strong_cells_log", "cropland_fraction", "built_up_fraction", "water_wetland_mangrove_fraction"],
        "hidden_stratified_stack": ["signal_code", "station_log", "n_cells_log", "strong_cells_log", "hidden_share"],
        "full_stratified_control_stack": ["signal_code", "station_log", "n_cells_log", "strong_cells_log", "hidden_share", "cropland_fraction", "built_up_fraction", "water_wetland_mangrove_fraction", "lc_built", "lc_water"],
    }
    w = 1.0 / F.col("var")
    out = []
    for family, terms in families.items():  # five short specs
        if not terms:
            ref = meta.pooled_effects(s).select(F.col("random_or").alias("reference_or"), F.col("random_ci_low").alias("reference_ci_low"), F.col("random_ci_high").alias("reference_ci_high"))
            row = ref.withColumn("loo_mae", F.lit(None).cast("double")).withColumn("loo_max_abs_error", F.lit(None).cast("double"))
        else:
            z = ordering.zscore(s, terms, train=F.lit(True))
            fit = R.wls_ridge(z, [f"{t}_z" for t in terms], "log_or", w).filter("position = 0")
            ref = fit.select(F.col("odds_ratio").alias("reference_or"), F.col("odds_ratio_ci_low").alias("reference_ci_low"), F.col("odds_ratio_ci_high").alias("reference_ci_high"))
            row = ref.crossJoin(R.loo_error(R.standardized_leave_one_out(s, "nation_id", terms, "log_or", w)))  # one row each
        out.append(row.withColumn("family", F.lit(family)).withColumn("n_terms", F.lit(len(terms))))
    return ordering.union_all(out).orderBy(F.col("loo_mae").asc_nulls_last(), "family")


@query("sign_concordance", """with p as (select p.velocity_mm_yr as a, g.vlm_mm_yr as b from fx_points p join fx_grid g on g.cell_row = floor((15e0 - p.lat) / 0.01e0) and g.cell_col = floor((p.lon - 100e0) / 0.01e0)
         and floor((p.lon - 100e0) / 0.01e0) between 0 and 127)
       select avg(case when a < 0e0 and b < 0e0 then 1e0 else 0e0 end) as same_sign_negative_fraction, count(*) as n_valid_pairs from p""", "fx_points fx_grid", "same_sign_negative_fraction")
def sign_concordance(spark, d):
    """How often two sources agree that the ground sinks."""
    p = joins.sample_grid(V.points(spark, d), "lon", "lat", V.grid(spark, d), V.TARGET, {"vlm_mm_yr": "other"}, "cell_row", "cell_col").filter("other is not null")
    both = (F.col("velocity_mm_yr") < 0) & (F.col("other") < 0)
    return p.agg(F.avg(both.cast("double")).alias("same_sign_negative_fraction"), F.count(F.lit(1)).alias("n_valid_pairs"))
