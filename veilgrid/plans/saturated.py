"""Binomial models with a parameter for every class of cells, whose fits SQL can state in closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import block_row
from ..operators import binomial as B
from . import models as M
from . import views as V
from .registry import query

_COEF = "beta se z odds_ratio odds_ratio_ci_low odds_ratio_ci_high"
_TERMS = ["intercept", "strong"]
#: Sums of class s over the alternatives, as columns.
_CLASSES = """sum(case when strong then 0 else y end) as y0, sum(case when strong then 0 else n_pairs end) as t0,
       sum(case when strong then y else 0 end) as y1, sum(case when strong then n_pairs else 0 end) as t1"""
_VAR = "(1e0 / y{0} + 1e0 / (t{0} - y{0}))"
_DIFF = "ln(cast(y1 as double) / (t1 - y1)) - ln(cast(y0 as double) / (t0 - y0))"
_ODDS = "beta, se, beta / se as z, exp(beta) as odds_ratio, exp(beta - 1.96e0 * se) as odds_ratio_ci_low, exp(beta + 1.96e0 * se) as odds_ratio_ci_high"


def _cells(spark, d, size: int, successes: str):
    """Rows of the model of an intercept and the strong class."""
    cells = V.model_cells(spark, d).select("cell_row", "cell_col", "region_id", "strong", "n_obs", "failure_count", "n_pairs")
    cells = cells.withColumns({"block_row": block_row("cell_row", size), "block_col": block_row("cell_col", size), "s": F.col("strong").cast("double")})
    design = cells.withColumn("x", F.array(F.lit(1.0), F.col("s")))
    return B.prepare(design, successes, "n_pairs", ["s", "region_id", "block_row", "block_col"])


@query("irls_saturated", f"""with g as (select {_CLASSES} from (select *, n_obs as y from fx_model)),
       l as (select *, {" + ".join(f"y{i} * ln(cast(y{i} as double) / t{i}) + (t{i} - y{i}) * ln(1e0 - cast(y{i} as double) / t{i})" for i in (0, 1))} as log_likelihood from g),
       c as (select 0 as position, 'intercept' as term, ln(cast(y0 as double) / (t0 - y0)) as beta, sqrt({_VAR.format(0)}) as se, log_likelihood from l
         union all select 1, 'strong', {_DIFF}, sqrt({_VAR.format(0)} + {_VAR.format(1)}), log_likelihood from l)
       select position, term, {_ODDS}, true as converged, log_likelihood from c""", "fx_model", _COEF + " log_likelihood:3")
def irls_saturated(spark, d):
    """Grouped-binomial fit of the strong class alone."""
    fit = B.fit_binomial(_cells(spark, d, M._LEAD_BLOCK, "n_obs"), 2, ridge=0.0)
    return M._coefs(spark, fit.beta[0], fit.cov[0], _TERMS).withColumns(
        {"converged": F.lit(bool(fit.converged[0])), "log_likelihood": F.lit(float(fit.log_likelihood[0]))})


@query("cluster_cov_saturated", f"""with g as (select {_CLASSES} from (select *, failure_count as y from fx_model)),
       u as (select sum(case when strong then 0e0 else failure_count - n_pairs * cast(y0 as double) / t0 end) as u0,
         sum(case when strong then failure_count - n_pairs * cast(y1 as double) / t1 else 0e0 end) as u1
         from fx_model, g group by region_id, floor(cell_row / {M._MULTI_BLOCK}e0), floor(cell_col / {M._MULTI_BLOCK}e0)),
       i as (select *, y0 * (1e0 - cast(y0 as double) / t0) as i0, y1 * (1e0 - cast(y1 as double) / t1) as i1 from g),
       m as (select sum(u0 * u0) as m00, sum(u0 * u1) as m01, sum(u1 * u1) as m11 from u),
       c as (select 0 as position, 'intercept' as term, ln(cast(y0 as double) / (t0 - y0)) as beta, sqrt(m00) / i0 as se from i, m
         union all select 1, 'strong', {_DIFF}, sqrt(m00 / (i0 * i0) - 2e0 * m01 / (i0 * i1) + m11 / (i1 * i1)) from i, m)
       select position, term, {_ODDS} from c""", "fx_model", _COEF)
def cluster_cov_saturated(spark, d):
    """Block-clustered errors of the strong class."""
    rows = _cells(spark, d, M._MULTI_BLOCK, "failure_count")
    fit = B.fit_binomial(rows, 2, ridge=0.0)
    return M._coefs(spark, fit.beta[0], B.sandwich(rows, ["region_id", "block_row", "block_col"], fit.beta[0], fit.cov[0]), _TERMS)


@query("leave_block_out_saturated", f"""with b as (select cast(floor(cell_row / {M._LEAD_BLOCK}e0) as bigint) as block_row, cast(floor(cell_col / {M._LEAD_BLOCK}e0) as bigint) as block_col,
         count(*) as n_cells_left_out, {_CLASSES} from (select *, n_obs as y from fx_model) group by 1, 2),
       r as (select block_row, block_col, n_cells_left_out, {", ".join(f"sum({c}) over () - {c} as {c}" for c in ("y0", "t0", "y1", "t1"))} from b),
       e as (select *, {_DIFF} as strong_beta, sqrt({_VAR.format(0)} + {_VAR.format(1)}) as se from r)
       select block_row, block_col, n_cells_left_out, true as converged, strong_beta, exp(strong_beta) as strong_odds_ratio,
         exp(strong_beta - 1.96e0 * se) as strong_ci_low, exp(strong_beta + 1.96e0 * se) as strong_ci_high from e""",
       "fx_model", "strong_beta strong_odds_ratio strong_ci_low strong_ci_high", "block_row block_col")
def leave_block_out_saturated(spark, d):
    """The strong class refitted without each block."""
    fits = B.leave_block_out(_cells(spark, d, M._LEAD_BLOCK, "n_obs"), 2, ["block_row", "block_col"], ridge=0.0)
    return M.left_out_effect(fits, 1, 2)


@query("avg_effects_saturated", f"""with g as (select region_id, count(*) as n, {_CLASSES} from (select *, failure_count as y from fx_model) group by region_id),
       e as (select region_id, n, {_DIFF} as beta, {_VAR.format(0)} + {_VAR.format(1)} as v from g),
       c as (select concat('avg_strong_effect:', cast(region_id as varchar)) as effect, beta, sqrt(v) as se from e
         union all select 'avg_strong_effect:ALL', sum(n * beta) / sum(n), sqrt(sum(n * n * v)) / sum(n) from e)
       select effect, {_ODDS} from c""", "fx_model", _COEF)
def avg_effects_saturated(spark, d):
    """Strong effect of every region, and averaged over the cells of all, in a model with both classes in each region."""
    rows = _cells(spark, d, M._MULTI_BLOCK, "failure_count")
    regions = sorted(r[0] for r in rows.select("region_id").distinct().collect())  # levels of the model
    terms, cols = ["intercept", "strong_subsidence"], [F.lit(1.0), F.col("s")]
    for level in regions[1:]:
        own = (F.col("region_id") == level).cast("double")
        terms += [f"region_{level}", f"strong_x_{level}"]
        cols += [own, F.col("s") * own]
    rows = rows.withColumns({"x": F.array(*cols), "pop_z": F.lit(0.0), "built_z": F.lit(0.0), "landcover_group": F.lit("all")})
    fit = B.fit_binomial(rows, len(terms), ridge=0.0)
    weights = B.mean_effect_weights(rows, "region_id", regions, "landcover_group", terms)
    return M._effects(spark, "avg_strong_effect", weights, fit.beta[0], fit.cov[0])
