"""Hidden-exposure accounting: summaries, closures, rollups, zones, networks, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numeric import exposure_sum, finite, haldane_or, ratio0, ratio_null, wmean, wsum
from ..runtime import attach, cut, explode_specs, with_scalars
from .observe import coherent
from .ordering import exact_quantiles, exact_quantiles_of

M2_PER_KM2 = 1_000_000.0

#: observability classes as masks over the flag columns
CLASSES = {
    "any_observable": lambda: F.col("any_obs"),
    "majority_observable": lambda: F.col("majority"),
    "not_majority_observable": lambda: ~F.col("majority"),
    "never_observable": lambda: ~F.col("any_obs"),
    "obs_lt_0p25": lambda: F.col("low25"),
}
#: ways in which a strong cell can be hidden
HIDDEN = {
    "never_observable": lambda: ~F.col("any_obs"),
    "not_majority": lambda: ~F.col("majority"),
    "not_stable75": lambda: ~F.col("stable75"),
}


def contingency(strong: str = "strong", nonstrong: str = "nonstrong", majority: str = "majority") -> list[Column]:
    """The 2x2 counts: strong/nonstrong by hidden/observed."""
    s, n, m = F.col(strong), F.col(nonstrong), F.col(majority)
    return [
        F.count_if(s & ~m).alias("a"), F.count_if(s & m).alias("b"),
        F.count_if(n & ~m).alias("c"), F.count_if(n & m).alias("d"),
    ]


def hidden_exposure_summary(df: DataFrame, group: list[str], n_pairs: int, threshold: float,
                            velocity: str = "vlm_mm_yr", population: str = "population",
                            builtup: str = "builtup_m2", pop_cover: str = "cover_fraction",
                            built_cover: str = "cover_fraction") -> DataFrame:
    """The full account of one frame per group: one aggregation, then ratios.

    Takes cells with ``base``, ``strong``, ``nonstrong`` and the observability flags.
    """
    account = _account(df, group, n_pairs, threshold, velocity, population, builtup, pop_cover, built_cover)
    return account.drop("nonstrong_not_majority_fraction")


def _account(df: DataFrame, group: list[str], n_pairs: int, threshold: float, velocity: str = "vlm_mm_yr",
             population: str = "population", builtup: str = "builtup_m2", pop_cover: str = "cover_fraction",
             built_cover: str = "cover_fraction") -> DataFrame:
    # every figure depends on a cell only through its flags, so cells are first summed to one row
    # per combination of flags: nine sums over the data, the rest on some dozens of rows
    weights = {"p": population, "b": builtup}
    flags = ["base", "strong", "nonstrong", "any_obs", "majority", "stable75", "low25", "obs_fraction"]
    cover = {"mean_pop_cover_fraction": pop_cover, "mean_built_cover_fraction": built_cover}
    cube = df.groupBy(*group, *flags).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(finite(velocity)).alias("_valid"), F.sum(F.when(finite(velocity), F.col(velocity))).alias("_v"),
        # values are masked before this first sum: one missing exposure must not take its whole row of flags with it
        *[exposure_sum(w).alias(f"_{k}") for k, w in weights.items()],
        *[f(F.when(finite(c), F.col(c))).alias(f"_{t}_{n}") for n, c in cover.items() for t, f in (("sum", F.sum), ("n", F.count))],
    )
    base, strong, nonstrong, majority = (F.col(c) for c in ("base", "strong", "nonstrong", "majority"))
    cells = lambda mask: F.coalesce(F.sum(F.when(mask, F.col("_n"))), F.lit(0))
    aggs = [
        F.sum("_valid").alias("valid_vlm_cells"), cells(base).alias("covered_vlm_cells"), cells(strong).alias("strong_sub_5mm_cells"),
        ratio_null(F.sum(F.when(strong, F.col("_v"))), F.sum(F.when(strong, F.col("_n")))).alias("strong_sub_5mm_mean_vlm_mm_yr"),
        ratio_null(F.sum(F.when(strong, F.col("obs_fraction") * F.col("_n"))), F.sum(F.when(strong, F.col("_n")))).alias("strong_sub_5mm_mean_observability"),
        cells(strong & F.col("low25")).alias("_n_low25"),
        *[cells(strong & mask()).alias(f"_n_{h}") for h, mask in HIDDEN.items()],
        cells(strong & ~majority).alias("a"), cells(strong & majority).alias("b"),
        cells(nonstrong & ~majority).alias("c"), cells(nonstrong & majority).alias("d"),
    ]
    for key in weights:
        w = F.col(f"_{key}")
        aggs += [
            wsum(w, base).alias(f"_{key}_total"), wsum(w, strong).alias(f"_{key}_strong"),
            wsum(w * F.col("obs_fraction"), base).alias(f"_{key}_obs"),
            *[wsum(w, strong & mask()).alias(f"_{key}_strong_{h}") for h, mask in HIDDEN.items()],
            *[wsum(w, base & mask()).alias(f"_{key}_{c}") for c, mask in CLASSES.items()],
        ]
    aggs += [ratio_null(F.sum(F.when(base, F.col(f"_sum_{n}"))), F.sum(F.when(base, F.col(f"_n_{n}")))).alias(n) for n in cover]
    t = cube.groupBy(*group).agg(*aggs)
    km2 = lambda c: F.col(c) / M2_PER_KM2
    share = lambda c: ratio0(c, "strong_sub_5mm_cells")
    cols = [
        F.lit(float(threshold)).alias("coherence_threshold"), F.lit(n_pairs).alias("n_pairs"),
        F.col("valid_vlm_cells"), F.col("covered_vlm_cells"), F.col("strong_sub_5mm_cells"),
        ratio0("strong_sub_5mm_cells", "covered_vlm_cells").alias("strong_sub_5mm_fraction"),
        F.col("strong_sub_5mm_mean_vlm_mm_yr"), F.col("strong_sub_5mm_mean_observability"),
        *[share(f"_n_{h}").alias(f"strong_sub_5mm_{h}_fraction") for h in HIDDEN],
        share("_n_low25").alias("strong_sub_5mm_obs_lt_0p25_fraction"),
        haldane_or("a", "b", "c", "d").alias("strong_vs_nonstrong_not_majority_odds_ratio"),
        ratio0("c", F.col("c") + F.col("d")).alias("nonstrong_not_majority_fraction"),
    ]
    for key, name, unit, val in (("p", "population", "", F.col), ("b", "builtup", "_km2", km2)):
        total, strong_total = f"_{key}_total", f"_{key}_strong"
        cols += [
            val(total).alias(f"total_{name}{unit}_vlm_grid"),
            val(strong_total).alias(f"strong_sub_5mm_{name}{unit}"),
            ratio0(strong_total, total).alias(f"strong_sub_5mm_{name}_fraction"),
            *[val(f"_{key}_strong_{h}").alias(f"strong_sub_5mm_{name}_{h}{unit}") for h in HIDDEN],
            *[ratio0(f"_{key}_strong_{h}", strong_total).alias(f"strong_sub_5mm_{name}_{h}_fraction") for h in HIDDEN],
            *[val(f"_{key}_{c}").alias(f"{name}_{c}{unit}") for c in CLASSES],
            *[ratio0(f"_{key}_{c}", total).alias(f"{name}_{c}_fraction") for c in CLASSES],
            ratio0(f"_{key}_obs", total).alias(f"{name}_weighted_mean_observability"),
        ]
    return t.select(*group, *cols, "mean_pop_cover_fraction", "mean_built_cover_fraction")


def region_summary(df: DataFrame, group: list[str], n_pairs: int, threshold: float, **names) -> DataFrame:
    """The multi-region account: missing exposure (NULL, NaN, infinite, negative) counts as 0, cells need no exposure.

    Drops the per-class and cover columns of the full account and adds the hidden share of
    nonstrong cells.
    """
    drop = [f"{n}_{c}{u}" for n in ("population", "builtup") for c in CLASSES for u in ("", "_km2", "_fraction")]
    drop += ["population_weighted_mean_observability", "builtup_weighted_mean_observability",
             "mean_pop_cover_fraction", "mean_built_cover_fraction"]
    return _account(df, group, n_pairs, threshold, **names).drop(*drop)


def threshold_closure(points: DataFrame, thresholds: list[float], velocity: str = "velocity_mm_yr",
                      exposures: tuple[str, str] = ("population", "builtup"),
                      group: list[str] | None = None, control: float = 0.5) -> DataFrame:
    """Strong versus control points at each threshold: counts, shares, medians.

    Thresholds are a short fixed list, so rows are repeated only into the aggregates. The medians
    of all strong sets and of the control set, which no threshold changes, share one ranking.
    """
    group = group or []
    limits = sorted({abs(float(t)) for t in thresholds})
    key = [*group, "threshold_mm_per_year"]
    v = F.col(velocity)
    in_control = (v > -control) & (v < control)
    rows = points.select(*group, velocity, *exposures)
    long = explode_specs(rows, [{"threshold_mm_per_year": t} for t in limits])
    strong = v <= -F.col("threshold_mm_per_year")
    aggs = [F.count(F.lit(1)).alias("n_valid_points"), F.count_if(strong).alias("n_strong_points"),
            F.count_if(in_control).alias("n_control_points")]
    for e in exposures:
        aggs += [exposure_sum(e, strong).alias(f"strong_{e}"), exposure_sum(e).alias(f"_total_{e}")]
    base = long.groupBy(*key).agg(*aggs)
    shares = [ratio_null("n_strong_points", "n_valid_points").alias("strong_point_fraction")]
    for e in exposures:
        shares += [F.col(f"strong_{e}"), ratio_null(f"strong_{e}", f"_total_{e}").alias(f"strong_{e}_share")]
    base = base.select(*key, "n_valid_points", "n_strong_points", "n_control_points", *shares)
    values = [velocity, *exposures]
    # the control set carries the label -1, which is no threshold
    sets = F.filter(F.array(*[F.when(v <= -t, F.lit(t)) for t in limits], F.when(in_control, F.lit(-1.0))), lambda x: x.isNotNull())
    med = exact_quantiles_of(rows.withColumn("_set", F.explode(sets)), values, {"median": 0.5}, [*group, "_set"])
    names = [f"{c}_median" for c in values]
    is_control = F.col("_set") == -1.0
    of_strong = med.filter(~is_control).select(*group, F.col("_set").alias("threshold_mm_per_year"), *[F.col(n).alias(f"strong_{n}") for n in names])
    of_control = med.groupBy(*group).agg(*[F.max(F.when(is_control, F.col(n))).alias(f"control_{n}") for n in names])
    out = base.join(of_strong, key, "left")
    return out.join(of_control, group, "left") if group else with_scalars(out, of_control)


def closure_summary(points: DataFrame, lon: str, lat: str, velocity: str, exposures: tuple[str, str],
                    group: list[str] | None = None) -> DataFrame:
    """Row counts, velocity quantiles, totals and bounding box of a point product."""
    group = group or []
    xy = finite(lon) & finite(lat)
    ok = xy & finite(velocity)
    for e in exposures:
        ok = ok & finite(e)
    base = points.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_input_rows"), F.count_if(xy).alias("n_valid_xy_rows"),
        F.count_if(ok).alias("n_valid_closure_rows"),
        *[wsum(e, ok).alias(f"total_{e}") for e in exposures],
        *[f(F.when(xy, F.col(c))).alias(f"{c}_{n}") for c in (lon, lat) for n, f in (("min", F.min), ("max", F.max))],
    )
    q = exact_quantiles(points.filter(ok), velocity,
                        {"velocity_q05": 0.05, "velocity_median": 0.5, "velocity_q95": 0.95}, group)
    return attach(base, q, group, "left")


def landcover_rollup(df: DataFrame, region: str = "region", land: str = "landcover_group",
                     failures: str = "failure_count", trials: str = "n_pairs") -> DataFrame:
    """Per region and land cover, and per land cover over all regions (``ALL``)."""
    s, f, t = F.col("strong"), F.col(failures), F.col(trials)
    # sums per (region, land cover) first, so only those few rows are repeated for the grand total
    sums = df.groupBy(region, land).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s).alias("ns"), F.sum(f).alias("f"), F.sum(t).alias("t"),
        F.sum(F.when(s, f)).alias("fs"), F.sum(F.when(s, t)).alias("ts"), F.sum(F.when(~s, f)).alias("fn"), F.sum(F.when(~s, t)).alias("tn"),
    )
    rate = lambda a, b: ratio_null(F.sum(a), F.sum(b))
    g = sums.groupingSets([[region, land], [land]], region, land).agg(
        F.sum("n").alias("cells"), rate("ns", "n").alias("strong_share"), rate("f", "t").alias("failure_rate"),
        rate("fs", "ts").alias("strong_failure_rate"), rate("fn", "tn").alias("nonstrong_failure_rate"), F.grouping(region).alias("_all"),
    )
    g = g.withColumn(region, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(region).cast("string")))
    # one row per (region, land cover): the window is over a handful of rows per region
    frac = F.col("cells") / F.sum("cells").over(W.partitionBy(region))
    return g.select(region, land, "cells", frac.alias("cell_fraction_in_region"), "strong_share",
                    "failure_rate", "strong_failure_rate", "nonstrong_failure_rate")


def region_rollup(df: DataFrame, region: str, block: list[str], failures: str = "failure_count",
                  trials: str = "n_pairs", observed: str = "n_obs") -> DataFrame:
    """Per region and ALL: cells, distinct blocks, failure rates, means.

    Rows are first reduced to (region, block) sums, so the distinct count and the rollup work on
    blocks instead of cells.
    """
    s, f, t = F.col("strong"), F.col(failures), F.col(trials)
    per_block = df.groupBy(region, *block).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s).alias("ns"), F.sum(f).alias("f"), F.sum(t).alias("t"),
        F.sum(F.when(s, f)).alias("fs"), F.sum(F.when(s, t)).alias("ts"),
        F.sum(F.when(~s, f)).alias("fn"), F.sum(F.when(~s, t)).alias("tn"), F.sum(observed).alias("o"),
    )
    out = per_block.rollup(region).agg(
        F.sum("n").alias("n_cells"), F.count(F.lit(1)).alias("n_blocks"),
        ratio_null(F.sum("f"), F.sum("t")).alias("failure_rate"),
        ratio_null(F.sum("ns"), F.sum("n")).alias("strong_share"),
        ratio_null(F.sum("fs"), F.sum("ts")).alias("strong_failure_rate"),
        ratio_null(F.sum("fn"), F.sum("tn")).alias("nonstrong_failure_rate"),
        ratio_null(F.sum("o"), F.sum("n")).alias("mean_observable_pairs"),
        ratio_null(F.sum("t"), F.sum("n")).alias("mean_pairs"), F.grouping(region).alias("_all"),
    )
    name = F.when(F.col("_all") == 1, "ALL").otherwise(F.col(region).cast("string"))
    return out.withColumn(region, name).drop("_all")


def distribution_stats(df: DataFrame, value: str, group: list[str] | None = None,
                       below: tuple[float, ...] = (-5.0, -10.0), nearest: bool = False) -> DataFrame:
    """Count, extremes, mean, five quantiles and shares below limits, of finite values.

    Neither sorts nor stores the values.
    """
    group = group or []
    x, rows = F.col(value), df.filter(finite(value))
    share = lambda b: ratio_null(F.count_if(x < b), F.count(F.lit(1))).alias(f"fraction_lt_minus_{int(-b)}")
    base = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("finite_count"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"), *[share(b) for b in below])
    probs = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return attach(base, exact_quantiles(rows, value, probs, group, nearest), group, "left")


def zonal_stats(members: DataFrame, zone: list[str], value: str, window_pixels: Column | None = None,
                inside: str | None = None) -> DataFrame:
    """Statistics of the cells of each zone.

    ``window_pixels`` is the size of the zone's whole window (the denominator of coverage); by
    default the rows present. ``inside`` restricts the values to a mask flag. The members, a
    join, are produced once: they are counted per (zone, value, mask) and those counts are kept.
    """
    x, n = F.col("_x"), F.col("_n")
    mask = F.col(inside) if inside else F.lit(True)
    keyed = members.select(*zone, mask.alias("_in"), F.when(mask & finite(value), F.col(value)).alias("_x"),
                           (F.lit(None).cast("bigint") if window_pixels is None else window_pixels).alias("_w"))
    counts = cut(keyed.groupBy(*zone, "_in", "_x").agg(F.count(F.lit(1)).alias("_n"), F.max("_w").alias("_w")))
    valid = F.coalesce(F.sum(F.when(x.isNotNull(), n)), F.lit(0))
    total = F.sum(n) if window_pixels is None else F.max("_w")
    cols = [total.alias("window_pixels"), valid.alias("finite_pixels"), ratio0(valid, total).alias("coverage_fraction"),
            F.min(x).alias("min_value"), F.max(x).alias("max_value"), ratio_null(F.sum(x * n), valid).alias("mean_value"),
            ratio_null(F.sum(F.when(x > 0, n).when(x.isNotNull(), F.lit(0))), valid).alias("positive_fraction")]
    if inside:
        cols.insert(1, F.coalesce(F.sum(F.when(F.col("_in"), n)), F.lit(0)).alias("mask_pixels"))
    med = exact_quantiles(counts, "_x", {"median_value": 0.5}, zone, count="_n")
    return attach(counts.groupBy(*zone).agg(*cols), med, zone, "left")


def fold_vs_global(cells: DataFrame, zone: list[str], layers: list[str]) -> DataFrame:
    """Zone mean over global mean for each layer, then mean and median over layers."""
    glob = cells.agg(*[F.avg(F.when(finite(v), F.col(v))).alias(f"_g_{v}") for v in layers])
    zones = cells.groupBy(*zone).agg(*[F.avg(F.when(finite(v), F.col(v))).alias(v) for v in layers])
    wide = with_scalars(zones, glob)
    folds = F.filter(
        F.array(*[F.when(F.col(f"_g_{v}") > 0, F.col(v) / F.col(f"_g_{v}")) for v in layers]), lambda x: x.isNotNull()
    )
    long = wide.withColumn("_f", F.explode_outer(folds))
    return long.groupBy(*zone).agg(
        F.count("_f").alias("n_layers"), F.avg("_f").alias("mean_fold"), F.percentile("_f", F.lit(0.5)).alias("median_fold")
    )


def network_exposure(points: DataFrame, grid: geo.Grid, cells: DataFrame, cell_key: str, row: str, column: str,
                     obs: DataFrame, pair: str, category: str = "category", threshold: float = 0.3, slack: float = 0.0) -> DataFrame:
    """Kilometres valid / strong / hidden-strong by (pair, category) and in total.

    Lengths are summed per (cell, category) before any join, so a busy cell is one row. Only
    coherent observations are joined: what a pair hides is the strong length less what it sees.
    """
    length = (
        points.withColumn(row, geo.row_index(grid, "mid_lat")).withColumn(column, geo.col_index(grid, "mid_lon"))
        .filter(F.col(row).isNotNull() & F.col(column).isNotNull() & F.col(category).isNotNull())
        .groupBy(row, column, category).agg(F.sum("km").alias("km"))
    )
    on_cells = length.join(cells.filter("base").select(cell_key, row, column, "strong"), [row, column])
    both = on_cells.withColumn(category, F.explode(F.array(F.col(category), F.lit("transport_total"))))
    totals = both.groupBy(category).agg(
        F.sum("km").alias("transport_km_valid"), wsum("km", F.col("strong")).alias("transport_km_strong_subsidence")
    )
    seen = (
        on_cells.filter("strong").groupBy(cell_key, category).agg(F.sum("km").alias("km"))
        .join(obs.filter(coherent("coherence", threshold, slack)).select(cell_key, pair), cell_key)
        .withColumn(category, F.explode(F.array(F.col(category), F.lit("transport_total"))))
        .groupBy(pair, category).agg(F.sum("km").alias("_seen"))
    )
    # the list of pairs is as long as the stack is deep, a fixed small number
    pairs = obs.agg(F.collect_set(pair).alias("_pairs"))
    grid_rows = with_scalars(totals, pairs).withColumn(pair, F.explode("_pairs")).drop("_pairs")
    out = grid_rows.join(seen, [pair, category], "left")
    hidden = F.col("transport_km_strong_subsidence") - F.coalesce(F.col("_seen"), F.lit(0.0))
    return out.select(
        pair, category, "transport_km_valid", "transport_km_strong_subsidence",
        F.greatest(hidden, F.lit(0.0)).alias("transport_km_hidden_strong_subsidence"),
        ratio0(F.greatest(hidden, F.lit(0.0)), "transport_km_strong_subsidence")
        .alias("hidden_strong_subsidence_transport_fraction"),
    )


def argmax_by(df: DataFrame, group: list[str], name: str, score: str, order: str) -> DataFrame:
    """Name and score of the best row per group; the first in ``order`` wins ties."""
    best = F.max_by(F.struct(name, score), F.struct(F.col(score), -F.col(order)))
    return df.filter(finite(score)).groupBy(*group).agg(best.alias("_b")).select(*group, f"_b.{name}", f"_b.{score}")


def budget_ranking(cells: DataFrame, key: str, exposure: str, budgets: list[int],
                   strong: str = "strong", hidden: str = "hidden") -> DataFrame:
    """Two top-k lists at each budget: all strong cells, and only those the product sees.

    Only the largest budget of rows is ever ranked (a distributed top-k), so the lists and their
    overlap stay as small as the budget.
    """
    top, widest = F.col(exposure).desc_nulls_last(), max(budgets)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(top, F.col(key)))
    pool = cells.filter(F.col(strong)).select(key, exposure, hidden)
    lists = []
    for name, part in (("aware", pool), ("visible", pool.filter(~F.col(hidden)))):
        best = part.orderBy(top, F.col(key)).limit(widest)
        lists.append(best.select(key, F.col(exposure).alias(f"_x_{name}"), F.col(hidden).alias(f"_h_{name}"), rank.alias(f"_{name}")))
    both = lists[0].join(lists[1], key, "full")
    long = explode_specs(both, [{"budget_cells": int(b)} for b in budgets])
    a = F.coalesce(F.col("_aware") <= F.col("budget_cells"), F.lit(False))
    v = F.coalesce(F.col("_visible") <= F.col("budget_cells"), F.lit(False))
    ha, hv = F.col("_h_aware"), F.col("_h_visible")
    out = long.groupBy("budget_cells").agg(
        F.count_if(a & v).alias("overlap_cells"), F.count_if(a & ~v).alias("aware_only_cells"),
        F.count_if(v & ~a).alias("visible_only_cells"),
        wsum("_x_aware", a).alias("aware_top_total_exposure"), wsum("_x_visible", v).alias("visible_top_total_exposure"),
        wsum("_x_aware", a & ha).alias("aware_top_hidden_exposure"), wsum("_x_visible", v & hv).alias("visible_top_hidden_exposure"),
        wsum("_x_aware", a & ~v & ha).alias("aware_only_hidden_exposure"),
        wsum("_x_visible", v & ~a & hv).alias("visible_only_hidden_exposure"),
    )
    return out.withColumn("overlap_fraction", F.col("overlap_cells") / F.col("budget_cells")).withColumn(
        "hidden_exposure_gain_aware_minus_visible", F.col("aware_top_hidden_exposure") - F.col("visible_top_hidden_exposure")
    )


def hidden_amounts(df: DataFrame, strong_amount: str, hidden_fraction: str, not_majority: str) -> DataFrame:
    return df.withColumn("hidden_amount", F.col(strong_amount) * F.col(hidden_fraction)).withColumn(
        "observable_fraction", F.lit(1.0) - F.col(not_majority)
    )


def weighted_odds_ratio(df: DataFrame, odds: str, weights: dict[str, str], group: list[str] | None = None) -> DataFrame:
    """Weighted geometric mean of odds ratios under several weightings."""
    base = df.withColumn("_l", F.log(F.col(odds)))
    return base.groupBy(*(group or [])).agg(*[F.exp(wmean("_l", w)).alias(n) for n, w in weights.items()])
