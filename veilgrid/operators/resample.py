"""Resampling on additive statistics: bootstrap, sweeps, placebo, Monte Carlo.

Cells are reduced to sums before anything is repeated, so replicates multiply a small table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import draw_uniform, hash32
from ..functions.geo import block_row
from ..functions.numeric import exposure_sum, haldane_or, ratio0, wsum
from ..runtime import attach, cut, explode_specs, small_side, spread, with_scalars
from . import blockdraws
from .ordering import bounded_quantiles

STATS = ["strong_cells", "strong_not_majority", "strong_majority", "nonstrong_cells", "nonstrong_not_majority",
         "nonstrong_majority", "strong_pop", "strong_pop_not_majority", "strong_built", "strong_built_not_majority"]
METRICS = ["strong_not_majority_fraction", "strong_population_not_majority_fraction",
           "strong_builtup_not_majority_fraction", "strong_vs_nonstrong_not_majority_odds_ratio"]
INTERVAL = {"q025": 0.025, "q50": 0.5, "q975": 0.975}


def stat_columns(strong: Column, majority: Column, population: str, builtup: str) -> list[Column]:
    """The ten additive statistics of a set of usable cells."""
    hidden = strong & ~majority
    return [
        F.count_if(strong).alias("strong_cells"), F.count_if(hidden).alias("strong_not_majority"),
        F.count_if(strong & majority).alias("strong_majority"), F.count_if(~strong).alias("nonstrong_cells"),
        F.count_if(~strong & ~majority).alias("nonstrong_not_majority"),
        F.count_if(~strong & majority).alias("nonstrong_majority"),
        exposure_sum(population, strong).alias("strong_pop"), exposure_sum(population, hidden).alias("strong_pop_not_majority"),
        exposure_sum(builtup, strong).alias("strong_built"), exposure_sum(builtup, hidden).alias("strong_built_not_majority"),
    ]


def block_stats(cells: DataFrame, row: str, column: str, size: int, group: list[str] | None = None,
                population: str = "population", builtup: str = "builtup_m2", shift: int = 0) -> DataFrame:
    """Statistics per spatial block of usable cells; blocks without cells do not appear."""
    b = cells.filter("base").withColumn("block_row", block_row(row, size, shift)).withColumn(
        "block_col", block_row(column, size, shift)
    )
    return b.groupBy(*(group or []), "block_row", "block_col").agg(
        *stat_columns(F.col("strong"), F.col("majority"), population, builtup)
    )


def resum(stats: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    return stats.groupBy(*keys).agg(*[F.sum(F.col(s) * w).alias(s) for s in STATS])


def metrics(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Three hidden fractions and the odds ratio from summed statistics."""
    return totals.select(
        *keys,
        ratio0("strong_not_majority", "strong_cells").alias(METRICS[0]),
        ratio0("strong_pop_not_majority", "strong_pop").alias(METRICS[1]),
        ratio0("strong_built_not_majority", "strong_built").alias(METRICS[2]),
        haldane_or("strong_not_majority", "strong_majority", "nonstrong_not_majority", "nonstrong_majority").alias(METRICS[3]),
    )


def bootstrap_blocks(stats: DataFrame, group: list[str], reps: int, seed: int,
                     order: list | None = None) -> DataFrame:
    """Block bootstrap of the four metrics: one row per (group, rep).

    A replicate draws as many blocks as its group has, with replacement; draws are counted by block and never become rows.
    """
    blocks, groups = blockdraws.numbered(stats, order or ["block_row", "block_col"], group, seed)
    drawn = blockdraws.sums(blocks, groups, reps, STATS).withColumnRenamed("_rep", "rep")
    return metrics(drawn.join(small_side(groups, groups.count()), "_gid"), [*group, "rep"])


def interval_columns(names: list[str]) -> list[Column]:
    """Quantiles and mean over replicates (their number is a parameter, so groups are bounded)."""
    out = []
    for m in names:
        out += [*bounded_quantiles(m, {f"{m}_{n}": p for n, p in INTERVAL.items()}), F.avg(m).alias(f"{m}_boot_mean")]
    return out


def bootstrap_table(stats: DataFrame, group: list[str], reps: int, seed: int) -> DataFrame:
    """Observed metrics, their bootstrap quantiles and the number of blocks, per group."""
    stats = cut(stats)
    observed = metrics(resum(stats, group), group)
    n = stats.groupBy(*group).agg(F.count(F.lit(1)).alias("n_blocks"))
    boot = bootstrap_blocks(stats, group, reps, seed).groupBy(*group).agg(*interval_columns(METRICS))
    return attach(attach(observed, n, group), boot, group).withColumn("n_bootstrap", F.lit(reps))


def robustness_sweep(cells: DataFrame, counts: dict[float, str], strong_thresholds: list[float],
                     block_sizes: list[int], n_pairs: int, reps: int, seed: int, row: str, column: str,
                     velocity: str = "vlm_mm_yr", population: str = "population",
                     builtup: str = "builtup_m2") -> DataFrame:
    """Coherence x strong threshold x block size, each with its own block bootstrap.

    Cells are summed once to blocks of the greatest common size; larger blocks are sums of those.
    ``counts`` names the count column of each coherence threshold. Cells are shuffled once, by squares that
    hold whole blocks of every size if those are not much larger than the largest block, before they are repeated.
    """
    unit, home = reduce(math.gcd, block_sizes), math.lcm(*block_sizes)
    whole = home <= 4 * max(block_sizes)
    need = math.ceil(n_pairs / 2)
    base = cells.filter("base").withColumn("_br", block_row(row, unit)).withColumn("_bc", block_row(column, unit))
    hits = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col(c) >= need).alias("_maj")) for t, c in counts.items()])
    near = ["_hr", "_hc"] if whole else ["_br", "_bc"]
    base = base.withColumn("_h", hits).withColumn("_hr", block_row(row, home)).withColumn("_hc", block_row(column, home))
    base = base.select(*dict.fromkeys([*near, "_br", "_bc"]), "_h", velocity, population, builtup).repartition(*near)
    long = base.withColumn("_h", F.explode("_h")).select(*dict.fromkeys([*near, "_br", "_bc"]), "_h.*", velocity, population, builtup)
    long = explode_specs(long, [{"strong_threshold": float(s)} for s in strong_thresholds])
    keys = ["threshold", "strong_threshold"]
    small = long.groupBy(*keys, *dict.fromkeys([*near, "_br", "_bc"])).agg(
        *stat_columns(F.col(velocity) <= -F.col("strong_threshold"), F.col("_maj"), population, builtup)
    )
    sized = explode_specs(small, [{"block_size": int(b)} for b in block_sizes])
    step = F.col("block_size") / F.lit(float(unit))
    sized = sized.withColumn("block_row", F.floor(F.col("_br") / step)).withColumn("block_col", F.floor(F.col("_bc") / step))
    group = [*keys, "block_size"]
    blocks = resum(sized, [*group, *(near if whole else []), "block_row", "block_col"]).drop(*near)
    return bootstrap_table(blocks, group, reps, seed).withColumn("n_pairs", F.lit(n_pairs))


def support_cube(cells: DataFrame, velocity_key: Column, count: str, population: str, builtup: str) -> DataFrame:
    """Cells summed by a discrete velocity key and the number of good observations."""
    return cells.filter("base").groupBy(velocity_key.alias("vkey"), F.col(count).alias("n_obs")).agg(
        F.count(F.lit(1)).alias("cells"), exposure_sum(population).alias("pop"), exposure_sum(builtup).alias("built"),
    )


def threshold_surface(cells: DataFrame, deformation: list[float], fractions: list[float], min_counts: list[int],
                      n_pairs: int, velocity: str = "vlm_mm_yr", count: str = "n_obs",
                      population: str = "population", builtup: str = "builtup_m2") -> DataFrame:
    """Every (deformation, fraction, minimum count) rule on one small cube.

    A strong cell is hidden if its fraction is under the limit or its count under the minimum.
    """
    met = sum(((F.col(velocity) <= -float(d)).cast("int") for d in deformation), F.lit(0))
    cube = support_cube(cells, met, count, population, builtup)
    specs = [{"deformation_abs_threshold_mm_yr": float(d), "need": sum(d2 <= d for d2 in deformation),
              "observability_fraction_threshold": float(f), "min_observable_count": int(m)}
             for d in deformation for f in fractions for m in min_counts]
    for run, s in enumerate(specs):
        s["run"] = run
    long = explode_specs(cube, specs)
    strong = F.col("vkey") >= F.col("need")
    hid = strong & ((F.col("n_obs") / float(n_pairs) < F.col("observability_fraction_threshold"))
                    | (F.col("n_obs") < F.col("min_observable_count")))
    keys = ["run", "deformation_abs_threshold_mm_yr", "observability_fraction_threshold", "min_observable_count"]
    count_in = lambda m: F.coalesce(F.sum(F.when(m, F.col("cells"))), F.lit(0)).cast("bigint")
    return long.groupBy(*keys).agg(
        count_in(strong).alias("strong_cells"), count_in(hid).alias("hidden_strong_cells"),
        wsum("pop", strong).alias("strong_population"), wsum("pop", hid).alias("hidden_population"),
        ratio0(wsum("pop", hid), wsum("pop", strong)).alias("hidden_population_fraction"),
        (wsum("built", strong) / 1e6).alias("strong_builtup_km2"), (wsum("built", hid) / 1e6).alias("hidden_builtup_km2"),
        ratio0(wsum("built", hid), wsum("built", strong)).alias("hidden_builtup_fraction"),
    )


def shifted_blocks(cells: DataFrame, row: str, column: str, sizes: list[int], population: str = "population",
                   builtup: str = "builtup_m2") -> DataFrame:
    """Hidden shares under several block sizes and two origins (unshifted, shifted by half)."""
    specs = [{"block_size": b, "origin_shift": s} for b in sizes for s in (0, b // 2)]
    strong = cells.filter(F.col("base") & F.col("strong")).select(row, column, "majority", population, builtup)
    long = explode_specs(strong, specs)
    at = lambda c: F.floor((F.col(c) + F.col("origin_shift")) / F.col("block_size"))
    hidden = ~F.col("majority")
    blocks = long.groupBy("block_size", "origin_shift", at(row).alias("_br"), at(column).alias("_bc")).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(hidden).alias("hid"),
        exposure_sum(population).alias("pop"), exposure_sum(population, hidden).alias("pop_h"),
        exposure_sum(builtup).alias("built"), exposure_sum(builtup, hidden).alias("built_h"),
    )
    return blocks.groupBy("block_size", "origin_shift").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("cells").alias("strong_cells"), F.sum("hid").alias("hidden_cells"),
        ratio0(F.sum("pop_h"), F.sum("pop")).alias("strong_hidden_population_fraction"),
        ratio0(F.sum("built_h"), F.sum("built")).alias("strong_hidden_builtup_fraction"),
        F.avg(F.col("hid") / F.col("cells")).alias("mean_block_hidden_share"),
    )


def permuted_sums(rows: DataFrame, key: str, label: str, sums: dict[str, Column], reps: int, seed: int,
                  stratum: str, by: list[str] | None = None, bits: int | None = None) -> DataFrame:
    """Shuffle a label inside strata and sum columns over the rows that get it.

    ``by`` names separate null models, each with its own strata and draws; the result has one row
    per (by, rep). A shuffle gives the label to the k rows of the stratum with the smallest
    (hash, key). Only the k-th place needs an order: hashes are cut into 2^bits buckets, whole
    buckets below the place are summed with map-side combining, and just the bucket that holds it
    is sorted. By default a stratum of n rows has about sqrt(n) buckets of sqrt(n) rows, so no
    task ever sorts a stratum and the table of buckets stays small.
    """
    by = by or []
    strata = [*by, stratum]
    fine = F.lit(bits) if bits is not None else F.least(F.lit(24), F.greatest(F.lit(1), F.ceil(F.log2(F.col("_n")) / 2)))
    need = rows.groupBy(*strata).agg(F.count_if(F.col(label)).alias("_k"), F.count(F.lit(1)).alias("_n"))
    # the numbers given to strata are frozen with the table, so every later read agrees on them
    need = cut(need.withColumn("_sid", F.monotonically_increasing_id()).withColumn("_bits", fine.cast("int")))
    count = need.count()
    keyed = rows.join(small_side(need.select(*strata, "_sid", "_bits"), count), strata)
    slim = keyed.select(key, *by, "_sid", "_bits", *[c.alias(n) for n, c in sums.items()])
    names = list(sums)
    shots = (
        spread(slim).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        .withColumn("_h", hash32(seed, *[F.col(b) for b in by], F.col("rep"), F.col(key)))
        .withColumn("_b", F.expr("shiftright(_h, 32 - _bits)"))
        .select(key, "_sid", "rep", "_h", "_b", *names)
    )
    group = ["rep", "_sid"]
    coarse = shots.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(n).alias(n) for n in names])
    w = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    coarse = cut(coarse.withColumn("_cum", F.sum("_c").over(w)).join(small_side(need.select("_sid", "_k"), count), "_sid"))
    whole = coarse.filter("_cum <= _k").groupBy(*group).agg(*[F.sum(n).alias(n) for n in names])
    place = coarse.filter("_cum > _k AND _cum - _c < _k").select(
        *group, "_b", (F.col("_k") - F.col("_cum") + F.col("_c")).alias("_take")
    )
    edge = shots.join(small_side(place, place.count()), [*group, "_b"])
    rank = F.row_number().over(W.partitionBy(*group).orderBy("_h", key))
    part = edge.withColumn("_r", rank).filter("_r <= _take").select(*group, *names)
    drawn = whole.unionByName(part).join(small_side(need.select("_sid", *by), count), "_sid")
    return drawn.groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names])


def null_summary(draws: DataFrame, value: str, observed: str, group: list[str] | None = None) -> DataFrame:
    """Observed value against a null sample: mean, 95 % range, two-sided empirical p.

    One row per draw, each carrying the observed value of its group.
    """
    stats = draws.groupBy(*(group or [])).agg(
        F.max(observed).alias("observed"), F.avg(value).alias("null_mean"),
        *bounded_quantiles(value, {"null_q025": 0.025, "null_q975": 0.975}),
        F.count_if(F.col(value) >= F.col(observed)).alias("_ge"),
        F.count_if(F.col(value) <= F.col(observed)).alias("_le"), F.count(F.lit(1)).alias("n_reps"),
    )
    p = 2.0 * (F.least("_ge", "_le") + 1) / (F.col("n_reps") + 1)
    return stats.withColumn("two_sided_empirical_p", F.least(F.lit(1.0), p)).drop("_ge", "_le")


def monte_carlo(cells: DataFrame, iterations: int, seed: int, n_pairs: int, velocity_range: tuple[float, float],
                count_range: tuple[int, int], scale_range: tuple[float, float], bin_mm: float = 0.01,
                velocity: str = "vlm_mm_yr", count: str = "n_obs", population: str = "population",
                builtup: str = "builtup_m2") -> DataFrame:
    """Hidden totals under random thresholds and exposure scales: one row per iteration.

    Each cell is placed between the neighbouring thresholds of all iterations, exactly: bins of ``bin_mm`` find the few
    thresholds near its velocity, which are then compared one by one. Cells so become a cube of (place, observation
    count), whose size follows the iterations, and a running sum over places answers every scenario.
    """
    lo, hi = velocity_range
    c_lo, c_hi = count_range
    spark = cells.sparkSession
    u = lambda name: draw_uniform(seed, name, F.col("iteration"))
    scen = spark.range(iterations).withColumnRenamed("id", "iteration").select(
        "iteration", (F.lit(lo) + u("threshold") * (hi - lo)).alias("threshold"),
        (F.lit(c_lo) + F.floor(u("count") * (c_hi - c_lo + 1))).cast("int").alias("cut"),
        (F.lit(scale_range[0]) + u("scale") * (scale_range[1] - scale_range[0])).alias("scale"),
    )
    # place = number of thresholds at or under a value; these windows hold ``iterations`` rows, a parameter
    everything = W.partitionBy(F.lit(0)).orderBy("threshold")
    scen = cut(scen.withColumn("place", F.count(F.lit(1)).over(everything.rangeBetween(W.unboundedPreceding, W.currentRow))))
    bin_of = lambda v: F.floor(v / bin_mm)
    bins = scen.groupBy(bin_of(F.col("threshold")).alias("bin")).agg(F.collect_list("threshold").alias("_near"), F.count(F.lit(1)).alias("_m"))
    bins = spark.range(math.floor(lo / bin_mm), math.floor(hi / bin_mm) + 2).withColumnRenamed("id", "bin").join(bins, "bin", "left")
    under = F.coalesce(F.sum("_m").over(W.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("bin", under.alias("_under"), F.coalesce("_near", F.array().cast("array<double>")).alias("_near"))
    fast = cells.filter(F.col("base") & (F.col(velocity) <= -lo)).select(
        (-F.col(velocity)).alias("_a"), F.lit(True).alias("base"), count, population, builtup)
    keyed = fast.withColumn("bin", F.least(bin_of(F.col("_a")), F.lit(math.floor(hi / bin_mm) + 1).cast("bigint")))
    placed = keyed.join(F.broadcast(bins), "bin")  # a row a bin and the thresholds, both set by parameters
    place = F.col("_under") + F.size(F.filter("_near", lambda t: t <= F.col("_a")))
    cube = support_cube(placed, place, count, population, builtup)
    cuts = cube.withColumn("cut", F.explode(F.sequence(F.lit(c_lo), F.lit(c_hi)))).filter(F.col("n_obs") < F.col("cut"))
    sums = cuts.groupBy("cut", F.col("vkey").alias("place")).agg(F.sum("pop").alias("pop"), F.sum("built").alias("built"))
    # scenarios and places in one order, highest first: a scenario sees all places at or over its own
    rows = scen.unionByName(sums, allowMissingColumns=True)
    w = W.partitionBy("cut").orderBy(F.col("place").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    seen = rows.select("iteration", "threshold", "cut", "scale", *[F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(c) for c in ("pop", "built")])
    return seen.filter("iteration is not null").select(
        "iteration", "threshold", F.col("cut").alias("min_count"), "scale",
        (F.col("pop") * F.col("scale")).alias("hidden_population"),
        (F.col("built") * F.col("scale") / 1e6).alias("hidden_builtup_km2"),
    )
