"""Pooling of effect estimates over studies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import Z95
from ..runtime import attach, cut


def _between_variance(s0: Column, s1: Column, s2: Column, sw2: Column, k: Column) -> dict[str, Column]:
    """Fixed effect, Q, tau2 and I2 from sums of w, wy, wy2, w2."""
    fixed = s1 / s0
    q = F.greatest(F.lit(0.0), s2 - s1 * s1 / s0)
    df = F.greatest(k - 1, F.lit(1)).cast("double")
    c = s0 - sw2 / s0
    tau2 = F.when(c > 0, F.greatest(F.lit(0.0), (q - df) / c)).otherwise(F.lit(0.0))
    i2 = F.when(q > 0, F.greatest(F.lit(0.0), (q - df) / q)).otherwise(F.lit(0.0))
    return {"fixed": fixed, "q": q, "df": df, "tau2": tau2, "i2": i2}


def _or_with_limits(prefix: str, log_or: Column, se: Column) -> list[Column]:
    return [
        log_or.alias(f"{prefix}_log_or"), F.exp(log_or).alias(f"{prefix}_or"),
        F.exp(log_or - Z95 * se).alias(f"{prefix}_ci_low"), F.exp(log_or + Z95 * se).alias(f"{prefix}_ci_high"),
    ]


def pooled_effects(studies: DataFrame, y: str = "log_or", v: str = "var", group: list[str] | None = None) -> DataFrame:
    """Inverse-variance fixed effect and random effects with the moment estimate of tau2."""
    group = group or []
    w = F.lit(1.0) / F.col(v)
    sums = studies.groupBy(*group).agg(
        F.count(F.lit(1)).alias("k"), F.sum(w).alias("_s0"), F.sum(w * F.col(y)).alias("_s1"),
        F.sum(w * F.col(y) * F.col(y)).alias("_s2"), F.sum(w * w).alias("_sw2"),
    )
    parts = _between_variance(*[F.col(c) for c in ("_s0", "_s1", "_s2", "_sw2", "k")])
    first = sums.select(*group, "k", "_s0", *[e.alias(n) for n, e in parts.items()])
    wr = F.lit(1.0) / (F.col(v) + F.col("tau2"))
    second = attach(studies.select(*group, y, v), first.select(*group, "tau2"), group).groupBy(*group).agg(
        F.sum(wr).alias("_r0"), F.sum(wr * F.col(y)).alias("_r1")
    )
    return attach(first, second, group).select(
        *group, "k", *_or_with_limits("fixed", F.col("fixed"), F.sqrt(1.0 / F.col("_s0"))),
        *_or_with_limits("random", F.col("_r1") / F.col("_r0"), F.sqrt(1.0 / F.col("_r0"))), "q", "tau2", "i2", "df",
    )


def pooled_subsets(studies: DataFrame, subsets: dict[str, Column], y: str = "log_or", v: str = "var") -> DataFrame:
    """Pooled effects of named, possibly overlapping subsets in one job."""
    tags = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in subsets.items()]), lambda t: t.isNotNull())
    return pooled_effects(studies.withColumn("subset", F.explode(tags)), y, v, ["subset"])


#: Studies of one tile of the leave-one-out pair sum.
TILE = 2048


def _pair_sums(homes: pa.Table, others: pa.Table) -> pa.Table:
    """Random-effects weights of one tile of studies at the tau2 of each study of another, the study itself left out."""
    ids, tau2 = homes.column("_id").to_numpy(), homes.column("tau2").to_numpy()
    r0, r1 = np.zeros(len(ids)), np.zeros(len(ids))
    if len(ids) and others.num_rows:
        ids2, y, v = (others.column(c).to_numpy() for c in ("_id2", "_y2", "_v2"))
        for at in range(0, len(ids), 256):
            w = 1.0 / (v[None, :] + tau2[at : at + 256, None])
            w[ids[at : at + 256, None] == ids2[None, :]] = 0.0
            r0[at : at + 256], r1[at : at + 256] = w.sum(axis=1), w @ y
    return pa.table({"_id": ids, "_r0": r0, "_r1": r1})


def pooled_without_each(studies: DataFrame, key: str, y: str = "log_or", v: str = "var",
                        group: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """Random-effects pooling with each study left out.

    The heterogeneity step is totals less the study's own terms. The second step needs the weights of all the
    other studies at each study's tau2, a sum over pairs: the studies of a group are dealt into tiles, pairs of tiles are
    summed on their own and added by study, so no row or task holds a whole group. ``key`` may repeat: each row is a
    study. A group of one study has no others; its pooled figures are NULL.
    """
    group = group or []
    w = F.lit(1.0) / F.col(v)
    rows = cut(studies.select(*group, key, F.col(y).cast("double").alias(y), F.col(v).cast("double").alias(v)).withColumn("_id", F.monotonically_increasing_id()))
    terms = rows.select("*", w.alias("_w"), (w * F.col(y)).alias("_wy"), (w * F.col(y) * F.col(y)).alias("_wyy"), (w * w).alias("_ww"))
    tot = terms.groupBy(*group).agg(F.count(F.lit(1)).alias("_k"), *[F.sum(c).alias(f"_t{c}") for c in ("_w", "_wy", "_wyy", "_ww")])
    less = attach(terms, tot, group)
    rest = [F.col(f"_t{c}") - F.col(c) for c in ("_w", "_wy", "_wyy", "_ww")]
    parts = _between_variance(*rest, F.col("_k") - 1)
    less = cut(less.filter("_k > 1").select(*group, key, "_id", y, v, "_k", parts["tau2"].alias("tau2"), parts["i2"].alias("i2")))
    tiles = F.ceil(F.col("_k") / tile).cast("int")
    of = F.pmod(F.xxhash64("_id"), tiles).cast("int")
    every = F.explode(F.sequence(F.lit(0), tiles - 1))
    name = F.to_json(F.struct(*[F.col(g) for g in group])) if group else F.lit("")
    homes = less.select(name.alias("_g"), of.alias("_i"), every.alias("_j"), "_id", "tau2")
    others = less.select(name.alias("_g2"), every.alias("_i2"), of.alias("_j2"), F.col("_id").alias("_id2"), F.col(y).alias("_y2"), F.col(v).alias("_v2"))
    pairs = homes.groupBy("_g", "_i", "_j").cogroup(others.groupBy("_g2", "_i2", "_j2")).applyInArrow(_pair_sums, "_id long, _r0 double, _r1 double")
    sums = pairs.groupBy("_id").agg(F.sum("_r0").alias("_r0"), F.sum("_r1").alias("_r1"))
    alone = attach(terms, tot, group).filter("_k = 1").select(*group, key, F.lit(None).cast("double").alias("_r0"), F.lit(None).cast("double").alias("_r1"), F.lit(0.0).alias("tau2"), F.lit(0.0).alias("i2"))
    out = less.join(sums, "_id").select(*group, key, "_r0", "_r1", "tau2", "i2").unionByName(alone)
    effect, se = F.col("_r1") / F.col("_r0"), F.sqrt(1.0 / F.col("_r0"))
    return out.select(
        *group, F.col(key).alias("left_out"), F.exp(effect).alias("pooled_random_or"),
        F.exp(effect - Z95 * se).alias("pooled_random_ci_low"), F.exp(effect + Z95 * se).alias("pooled_random_ci_high"), "tau2", "i2",
    )


def substitute_estimate(studies: DataFrame, anchors: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Replace the estimate of the studies named in ``anchors``; others keep theirs."""
    side = anchors.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns])
    keep = [c for c in studies.columns if c not in columns]
    joined = studies.join(side, key, "left")
    return joined.select(*keep, *[F.coalesce(F.col(f"_a_{c}"), F.col(c)).alias(c) for c in columns],
                         F.col(f"_a_{columns[0]}").isNotNull().cast("double").alias("cell_level"))


def share_above_one(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Share of finite values above 1, with extremes and mean."""
    x = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    return df.groupBy(*(group or [])).agg(
        F.avg(F.when(x.isNotNull(), (x > 1).cast("double"))).alias("share_gt_one"), F.min(x).alias("min_value"),
        F.avg(x).alias("mean_value"), F.max(x).alias("max_value"), F.max(F.abs(F.log(x))).alias("max_abs_log"),
    )
