"""Global order at scale: ranks, running totals, exact quantiles.

A window without PARTITION BY, or over a group that holds most rows, runs in one task. Here the
rows are range-partitioned on (group, order keys), frozen once, and numbered inside each
partition; a table of at most (#partitions + #groups) offsets lifts the local numbers to global
ones. No task ever holds a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..runtime import attach_to_rows, cut, small_side, with_scalars

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _sorted_parts(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """Range-partitioned, locally sorted rows with partition number and local position."""
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_mid", F.monotonically_increasing_id()
    )
    return cut(
        out.withColumn("_pid", F.shiftright("_mid", _ROW_BITS))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_mid")
    )


def _before(parts: DataFrame, group: list[str], size: Column) -> DataFrame:
    """Per (group, partition): total before this partition, first local position, group total.

    At most #partitions + #groups rows; broadcast to the frozen rows only if that count is small.
    """
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    stats = parts.groupBy(*group, "_pid").agg(size.alias("_here"), F.min("_pos").alias("_first"))
    offs = cut(stats.select(
        *group, "_pid", "_first",
        (F.sum("_here").over(w.orderBy("_pid")) - F.col("_here")).alias("_off"),
        F.sum("_here").over(w).alias("_total"),
    ))
    return small_side(offs, offs.count())


def global_rank(df: DataFrame, order: list, group: list[str] | None = None,
                out: str = "rank", total: str | None = None) -> DataFrame:
    """Add a gap-free rank from 1 by ``order`` inside each ``group``.

    ``order`` must end in a unique key. ``total`` also adds the size of the group.
    """
    group = group or []
    parts = _sorted_parts(df, group, order)
    offs = _before(parts, group, F.count(F.lit(1)))
    ranked = parts.join(offs, [*group, "_pid"])
    cols = [F.col(c) for c in df.columns]
    cols.append((F.col("_off") + F.col("_pos") - F.col("_first") + 1).alias(out))
    if total:
        cols.append(F.col("_total").alias(total))
    return ranked.select(*cols)


def running_total(df: DataFrame, order: list, weight: str, group: list[str] | None = None,
                  out: str = "running", total: str | None = None) -> DataFrame:
    """Add the inclusive running sum of ``weight`` by ``order`` inside each ``group``."""
    group = group or []
    parts = _sorted_parts(df, group, order)
    offs = _before(parts, group, F.sum(weight))
    local = W.partitionBy(*group, "_pid").orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = parts.withColumn("_run", F.sum(weight).over(local)).join(offs, [*group, "_pid"])
    cols = [F.col(c) for c in df.columns] + [(F.col("_off") + F.col("_run")).alias(out)]
    if total:
        cols.append(F.col("_total").alias(total))
    return summed.select(*cols)


def with_next(df: DataFrame, group: list[str], order: list[str], cols: dict[str, str]) -> DataFrame:
    """LEAD(1) inside each group for groups of any length; ``cols`` maps source to new names.

    Neighbours inside a range partition come from a window over that partition only; the one
    pair that spans two partitions is looked up in a table of first rows (one per partition).
    """
    parts = _sorted_parts(df, group, order)
    w = W.partitionBy("_pid").orderBy("_pos")
    here = F.struct(*group, *cols)
    heads = parts.groupBy("_pid").agg(F.min_by(here, "_pos").alias("_head"))
    heads = heads.select(
        "_pid", F.lead("_head").over(W.partitionBy(F.lit(0)).orderBy("_pid")).alias("_head")
    )
    nxt = F.coalesce(F.lead(here).over(w), F.col("_head"))
    same = [F.col("_next")[g].eqNullSafe(F.col(g)) for g in group]
    joined = parts.join(F.broadcast(heads), "_pid").withColumn("_next", nxt)
    ok = reduce(lambda a, b: a & b, same, F.lit(True))
    return joined.select(
        *df.columns, *[F.when(ok, F.col("_next")[c]).alias(n) for c, n in cols.items()]
    )


def ntile_of(rank: Column | str, total: Column | str, k: int) -> Column:
    """SQL NTILE(k) from a rank (from 1) and the group size: larger tiles come first."""
    r = (F.col(rank) if isinstance(rank, str) else rank) - 1
    n = F.col(total) if isinstance(total, str) else total
    small = F.floor(n / k)
    extra = n % k
    head = extra * (small + 1)
    return (
        F.when(r < head, F.floor(r / (small + 1)))
        .otherwise(extra + F.floor(F.try_divide(r - head, small)))
        .cast("bigint") + 1
    )


def _quantile_exprs(value: str, probs: dict[str, float], nearest: bool) -> list[Column]:
    run, n = F.col("_cum"), F.col("_n")
    at = lambda k: F.min(F.when(run > k, F.col(value)))
    out = []
    for name, p in probs.items():
        h = (n - 1) * F.lit(float(p))
        if nearest:
            out.append(at(F.rint(h)).alias(name))
            continue
        lo, hi = at(F.floor(h)), at(F.ceil(h))
        frac = F.max(h - F.floor(h))
        out.append((lo + (hi - lo) * frac).alias(name))
    return out


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], group: list[str] | None = None,
                    nearest: bool = False, count: str | None = None) -> DataFrame:
    """Exact quantiles of a column of any size, one row per group.

    Linear interpolation by default; ``nearest`` takes the value at index round-half-even(p*(n-1)). The rows are
    not sorted or stored: see ``_selected``. Rows that already stand for several name their number in ``count``;
    those are counted per (group, value) and ranked.
    """
    group = group or []
    if count is None:
        return _selected(df, value, probs, group, nearest)
    counted = df.filter(finite(value)).groupBy(*group, value).agg(F.sum(count).alias("_c"))
    ranked = running_total(counted, [value], "_c", group, out="_cum", total="_n")
    return ranked.groupBy(*group).agg(*_quantile_exprs(value, probs, nearest))


#: Accuracy of the sketch that brackets a quantile, and how far the bracket reaches on both sides in units of its error.
SKETCH, MARGIN = 10_000, 4.0


def _selected(df: DataFrame, value: str, probs: dict[str, float], group: list[str], nearest: bool) -> DataFrame:
    """Exact selection by narrowing: two passes over the rows, both combined before the shuffle.

    A sketch of bounded size brackets each quantile of each group between two values. A second pass counts the rows
    under a bracket and, one by one, the values inside it, about 2 * MARGIN / SKETCH of the rows; only those are
    ranked. A bracket that proves not to hold its ranks is replaced by the group's whole range.
    """
    rows = df.filter(finite(value)).select(*group, value)
    reach = MARGIN / SKETCH
    marks = [min(1.0, max(0.0, p + side)) for p in probs.values() for side in (-reach, reach)]
    stats = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_least"), F.max(value).alias("_most"), F.percentile_approx(value, marks, SKETCH).alias("_s"))
    stats = cut(stats.filter("_n > 0"))
    sides = [(F.col("_least") if a == 0.0 else F.col("_s")[2 * i], F.col("_most") if b == 1.0 else F.col("_s")[2 * i + 1])
             for i, (a, b) in enumerate(zip(marks[::2], marks[1::2]))]
    bracket = lambda i, lo, hi: F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"))
    picked = _picked(rows, value, stats.select(*group, "_n", F.array(*[bracket(i, *s) for i, s in enumerate(sides)]).alias("_b")), list(probs.values()), group, nearest)
    missed = picked.filter("_missed").select(*group, "_i")
    if not missed.isEmpty():
        whole = stats.join(missed, group) if group else with_scalars(missed, stats)
        whole = whole.groupBy(*group, "_n").agg(F.collect_set(F.struct(F.col("_i").alias("i"), F.col("_least").alias("lo"), F.col("_most").alias("hi"))).alias("_b"))
        picked = picked.filter("not _missed").unionByName(_picked(rows, value, whole, list(probs.values()), group, nearest))
    return picked.groupBy(*group).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(probs)])


def _picked(rows: DataFrame, value: str, brackets: DataFrame, probs: list[float], group: list[str], nearest: bool) -> DataFrame:
    """(group, _i, _q, _missed) of each bracket: the quantile, and whether the bracket does not hold its ranks."""
    x = F.col(value)
    near = rows.join(small_side(brackets, brackets.count()), group) if group else with_scalars(rows, brackets)
    # a row counts for the brackets it lies in, by value, and for those it lies under, together
    entries = F.filter(F.transform("_b", lambda t: F.when(x <= t["hi"], F.struct(t["i"].alias("i"), F.when(x >= t["lo"], x).alias("key")))), lambda e: e.isNotNull())
    counted = near.select(*group, "_n", F.explode(entries).alias("_e")).groupBy(*group, F.col("_e.i").alias("_i"), "_n", F.col("_e.key").alias("_key")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_total(counted, [F.col("_key").asc_nulls_first()], "_c", [*group, "_i"], out="_cum")
    h = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
    lo, hi = (F.rint(h), F.rint(h)) if nearest else (F.floor(h), F.ceil(h))
    at = lambda k: F.min(F.when(F.col("_cum") > k, F.col("_key")))
    under = F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_c"))), F.lit(0))
    found = ranked.groupBy(*group, "_i").agg(
        at(lo).alias("_lo"), at(hi).alias("_hi"), F.max(h - F.floor(h)).alias("_frac"), ((under > F.max(lo)) | (F.max("_cum") <= F.max(hi))).alias("_missed"))
    q = F.col("_lo") if nearest else F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    return cut(found.select(*group, "_i", q.alias("_q"), "_missed"))


def exact_quantiles_of(df: DataFrame, values: list[str], probs: dict[str, float],
                       group: list[str] | None = None) -> DataFrame:
    """Exact quantiles of several columns in one pass: columns ``<value>_<prob name>``."""
    group = group or []
    long = df.select(
        *group,
        F.explode(F.array(*[
            F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_v")) for v in values
        ])).alias("_e"),
    ).select(*group, "_e.*")
    tall = exact_quantiles(long, "_v", probs, [*group, "_name"])
    picks = [
        F.max(F.when(F.col("_name") == v, F.col(p))).alias(f"{v}_{p}") for v in values for p in probs
    ]
    return tall.groupBy(*group).agg(*picks)


def bounded_quantiles(value: str, probs: dict[str, float]) -> list[Column]:
    """Quantile aggregates for groups whose size is fixed by a parameter (replicates, specs)."""
    ok = F.when(finite(value), F.col(value))
    return [F.percentile(ok, F.lit(float(p))).alias(name) for name, p in probs.items()]


def first_by(df: DataFrame, group: list[str], order: list[Column], take: list[str]) -> DataFrame:
    """First row of each group under ``order`` (ascending), by a combinable aggregate."""
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*group).agg(
        F.min_by(F.struct(*take), key).alias("_first")
    ).select(*group, *[F.col("_first")[t].alias(t) for t in take])


def zscore(df: DataFrame, values: list[str], group: list[str] | None = None,
           train: Column | None = None) -> DataFrame:
    """Add ``<value>_z``: centred on the mean and scaled by the population deviation.

    A zero or missing deviation counts as 1. With ``train`` the statistics come from the rows it
    selects, and missing values are imputed by that mean, so that their score is 0.
    """
    group = group or []
    base = df if train is None else df.filter(train)
    aggs = [f(F.when(finite(v), F.col(v))).alias(f"_{n}_{v}") for v in values
            for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = base.groupBy(*group).agg(*aggs)
    wide = attach_to_rows(df, stats, group)
    out = []
    for v in values:
        sd = F.when(F.coalesce(F.col(f"_s_{v}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s_{v}"))
        z = (F.col(v) - F.col(f"_m_{v}")) / sd
        out.append((F.coalesce(z, F.lit(0.0)) if train is not None else z).alias(f"{v}_z"))
    return wide.select(*df.columns, *out)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
