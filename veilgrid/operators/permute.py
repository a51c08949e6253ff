"""Label shuffles inside strata, thousands of them, without a row for each cell and shuffle.

A shuffle of a stratum of n cells is a keyed permutation of the positions 0..n-1: four half rounds of a Feistel
network over a grid of a x b >= n positions, walked on while it leaves the stratum. The cells sent to the first k
places get the label, exactly k in every shuffle, and no order of random numbers has to be found. A task holds a
slice of the cells, works out blocks of (cells x shuffles) in arrays and adds the chosen cells to one running
table of (shuffle, sums); only that table leaves the task. All arithmetic is on whole numbers, so SQL gives the same bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import hash32
from ..runtime import cut, small_side
from .ordering import global_rank

#: Odd multipliers under 2**30, so that products of 32-bit numbers stay in 62 bits, and steps of shuffle and half round.
MULTIPLY = (739982445, 695872825)
REP_STEP, ROUND_STEP = 2654435769, 2246822507
ROUNDS = 4
#: Cells times shuffles worked out at once.
ELEMENTS = 1 << 15

_U, _W = np.uint32, np.uint64


def round_keys(start: int, reps: np.ndarray) -> np.ndarray:
    """ROUNDS keys of 32 bits for each shuffle of a stratum."""
    x = (_W(start) + reps.astype(_W)[None, :] * _W(REP_STEP) + np.arange(ROUNDS, dtype=_W)[:, None] * _W(ROUND_STEP)).astype(_U)
    x ^= x >> _U(16)
    x *= _U(MULTIPLY[0])
    x ^= x >> _U(15)
    x *= _U(MULTIPLY[1])
    x ^= x >> _U(16)
    return x


def _move(half: np.ndarray, other: np.ndarray, key: np.ndarray, limit: int) -> np.ndarray:
    """``half`` moved round [0, limit) by a hash of the other half and a key."""
    x = other + key
    x *= _U(MULTIPLY[0])
    x ^= x >> _U(15)
    x *= _U(MULTIPLY[1])
    x >>= _U(16)
    x *= _U(limit)
    x >>= _U(16)
    x += half
    return np.minimum(x, x - _U(limit), out=x)  # the difference wraps round to a large number below the limit


def _step(at: np.ndarray, keys: list[np.ndarray], a: int, b: int) -> np.ndarray:
    left, right = np.divmod(at, _U(b))
    for i in range(0, ROUNDS, 2):
        left = _move(left, right, keys[i], a)
        right = _move(right, left, keys[i + 1], b)
    left *= _U(b)
    left += right
    return left


def permuted(at: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Places (cells x shuffles) of positions ``at`` of a stratum of n under each column of ``keys``."""
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    columns = [k[None, :] for k in keys]
    # left and right start as one column; broadcasting makes the block in the first half round
    out = _step(at.astype(_U)[:, None], columns, a, b)
    while True:
        outside = out >= n
        if a * b == n or not outside.any():
            return out
        row, column = np.nonzero(outside)
        out[row, column] = _step(out[row, column], [k[column] for k in keys], a, b)


def _lead(left: np.ndarray, right: np.ndarray, keys: list[np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves before the last half round, which moves only the right one."""
    distinct, at = np.unique(right, return_inverse=True)
    if 2 * len(distinct) <= right.size:  # cells of few columns share the hashes of the first half round
        left = left + _move(np.zeros((1, 1), _U), distinct[:, None], keys[0], a)[at.ravel()]
        left = np.minimum(left, left - _U(a), out=left)
    else:
        left = _move(left, right, keys[0], a)
    for i in range(1, ROUNDS - 1, 2):
        right = _move(right, left, keys[i], b)
        left = _move(left, right, keys[i + 1], a)
    return left, right


def chosen(at: np.ndarray, n: int, k: int, keys: np.ndarray) -> np.ndarray:
    """Whether ``permuted`` sends each position below ``k``.

    The last half round moves places within a row of the grid, so only the row that holds place k and those that reach over n need it.
    """
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    if a < 8 or (a * b == n and a < 32):  # most rows would be at the edge, or no place lies outside
        return permuted(at, n, keys) < k
    left, right = _lead(*np.divmod(at.astype(_U)[:, None], _U(b)), [x[None, :] for x in keys], a, b)
    whole = k // b
    out = left < _U(whole)
    edge = left >= _U(n // b)
    edge |= left == _U(whole)
    row, column = np.divmod(np.flatnonzero(edge), edge.shape[1])
    if len(row):
        halves = left[row, column]
        place = halves * _U(b) + _move(right[row, column], halves, keys[-1][column], b)
        while (outside := np.flatnonzero(place >= n)).size:
            place[outside] = _step(place[outside], [x[column[outside]] for x in keys], a, b)
        out[row, column] = place < k
    return out


def _add(reps: int, by: list[str], names: list[str]):
    """Sums of the chosen cells of a task's slice, one row for each (by, shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            sid = batch.column("_sid").to_numpy()
            at, values = batch.column("_i").to_numpy(), np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(sid)) + 1, [len(sid)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo == hi:
                    continue
                group = tuple(batch.column(c)[lo].as_py() for c in by)
                sums = totals.setdefault(group, np.zeros((len(names), reps)))
                n, k, start = (batch.column(c)[lo].as_py() for c in ("_n", "_k", "_start"))
                if k == 0:
                    continue
                cells = min(hi - lo, 1024)
                width = max(1, ELEMENTS // cells)
                for r in range(0, reps, width):
                    keys = round_keys(start, np.arange(r, min(r + width, reps)))
                    for i in range(lo, hi, cells):
                        j = min(i + cells, hi)
                        sums[:, r : r + keys.shape[1]] += values[:, i:j] @ chosen(at[i:j], n, k, keys).astype(np.float64)
        for group, sums in totals.items():
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([g] * reps, pa.string()) for g in group], pa.array(np.arange(reps)), *[pa.array(s) for s in sums]], names=[*by, "rep", *names])

    return run


def shuffled_sums(rows: DataFrame, key: str, label: str, sums: dict[str, Column], reps: int, seed: int,
                  stratum: str, by: list[str]) -> DataFrame:
    """Shuffle a label inside strata and sum columns over the cells that get it: one row for each (by, rep).

    ``by`` names separate null models (text columns), each with its own strata. Positions follow ``key``, which is unique in a
    stratum; a stratum has under 2**32 cells. Values that are NULL count as 0, and cells whose values are all 0 are numbered but not shuffled. A stratum is spread over as many tasks
    as its cells fill, and a task sends ``reps`` rows for each model it meets.
    """
    strata = [*by, stratum]
    need = rows.groupBy(*strata).agg(F.count_if(F.col(label)).alias("_k"))
    need = cut(need.withColumn("_sid", F.monotonically_increasing_id()).withColumn("_start", hash32(seed, *[F.col(c) for c in strata])))
    slim = rows.select(*strata, key, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])
    ranked = global_rank(slim, [key], strata, out="_i", total="_n").withColumn("_i", F.col("_i") - 1)
    session = rows.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    # equal slices of cells in order of strata: every task has the same work and few strata
    some = reduce(lambda x, y: x | y, [F.col(n) != 0 for n in sums])
    dealt = ranked.where(some).join(small_side(need, need.count()), strata).repartitionByRange(tasks, "_sid", "_i").sortWithinPartitions("_sid", "_i")
    names = list(sums)
    schema = ", ".join([*[f"{c} string" for c in by], "rep long", *[f"{n} double" for n in names]])
    parts = dealt.select(*by, "_sid", "_i", "_n", "_k", "_start", *names).mapInArrow(_add(reps, by, names), schema)
    return parts.groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names])


def shuffled_sums_sql(source: str, label: str, stratum: str, model: str, sums: dict[str, str], reps: int, seed: int, key: str) -> str:
    """The same shuffles as SQL: one row for each rep, from a select of cells."""
    mask = 2**32 - 1
    below = lambda half, k, limit: (
        f"((((xor(((({half}) + {k}) & {mask}) * {MULTIPLY[0]} & {mask}, (((({half}) + {k}) & {mask}) * {MULTIPLY[0]} & {mask}) >> 15) * {MULTIPLY[1]}) & {mask}) >> 16) * {limit} >> 16)")

    keys = ", ".join(
        f"(s0 + rep * {REP_STEP} + {i} * {ROUND_STEP}) & {mask} as p{i}, xor(p{i}, p{i} >> 16) * {MULTIPLY[0]} & {mask} as q{i}, xor(q{i}, q{i} >> 15) * {MULTIPLY[1]} & {mask} as r{i}, xor(r{i}, r{i} >> 16) as k{i}"
        for i in range(ROUNDS))
    def step(y: str) -> str:
        out, left, right = [], f"{y} // b", f"{y} % b"
        for i in range(0, ROUNDS, 2):
            out.append(f"(({left}) + {below(right, f'k{i}', 'a')}) % a as l{i}")
            left = f"l{i}"
            out.append(f"(({right}) + {below(left, f'k{i + 1}', 'b')}) % b as m{i}")
            right = f"m{i}"
        return f"{', '.join(out)}, ({left}) * b + {right} as place"

    cells = f"""select *, cast(ceil(n / cast(a as double)) as bigint) as b from (select *, cast(ceil(sqrt(n)) as bigint) as a from (
        select *, {stratum} as stratum, row_number() over (partition by {stratum} order by {key}) - 1 as pos, count(*) over (partition by {stratum}) as n,
          count(*) filter (where {label}) over (partition by {stratum}) as k from {source}))"""
    starts = f"select distinct sid, cast('0x' || substr(md5(concat_ws('|', '{seed}', '{model}', stratum)), 1, 8) as bigint) as s0 from c"
    kept = f"rep, n, k, a, b, {', '.join(f'k{i}' for i in range(ROUNDS))}, {', '.join(sums.values())}"
    # places outside the stratum are few and stepped again
    return f"""(with recursive c as materialized (select *, dense_rank() over (order by stratum) as sid from ({cells})),
      t as materialized (select sid, rep, {keys} from ({starts}), (select unnest(range({reps})) as rep)),
      e as (select {kept}, {step('pos')} from c join t using (sid)),
      w as (select {kept}, place from e where place >= n union all select {kept}, place from (select {kept}, {step('at_')} from (select * exclude (place), place as at_ from w where place >= n))),
      x as (select rep, {', '.join(sums.values())} from e where place < k union all select rep, {', '.join(sums.values())} from w where place < k)
      select rep, {', '.join(f'sum({v}) as {n}' for n, v in sums.items())} from x group by rep)"""
