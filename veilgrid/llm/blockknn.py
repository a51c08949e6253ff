"""Exact nearest neighbours by a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks; each pair of blocks is one tile and one task. A tile
multiplies int8 codes, bounds the error of each product by the vectors' quantisation residuals, drops
the pairs whose upper bound lies below the query's k-th best lower bound, recomputes the rest in
double precision on the original vectors and keeps k of them in a heap for each query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a tile: queries and candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Rows multiplied at once inside a tile.
QUERY_STEP, CANDIDATE_STEP = 512, 2048
#: Pairs recomputed at once.
EXACT_STEP = 1 << 15


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim) of rows with an id and a vector of finite components, not all of them zero."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .where(F.col("id").isNotNull() & v.isNotNull() & fine)
        .withColumn("dim", F.size("vec"))
    )


class Codes:
    """int8 codes of vectors with what bounds the error of their products."""

    def __init__(self, x: np.ndarray):
        self.x = x
        top = np.abs(x).max(axis=1)
        self.scale = top / 127
        self.codes = np.rint(x / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.residual = np.sqrt(((x - near) ** 2).sum(axis=1))
        self.norm = np.sqrt((x**2).sum(axis=1))
        self.near_norm = np.sqrt((near**2).sum(axis=1))


def bounds(q: Codes, c: Codes, qs: slice, cs: slice) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of each inner product of the two slices."""
    kind = np.float32 if q.x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay exact
    approx = (q.codes[qs].astype(kind) @ c.codes[cs].astype(kind).T).astype(np.float64)
    approx *= q.scale[qs][:, None]
    approx *= c.scale[cs][None, :]
    error = q.residual[qs][:, None] * c.norm[cs][None, :] + q.near_norm[qs][:, None] * c.residual[cs][None, :]
    error += 1e-12 * q.norm[qs][:, None] * c.norm[cs][None, :]  # rounding of the bounds themselves
    return approx - error, approx + error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each pair of rows, summed in the order of the components, so that equal rows give equal sums."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += x * y
    return total


def tile(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k best (score, -id) over the candidates of other ids, as a heap."""
    qc, cc = Codes(q), Codes(c)
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    for c0 in range(0, len(ids), CANDIDATE_STEP):
        cs = slice(c0, min(c0 + CANDIDATE_STEP, len(ids)))
        for q0 in range(0, len(query_ids), QUERY_STEP):
            qs = slice(q0, min(q0 + QUERY_STEP, len(query_ids)))
            low, high = bounds(qc, cc, qs, cs)
            own = query_ids[qs][:, None] == ids[cs][None, :]
            low[own] = -np.inf
            least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[qs]])
            if low.shape[1] >= k:
                least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
            at_q, at_c = np.nonzero((high >= least[:, None]) & ~own)
            for i in range(0, len(at_q), EXACT_STEP):
                a, b = at_q[i : i + EXACT_STEP] + q0, at_c[i : i + EXACT_STEP] + c0
                scores = products(q[a], c[b])
                for row, score, other in zip(a.tolist(), scores.tolist(), ids[b].tolist()):
                    heap, item = heaps[row], (score, -other)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
    return heaps


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block; rows that repeat id and vector count once."""
    ids = table.column("id").to_numpy()
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    order = np.lexsort((*x.T[:4], ids)) if len(ids) else np.zeros(0, int)
    ids, x = ids[order], x[order]
    new = np.ones(len(ids), bool)
    if len(ids) > 1:
        new[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    return ids[new], x[new]


def nearest(queries: DataFrame, candidates: DataFrame, k: int, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k candidates of largest inner product for each query, (query_id, rank, vec_id, score).

    Both frames come from ``usable``. A candidate with the query's id is the query's own row and takes no
    part; vectors meet only vectors of their own length. Ties go to the smaller id. Fewer than k
    candidates give fewer rows; empty tables give none. Rows repeating id and vector count once.
    Blocks are dealt by a hash of id and vector; their number follows the counted rows. Every candidate
    row is sent once per block of queries and every query once per block of candidates.
    """
    n = {}
    for name, df, size in (("q", queries, query_block), ("c", candidates, candidate_block)):
        n[name] = max(1, -(-df.count() // size))
    deal = lambda df, blocks, col: df.withColumn(col, F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int"))
    copies = lambda df, blocks, col: df.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = copies(deal(queries, n["q"], "qb"), n["c"], "cb")
    right = copies(deal(candidates, n["c"], "cb"), n["q"], "qb")

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        query_ids, qx = _matrix(q)
        ids, cx = _matrix(c)
        out: list[tuple[int, int, float]] = []
        if len(query_ids) and len(ids):
            for i, heap in zip(query_ids.tolist(), tile(query_ids, qx, ids, cx, k)):
                out += [(i, -other, score) for score, other in heap]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=names)

    keys = ["qb", "cb", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
