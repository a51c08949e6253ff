"""Exact join of vectors within a cosine, as a metric range join over pivot cells.

On unit vectors cos >= c means a distance of at most r = sqrt(2 - 2c). Vectors of one label and dimension form a
cell; a cell over CELL rows is split by pivots drawn from it, each vector going home to its nearest pivot. By the
triangle inequality a vector within r of some vector of another cell is at most 2r farther from that cell's
pivot than from its own, so only such vectors are replicated, and every cell is joined on its own. Cells are
split again until they are small or no longer shrink (a group of close copies); those are joined in tiles.

Inside a cell all pairs of a home vector and a member are compared by a matrix product, which yields a count for
each home vector and links that connect something new, never the pairs. Equal vectors are one class with a weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .neardup import stored

#: Members of a cell beyond which it is split, pivots of one split at most, and rows of a tile.
CELL, PIVOTS, TILE = 2048, 64, 4096
#: A split is final when a cell keeps more than this share of its parent's members.
SHRINK = 0.7
#: Rows of a cell, in expectation, on which the replication under fewer or more pivots is estimated.
SAMPLE = 1024
#: Rows of a tile multiplied at once.
STEP = 512
#: Allowance for rounding in the bounds; links are decided on the cosine itself.
SLACK = 1e-7


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark the vectors that take part and name equal ones by one digest."""
    for batch in batches:
        lists = batch.column("vec")
        keys: list[bytes | None] = []
        for x, lab in zip(lists, batch.column("label")):
            v = x.values
            if not lab.is_valid or v is None or v.null_count or len(v) == 0:
                keys.append(None)
                continue
            a = v.to_numpy(zero_copy_only=False) + 0.0  # one zero
            keys.append(hashlib.blake2b(a.tobytes(), digest_size=16).digest() if np.isfinite(a).all() and a.any() else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "vec_key"])


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a list column of one dimension; scaled first, so that no square overflows."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _reach(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector, and the pivots whose cells it may border on."""
    square = np.maximum(2 - 2 * (x @ p.T), 0)
    near = square.argmin(axis=1)
    own = square[np.arange(len(x)), near][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[near]
    # triangle inequality; and a vector beyond the bisector of two pivots is at least as far as the bisector
    reach = (np.sqrt(square) <= np.sqrt(own) + 2 * radius + SLACK) & (square - own <= 2 * radius * apart + SLACK)
    reach[np.arange(len(x)), near] = True
    return near, reach


def _by_cell(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    cell = np.array(batch.column("cell").to_pylist(), object)
    _, number = np.unique(cell, return_inverse=True)
    order = np.argsort(number, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
        if len(at):
            yield cell[at[0]], batch.take(pa.array(at))


def _estimate(radius: float):
    """Rows and replicas of the sampled rows of each cell under 2, 4, 8, ... of its pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, rows in _by_cell(batch):
                p, x, k = matrix(rows.column("pivots")[0].values), matrix(rows.column("vec")), 2
                while k <= len(p):
                    n = int(_reach(x, p[:k], radius)[1].sum())
                    yield pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([k], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([n], pa.int64())], names=["cell", "k", "n", "replicas"])
                    k *= 2

    return run


def _deal(radius: float):
    """Home and replicated rows of each vector among its cell's pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, rows in _by_cell(batch):
                p, x = matrix(rows.column("pivots")[0].values), matrix(rows.column("vec"))
                near, reach = _reach(x, p, radius)
                who, pivot = np.nonzero(reach)
                home = (near[who] == pivot) & rows.column("home").to_numpy(zero_copy_only=False)[who]
                inner = pa.array([f"{cell}/{k}" for k in range(len(p))]).take(pa.array(pivot))
                out = rows.select(["cls", "weight", "vec", "members"]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([inner, pa.array(home), *out.columns], names=["cell", "home", "cls", "weight", "vec", "parent_members"])

    return run


class Union:
    """Disjoint sets over small integers; says which links connect something new."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _tile(least: float):
    """Counts of each home vector in a tile, and links that connect something new."""

    def run(homes: pa.Table, members: pa.Table) -> pa.Table:
        a, b = homes.column("cls").to_numpy(), members.column("cls_").to_numpy()
        out_a, out_b, out_n = [], [], []
        if len(a) and len(b):
            ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            sets, own, other = Union(len(ids)), place[: len(a)], place[len(a) :]
            root = np.arange(len(ids))
            x, y, weight = matrix(homes.column("vec")), matrix(members.column("vec_")).T, members.column("weight_").to_numpy()
            for at in range(0, len(a), STEP):
                near = (x[at : at + STEP] @ y >= least) & (own[at : at + STEP, None] != other[None, :])
                for i in np.flatnonzero(near.any(axis=1)).tolist():
                    who = np.flatnonzero(near[i])
                    out_a.append(int(a[at + i]))
                    out_b.append(None)
                    out_n.append(int(weight[who].sum()))
                    # one partner of each set not yet known to be joined
                    who = who[np.unique(root[other[who]], return_index=True)[1]]
                    before = len(out_a)
                    for k in who.tolist():
                        if sets.join(int(own[at + i]), int(other[k])):
                            out_a.append(int(a[at + i]))
                            out_b.append(int(b[k]))
                            out_n.append(0)
                    if len(who) > 8 and len(out_a) > before:
                        root = np.array([sets.top(x) for x in root.tolist()])
        return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_n, pa.int64())], names=["a", "b", "n"])

    return run


def cells(classes: DataFrame, radius: float, cell: int = CELL) -> DataFrame:
    """(cell, home, cls, weight, vec): each class at home in one cell and replicated to the cells it borders on."""
    rows = stored(classes.select(F.concat_ws("/", F.col("label").cast("string"), F.size("vec").cast("string")).alias("cell"), F.lit(True).alias("home"), "cls", "weight", "vec", F.lit(None).cast("long").alias("parent_members")), "cells")
    done, turn = [], 0
    while True:
        sizes = rows.groupBy("cell").agg(F.count("*").alias("members"), F.max("parent_members").alias("parent_members"), F.max("home").alias("home")).where("home")
        wide = (F.col("members") > cell) & (F.col("parent_members").isNull() | (F.col("members") <= SHRINK * F.col("parent_members")))
        wide = stored(sizes.where(wide).select("cell", "members"), f"wide-{turn}")
        if wide.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(wide, "cell", "left_anti"))
        open_rows = rows.join(wide, "cell")
        # binomial draws of about PIVOTS and SAMPLE rows a cell; a hash decides, so no rows are sorted or collected
        draw = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed), F.lit(turn)), F.lit(1 << 30)) * F.col("members") < F.lit(n * (1 << 30))
        pivots = stored(open_rows.where(draw(PIVOTS, 1)).groupBy("cell").agg(F.collect_list("vec").alias("pivots")), f"pivots-{turn}")
        tried = open_rows.where(draw(SAMPLE, 2)).select("cell", "vec").join(pivots, "cell").mapInArrow(_estimate(radius), "cell string, k long, n long, replicas long")
        # many pivots only if they replicate little: rep**4 <= k keeps the copies of all splits under the cube root of what cells shrink
        fit = tried.groupBy("cell", "k").agg((F.sum("replicas") / F.sum("n")).alias("rep")).where((F.col("k") == 2) | (F.col("rep") ** 4 <= F.col("k")))
        chosen = stored(pivots.join(fit.groupBy("cell").agg(F.max("k").cast("int").alias("k")), "cell", "left").select("cell", F.slice("pivots", 1, F.coalesce("k", F.lit(2))).alias("pivots")), f"chosen-{turn}")
        dealt = open_rows.select("cell", "home", "cls", "weight", "vec", "members").join(chosen, "cell")
        schema = f"cell string, home boolean, cls long, weight long, vec {rows.schema['vec'].dataType.simpleString()}, parent_members long"
        split = dealt.mapInArrow(_deal(radius), schema)
        # a cell that drew no pivot draws again
        none = rows.join(wide, "cell", "left_semi").join(pivots, "cell", "left_anti")
        rows = stored(split.unionByName(none), f"cells-{turn}")
        turn += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def join_cells(placed: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """(a, b, n): rows with a null b give counts of class a, the others links."""
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / tile).cast("int").alias("n_home"), F.ceil(F.count("*") / tile).cast("int").alias("n_all")).where("n_home > 0")
    dealt = placed.join(sizes, "cell")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("home").select("cell", block("n_home").alias("i"), every("n_all").alias("j"), "cls", "vec")
    right = dealt.select(F.col("cell").alias("cell_"), every("n_home").alias("i_"), block("n_all").alias("j_"), F.col("cls").alias("cls_"), F.col("weight").alias("weight_"), F.col("vec").alias("vec_"))
    return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell_", "i_", "j_")).applyInArrow(_tile(least), "a long, b long, n long")


def link(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, least: float = 0.98, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links between vectors of one label with cos >= ``least``.

    n_links counts the other rows linked directly, component_id is the smallest id reachable. Rows with a null id or label,
    and vectors that are null, empty, zero or hold null or non-finite components, link with nothing; vectors of
    different dimensions do not link. Rows that share an id count by themselves in n_links and as one in what is
    reachable. An empty table gives no rows. Only the three named columns are read.
    """
    # single precision is kept as it is, to move half the bytes; all products are in double
    vec = F.col(vec_col) if vectors.schema[vec_col].dataType.simpleString() in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    rows = stored(rows.mapInArrow(_prepare, f"{kinds}, vec_key binary").withColumn("vec_key", F.when(F.col("vec_id").isNotNull(), F.col("vec_key"))), "vectors")
    used = rows.where("vec_key is not null")
    # equal vectors of a label are one class, named by its least id; the copies differ in nothing that is compared
    classes = used.groupBy("label", "vec_key").agg(F.min("vec_id").alias("cls"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    numbered = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    radius = float(np.sqrt(2 - 2 * least))
    placed = stored(cells(numbered.select("label", F.col("node").alias("cls"), "weight", "vec"), radius, cell), "placed")
    found = stored(join_cells(placed, least, tile), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    name = numbered.select(F.col("node").alias("a"), F.col("cls").alias("x"))
    links = found.where("b is not null").select("a", "b").join(name, "a").join(name.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # an id on several rows ties their classes together
    twice = used.groupBy("vec_id").count().where("count > 1").select("vec_id")
    ties = used.join(twice, "vec_id").select("vec_id", "label", "vec_key").join(numbered.select("label", "vec_key", "cls"), ["label", "vec_key"]).select(F.col("cls").alias("a"), F.col("vec_id").alias("b"))
    roots = components(links.unionByName(ties))
    ends = numbered.join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "node", "left")
    ends = ends.select("label", "vec_key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("component_id"))
    out = used.select("vec_id", "label", "vec_key").join(ends, ["label", "vec_key"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vec_key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
