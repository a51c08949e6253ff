"""Prefix trie of conversations from sorted LCPs and range minima.

Conversations, cut into segments of SEGMENT turns, are sorted by the digests of their turns, so that all that
start with the same turns stand together. With the length of the common prefix (LCP) of each row and the row
before it, a node of depth d is a run of rows between which no LCP is under d. Each candidate prefix finds
both ends of its run by binary search over a sparse table of range minima, without a stack and without any
other candidate. What is summed over a node's members or its subtree is a difference of running sums.

The sorted rows are held in blocks of bounded size. A run that leaves its block gives one part for each
block it crosses, keyed by the block it begins in, which a second sparse table over block minima finds;
parts are added by key. A segment's own tree is named by two hashes of the turns before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import global_rank
from .neardup import stored

#: Turns of a segment; a longer conversation has several rows.
SEGMENT = 256
#: Turns of a block at most (a single row may exceed it by SEGMENT). The driver and each task hold 8 bytes a block.
BLOCK = 1 << 17
_DIGEST = 16

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_BLOCK_LISTS = ["seg", "p1", "p2", "x1", "x2", "cont", "conv_id", "deep", "more_bytes", "more_leaves"]
_KEY = "struct<seg:long,p1:long,p2:long,path:binary>"
_BLOCK_SCHEMA = (
    "block long, seg array<long>, p1 array<long>, p2 array<long>, x1 array<long>, x2 array<long>, cont array<boolean>, conv_id array<long>, deep array<long>, "
    f"more_bytes array<long>, more_leaves array<long>, len array<int>, lcp array<int>, sizes array<long>, inner int, head {_KEY}, tail {_KEY}"
)
_PART = (
    "home long, d int, block long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
    "parent_conv_id long, phome long, pd int, q1 long, q2 long, i1 long, i2 long"
)


class RangeMin:
    """Sparse table: least value of any run of an array in constant time."""

    def __init__(self, x: np.ndarray):
        self.n, self.rows = len(x), [x]
        step = 1
        while 2 * step <= self.n:
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of x[lo..hi], both included."""
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            row = self.rows[level]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(level)) + 1])
        return out

    def right(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Last r from ``at`` on with x[at+1..r] all >= d."""
        r = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            can = np.flatnonzero(r + (1 << k) < self.n)
            go = can[self.rows[k][r[can] + 1] >= d[can]]
            r[go] += 1 << k
        return r

    def left(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """First l up to ``at`` with x[l+1..at] all >= d."""
        left = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            can = np.flatnonzero(left - (1 << k) >= 0)
            go = can[self.rows[k][left[can] - (1 << k) + 1] >= d[can]]
            left[go] -= 1 << k
        return left


def rebuilt_turns(conversations: DataFrame, keep: int = 5, spread: int = 9) -> DataFrame:
    """(conv_id, pos, digest, bytes, len): turns after each conversation took the first turns of its neighbour.

    The first h turns come from conversation c - c % keep, with h = crc32 of c % spread, the rest are its own after h. A
    conversation without any turn has one row with a null pos. Ties of ``turn`` are ordered by digest.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("bytes"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
    )
    rows = stored(global_rank(rows, [F.col("turn").asc_nulls_first(), "digest"], ["conv_id"], "pos", "n"), "turns")
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % spread
    convs = rows.where("pos = 1").select("conv_id", "n", h("conv_id").alias("h"), (F.col("conv_id") - F.col("conv_id") % keep).alias("base"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = stored(convs.join(sizes, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    first = rows.where(F.col("pos") < spread).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    lent = convs.where("taken > 0").join(first, "base").where("pos <= taken").select("conv_id", "pos", "digest", "bytes", "len")
    own = rows.where(F.col("pos") > h("conv_id")).join(convs, "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes", "len")
    none = convs.where("len = 0").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), "len")
    return lent.unionByName(own).unionByName(none)


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each segment of each conversation: its tree (seg, p1, p2), its path of digests, and its sizes."""
    pos, sized = F.col("pos"), F.struct("pos", "digest", "bytes")
    rows = turns.withColumn("seg", F.expr(f"coalesce((pos - 1) div {segment}, 0L)")).groupBy("conv_id", "seg", "len").agg(
        F.sort_array(F.collect_list(F.when(pos.isNotNull(), sized))).alias("turns"),
        F.bit_xor(F.xxhash64("pos", "digest")).alias("s1"), F.bit_xor(F.xxhash64("digest", "pos", F.lit(7))).alias("s2"), F.sum("bytes").alias("size"),
    )
    rows = rows.select(
        "conv_id", "seg", "len", "s1", "s2", "size", F.col("turns.bytes").alias("sizes"),
        F.unhex(F.array_join(F.transform("turns.digest", F.hex), "")).alias("path"), (F.col("len") > (F.col("seg") + 1) * segment).alias("cont"),
    )
    return stored(rows, "segments")


def _lcp(path: np.ndarray, start: np.ndarray, length: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Common turns of each row and the one before; -1 in different trees and for the first row."""
    n = len(length)
    out = np.full(n, -1, np.int64)
    same = np.flatnonzero((tree[1:] == tree[:-1]).all(axis=1)) + 1
    m = np.minimum(length[same], length[same - 1])
    out[same] = m
    some = same[m > 0]
    m = m[m > 0]
    if len(some):
        cuts = np.concatenate([[0], np.cumsum(m)])
        within = np.arange(cuts[-1]) - np.repeat(cuts[:-1], m)
        differ = (path[np.repeat(start[some], m) + within] != path[np.repeat(start[some - 1], m) + within]).any(axis=1)
        out[some] = np.minimum.reduceat(np.where(differ, within, np.repeat(m, m)), cuts[:-1])
    return out


def _pack(block_turns: int):
    """Blocks of a sorted partition, each one row; the first has its first row's key, the last its last row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        number, before, waiting = TaskContext.get().partitionId() << 32, None, None

        def key(t: pa.Table, i: int) -> dict:
            return {c: t.column(c)[i].as_py() for c in ("seg", "p1", "p2", "path")}

        def block(t: pa.Table) -> dict:
            nonlocal before, number
            path = t.column("path").combine_chunks()
            offs = np.frombuffer(path.buffers()[1], np.int32)[path.offset : path.offset + len(path) + 1].astype(np.int64)
            raw = path.buffers()[2]
            flat = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]].view(np.uint64).reshape(-1, 2) if raw is not None else np.zeros((0, 2), np.uint64)
            length, start = np.diff(offs) // _DIGEST, (offs[:-1] - offs[0]) // _DIGEST
            tree = np.stack([t.column(c).to_numpy() for c in ("seg", "p1", "p2")], axis=1)
            lcp = _lcp(flat, start, length, tree)
            head = key(t, 0)
            if before is not None and all(before[c] == head[c] for c in ("seg", "p1", "p2")):
                a, b = (np.frombuffer(x["path"], np.uint64).reshape(-1, 2) for x in (before, head))
                m = min(len(a), len(b))
                differ = np.flatnonzero((a[:m] != b[:m]).any(axis=1))
                lcp[0] = differ[0] if len(differ) else m
            row = {c: t.column(c).combine_chunks() for c in _BLOCK_LISTS}
            row |= {"len": pa.array(length, pa.int32()), "lcp": pa.array(lcp, pa.int32()), "sizes": t.column("sizes").combine_chunks().flatten()}
            out = {"block": number, "lists": row, "inner": int(lcp[1:].min()) if len(lcp) > 1 else 1 << 30, "head": head if before is None else None, "tail": None}
            before, number = key(t, t.num_rows - 1), number + 1
            return out

        def emit(b: dict) -> pa.RecordBatch:
            names = [*_BLOCK_LISTS, "len", "lcp", "sizes"]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(b["lists"][c])], pa.int32()), b["lists"][c]) for c in names]
            kind = pa.struct([("seg", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("path", pa.binary())])
            return pa.RecordBatch.from_arrays(
                [pa.array([b["block"]], pa.int64()), *lists, pa.array([b["inner"]], pa.int32()), pa.array([b["head"]], kind), pa.array([b["tail"]], kind)],
                names=["block", *names, "inner", "head", "tail"],
            )

        held: list[pa.RecordBatch] = []
        turns = 0

        def cut() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held, turns
            if held:
                if waiting is not None:
                    yield emit(waiting)
                waiting, held, turns = block(pa.Table.from_batches(held, schema)), [], 0

        for batch in batches:
            schema = batch.schema
            size = np.cumsum(np.maximum(pc.binary_length(batch.column("path")).to_numpy(zero_copy_only=False) // _DIGEST, 1))
            at, base = 0, 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, base + block_turns - turns, "right")))
                held.append(batch.slice(at, to - at))
                turns += int(size[to - 1] - base)
                base, at = int(size[to - 1]), to
                if turns >= block_turns or at < batch.num_rows:
                    yield from cut()
        yield from cut()
        if waiting is not None:
            waiting["tail"] = before
            yield emit(waiting)

    return run


def sorted_blocks(rows: DataFrame, name: str, block: int = BLOCK) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Blocks of the sorted rows; and of all blocks in order their number, least inner LCP and LCP with the block before."""
    order = ["seg", "p1", "p2", "path", "cont", "conv_id"]
    packed = rows.select(*order, "x1", "x2", "deep", "more_bytes", "more_leaves", "sizes").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stored(packed.mapInArrow(_pack(block), _BLOCK_SCHEMA), name)
    # one row a partition
    ends = blocks.where("head is not null or tail is not null").groupBy(F.shiftright("block", 32).alias("part")).agg(
        F.min("block").alias("block"), F.max("head").alias("head"), F.max("tail").alias("tail"))
    ends = ends.withColumn("prev", F.lag("tail").over(Window.orderBy("part")))
    common = F.expr(
        f"case when prev is null or prev.seg <> head.seg or prev.p1 <> head.p1 or prev.p2 <> head.p2 then -1 when least(length(prev.path), length(head.path)) = 0 then 0 else "
        f"size(filter(sequence(1, least(length(prev.path), length(head.path)) div {_DIGEST}), k -> substring(prev.path, 1, cast({_DIGEST} * k as int)) = substring(head.path, 1, cast({_DIGEST} * k as int)))) end"
    )
    edges = ends.select("block", common.cast("int").alias("edge"))
    found = blocks.select("block", "inner", F.col("lcp")[0].alias("first")).join(edges, "block", "left").select("block", "inner", F.coalesce("edge", "first").alias("edge")).collect()
    found.sort(key=lambda r: r["block"])
    return blocks, {c: np.array([r[c] for r in found], np.int64) for c in ("block", "inner", "edge")}


class _Block:
    """Arrays of one block, with running sums and the LCPs at both of its edges."""

    def __init__(self, row: dict, tops: dict[str, np.ndarray]):
        self.number = row["block"]
        self.index = int(np.searchsorted(tops["block"], self.number))
        self.lcp = np.asarray(row["lcp"], np.int64).copy()
        self.edge = self.lcp[0] = int(tops["edge"][self.index])
        self.next = int(tops["edge"][self.index + 1]) if self.index + 1 < len(tops["block"]) else -1
        self.seg, self.conv, self.len = (np.asarray(row[c], np.int64) for c in ("seg", "conv_id", "len"))
        self.cont = np.asarray(row["cont"], bool)
        self.start = np.concatenate([[0], np.cumsum(self.len)[:-1]])
        self.bytes = np.concatenate([[0], np.cumsum(np.asarray(row["sizes"], np.int64))])
        self.total = self.pre(np.arange(len(self.len)), self.len)
        self.new = self.total - self.pre(np.arange(len(self.len)), np.maximum(self.lcp, 0))
        self.leaf = (np.append(self.lcp[1:], self.next) < self.len) & ~self.cont

    def pre(self, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Bytes of the first k turns of row j."""
        return self.bytes[self.start[j] + k] - self.bytes[self.start[j]]


def _arrays(batch: pa.RecordBatch, i: int) -> dict:
    return {c: (batch.column(c)[i].as_py() if c == "block" else batch.column(c)[i].values.to_numpy(zero_copy_only=False)) for c in batch.schema.names}


def _deeper(tops: dict[str, np.ndarray]):
    """New bytes and leaves of each row of the given blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(_arrays(batch, i), tops)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.conv), pa.array(b.seg), pa.array(b.new), pa.array(b.leaf.astype(np.int64))], names=["conv_id", "seg", "new", "leaf"])

    return run


def _run_sum(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    cum = np.concatenate([[0], np.cumsum(x)])
    return cum[hi + 1] - cum[lo]


def _nodes(tops: dict[str, np.ndarray], segment: int):
    """Nodes of each block, whole ones and parts of those that leave it."""
    over = RangeMin(np.minimum(tops["edge"], tops["inner"]))

    def homes(index: int, d: np.ndarray) -> np.ndarray:
        """Block where the runs begin that enter block ``index`` from the left at the given depths."""
        if index < 1:
            return np.zeros(len(d), np.int64)
        return tops["block"][over.left(np.full(len(d), index - 1), d)]

    def of_block(row: dict) -> pa.RecordBatch:
        b = _Block(row, tops)
        n = len(b.conv)
        lcps, convs = RangeMin(b.lcp), RangeMin(b.conv)
        lowest = (b.seg > 0).astype(np.int64)
        first = np.maximum(b.lcp + 1, lowest)
        first[0] = lowest[0]
        count = np.maximum(b.len - first + 1, 0)
        base = np.concatenate([[0], np.cumsum(count)[:-1]])
        j = np.repeat(np.arange(n), count)
        d = first[j] + np.arange(len(j)) - base[j]
        lo, hi = lcps.left(j, d), lcps.right(j, d)
        enters, leaves = (lo == 0) & (d <= b.edge), (hi == n - 1) & (d <= b.next)
        opened = enters | leaves
        members, least = hi - lo + 1, convs.least(lo, hi)
        before = np.where(d > 0, b.pre(lo, np.maximum(d - 1, 0)), 0)
        more = np.asarray(row["more_bytes"], np.int64)
        fresh = np.where(enters, _run_sum(b.new, lo, hi), _run_sum(b.new, lo, hi) - b.new[lo] + b.total[lo] - before) + _run_sum(more, lo, hi)
        saved = _run_sum(b.total + np.asarray(row["deep"], np.int64), lo, hi) - members * before - fresh
        n_leaves = _run_sum(b.leaf + np.asarray(row["more_leaves"], np.int64), lo, hi)
        # parents, searched for on their own
        inside = np.flatnonzero(d > lowest[j])
        up = lcps.left(j[inside], d[inside] - 1)
        parent = base[up] + d[inside] - 1 - first[up]
        children = np.bincount(parent[~enters[inside]], minlength=len(j))
        home = np.where(enters, 0, b.number)
        at = np.flatnonzero(enters)
        home[at] = homes(b.index, d[at])
        parent_conv, phome, pd = np.zeros(len(j), np.int64), np.zeros(len(j), np.int64), np.zeros(len(j), np.int64)
        parent_conv[inside], phome[inside], pd[inside] = least[parent], home[parent], d[inside] - 1
        has = np.zeros(len(j), bool)
        has[inside] = True
        p_open = np.zeros(len(j), bool)
        p_open[inside] = opened[parent]
        # rows that end in a node stand first in its run
        done = np.flatnonzero(~b.cont)
        top = lcps.left(done, b.len[done])
        ends_here = np.bincount(base[top] + b.len[done] - first[top], minlength=len(j))
        ends: list[str | None] = [None if o else _EMPTY_SHA for o in opened.tolist()]
        for c in np.flatnonzero(ends_here).tolist():
            ids = ",".join(map(str, b.conv[lo[c] : lo[c] + ends_here[c]].tolist()))
            ends[c] = ids if opened[c] else hashlib.sha256(ids.encode()).hexdigest()
        root_of_segment = ~has & (b.seg[j] > 0) & ~enters
        whole = d == segment
        lists = lambda x, mask, kind=pa.int64(): pa.array(x, kind, mask=mask)
        p1, p2, x1, x2 = (np.asarray(row[c], np.int64)[lo] for c in ("p1", "p2", "x1", "x2"))
        return pa.RecordBatch.from_arrays(
            [
                lists(home, ~opened), pa.array(d, pa.int32()), pa.array(np.full(len(j), b.number)), pa.array(b.seg[j] * segment + d), pa.array(least), pa.array(members),
                pa.array(children.astype(np.int64)), pa.array(n_leaves), pa.array(saved), pa.array(ends, pa.string()), lists(parent_conv, ~has | p_open | enters),
                lists(phome, ~p_open | enters), pa.array(pd, pa.int32(), mask=~p_open | enters), lists(p1, ~root_of_segment), lists(p2, ~root_of_segment), lists(x1, ~whole), lists(x2, ~whole),
            ],
            names=[c.split()[0] for c in _PART.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = of_block(_arrays(batch, i))
                for at in range(0, out.num_rows, 1 << 16):
                    yield out.slice(at, 1 << 16)

    return run


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces in order; only the running digest is held."""
    key, sha = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([sha.hexdigest()])], names=["home", "d", "ends_sha256"])

    for batch in batches:
        for home, d, ids in zip(batch.column("home").to_pylist(), batch.column("d").to_pylist(), batch.column("ends")):
            if (home, d) != key:
                if key is not None:
                    yield out()
                key, sha = (home, d), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_buffer())
    if key is not None:
        yield out()


def trie(conversations: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, see ``rebuilt_turns``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. Null
    roles and texts are empty; rows without a conv_id belong to no conversation and are left out; null turns come
    first; repeated rows are turns of their own. Other columns are not read. An empty table has no rows. The digest of
    a node's ends is sequential by definition: one task streams it, a row a block.
    """
    rows = segments(rebuilt_turns(conversations), segment)
    zero = F.lit(0).cast("long")
    short = rows.where(F.col("len") <= segment).select("*", F.col("s1").alias("x1"), F.col("s2").alias("x2"), *[zero.alias(c) for c in ("p1", "p2", "deep", "more_bytes", "more_leaves")])
    long_rows = rows.where(F.col("len") > segment)
    if not long_rows.isEmpty():
        by = Window.partitionBy("conv_id").orderBy("seg")
        earlier, later = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
        long_rows = long_rows.select("*", *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), zero).alias(f"p{i}") for i in (1, 2)], F.coalesce(F.sum("size").over(later), zero).alias("deep"))
        long_rows = stored(long_rows.withColumn("x1", F.col("p1").bitwiseXOR(F.col("s1"))).withColumn("x2", F.col("p2").bitwiseXOR(F.col("s2"))), "long-rows")
        blocks, tops = sorted_blocks(long_rows.where("seg > 0").select("*", zero.alias("more_bytes"), zero.alias("more_leaves")), "deep-blocks", block)
        news = blocks.select("block", *_BLOCK_LISTS, "len", "lcp", "sizes").mapInArrow(_deeper(tops), "conv_id long, seg long, new long, leaf long")
        long_rows = long_rows.join(news, ["conv_id", "seg"], "left")
        long_rows = long_rows.select(*[c for c in long_rows.columns if c not in ("new", "leaf")], F.coalesce(F.sum("new").over(later), zero).alias("more_bytes"), F.coalesce(F.sum("leaf").over(later), zero).alias("more_leaves"))
        short = short.unionByName(long_rows)
    blocks, tops = sorted_blocks(short, "blocks", block)
    parts = stored(blocks.select("block", *_BLOCK_LISTS, "len", "lcp", "sizes").mapInArrow(_nodes(tops, segment), _PART), "parts")

    opened = parts.where("home is not null")
    ends = opened.where("ends is not null").select("home", "d", "block", "ends").repartition("home", "d").sortWithinPartitions("home", "d", "block")
    ends = ends.select("home", "d", "ends").mapInArrow(_digest_runs, "home long, d int, ends_sha256 string")
    merged = opened.groupBy("home", "d").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        *[F.max(c).alias(c) for c in ("parent_conv_id", "phome", "pd", "q1", "q2", "i1", "i2")],
    )
    merged = stored(merged.join(ends, ["home", "d"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA))), "merged")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    links = ["phome", "pd", "q1", "q2", "i1", "i2"]
    nodes = parts.where("home is null").withColumnRenamed("ends", "ends_sha256").select(*cols, *links).unionByName(merged.select(*cols, *links))
    # the first turn of a later segment hangs under the node that ends the segment before
    below = nodes.where("q1 is not null").groupBy(F.col("q1").alias("i1"), F.col("q2").alias("i2")).agg(F.count("*").alias("kids"))
    ending = nodes.where("i1 is not null").join(below, ["i1", "i2"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", zero)).select(*cols, *links)
    nodes = nodes.where("i1 is null").unionByName(ending)
    other = [c for c in cols if c != "parent_conv_id"]
    over = merged.select(F.col("home").alias("phome"), F.col("d").alias("pd"), F.col("conv_id").alias("parent_conv_id"))
    above = ending.select(F.col("i1").alias("q1"), F.col("i2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.where("phome is null and q1 is null").select(*cols)
        .unionByName(nodes.where("phome is not null").select(*other, "phome", "pd").join(over, ["phome", "pd"]).select(*cols))
        .unionByName(nodes.where("q1 is not null").select(*other, "q1", "q2").join(above, ["q1", "q2"]).select(*cols))
    )
