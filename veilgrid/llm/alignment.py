"""Alignment of two tokenizers' tokens over byte offsets, with document counts of every linked pair of ids.

Both tokenisations of a text cut the same bytes. Between two neighbouring cuts of either lie exactly one token of
each, so the segments of the merged cuts are the links, and cuts that both share end a group.

How many documents hold a pair is counted without a dictionary: the distinct pairs get a minimal perfect hash (levels of
bit arrays, rank by running popcounts), built shard by shard on executors. Tasks add documents into dense vectors
indexed by it, and the vectors are summed as a tree, in chunks. A second pass aligns the documents again, from the ids
that the first one kept, and looks the pairs up; each slot's key is compared, so a pair outside the set is never taken for one inside. The pairs are
handled in ranges of bounded size, so what a task holds does not grow with the corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .neardup import stored
from .packing import byte_symbols
from .scan import Texts, map_blocks, mix

#: Pairs handled in one range: a task holds 16 bytes and some bits for each, about 70 MB.
RANGE = 1 << 22
#: Expected pairs of one shard of the hash, slots of a chunk of counts, and vectors summed at once.
SHARD, CHUNK, FAN_IN = 1 << 15, 1 << 15, 16
#: Slots of a level for each key that is left, and levels at most before keys are listed one by one.
GAMMA, LEVELS = 2, 40
#: Bytes of ids aligned at once in the second pass.
IDS_BYTES = 1 << 20

_U = np.uint64


class Aligner:
    """Ids, groups and links of texts under a byte-level tokenizer file (A) and a sentence piece model (B)."""

    def __init__(self, a_file: str, pattern: str, b_model: bytes):
        import sentencepiece
        import tiktoken  # the ids of the file's own library, which also records offsets and takes four times as long

        data, symbols = json.loads(a_file), byte_symbols()
        special = {t["content"] for t in data["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        a_bytes = [b""] * (1 + max(ranks.values()))
        for t, i in ranks.items():
            a_bytes[i] = t
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (a_bytes, self.b_bytes))
        self.a_text, self.b_text = (np.array([str(i).encode() for i in range(len(x))], object) for x in (a_bytes, self.b_bytes))

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; empty where the tokens of B do not spell the text (those of A always do)."""
        some = [i for i, t in enumerate(texts) if t]
        none = np.zeros(0, np.int64)
        a, b = [none] * len(texts), [none] * len(texts)
        for i, y in zip(some, self.b.encode([texts[i] for i in some], num_threads=1)):
            spaced = " " + texts[i]
            if b"".join(map(self.b_bytes.__getitem__, y)) == spaced.encode():
                a[i], b[i] = self.a.encode_to_numpy(spaced, disallowed_special=()), np.array(y, np.int64)
        return a, b


class Links:
    """Links of a block of documents: the document, A token and B token of each, and the groups."""

    def __init__(self, aligner: Aligner, a: list[np.ndarray], b: list[np.ndarray]):
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.a, self.b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        # one axis of bytes for the whole block: both sides of a document have the same bytes
        a_end, b_end = np.cumsum(aligner.a_len[self.a]), np.cumsum(aligner.b_len[self.b])
        marks = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 1, np.uint8)
        marks[a_end] = 1
        marks[b_end] += 2
        cuts = np.flatnonzero(marks)
        ends_a, ends_b, both = (marks[cuts] & 1).astype(np.int64), (marks[cuts] >> 1).astype(np.int64), marks[cuts] == 3
        self.a_at, self.b_at = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        owner = np.repeat(np.arange(len(a)), self.n_a)
        self.doc = owner[self.a_at]
        self.key = (self.a[self.a_at] << 32) | self.b[self.b_at]
        self.n_links = np.bincount(self.doc, minlength=len(a))
        self.n_groups = np.bincount(self.doc[both], minlength=len(a))
        # tokens of each side up to the end of each group
        self.a_upto, self.b_upto = self.a_at[both] + 1, self.b_at[both] + 1

    def of_documents(self) -> np.ndarray:
        """Keys of the block, once for each document that holds them."""
        order = np.lexsort((self.key, self.doc))
        doc, key = self.doc[order], self.key[order]
        new = np.ones(len(key), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        return key[new]

    def digests(self, aligner: Aligner) -> list[str]:
        """SHA-256 of each document's groups as text; '' without tokens."""
        a_size, b_size = np.diff(self.a_upto, prepend=0), np.diff(self.b_upto, prepend=0)
        # tokens and separators of all groups in one order: a group's A tokens come after all B tokens before it
        out = np.empty(2 * (len(self.a) + len(self.b)), object)
        a_place = np.arange(len(self.a)) + np.repeat(self.b_upto - b_size, a_size)
        b_place = np.arange(len(self.b)) + np.repeat(self.a_upto, b_size)
        out[2 * a_place], out[2 * b_place] = aligner.a_text[self.a], aligner.b_text[self.b]
        out[1::2] = b","
        out[2 * a_place[self.a_upto - 1] + 1] = b"|"
        out[2 * b_place[self.b_upto - 1] + 1] = b";"
        stop = np.cumsum(2 * (self.n_a + self.n_b))
        return [hashlib.sha256(b"".join(out[s : e - 1].tolist())).hexdigest() if e > s else "" for s, e in zip((stop - 2 * (self.n_a + self.n_b)).tolist(), stop.tolist())]


def _slot(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """Slot of each key in a level of the given number of slots."""
    return (mix(keys.astype(_U) ^ mix(np.array([level + 1], _U))) >> _U(16)) % np.asarray(size).astype(_U)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(keys.astype(_U) + _U(0x5BD1E995)) >> _U(32)) % _U(shards)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(slots of each level, bits, keys by their hash) of distinct keys; levels are whole words of 64 bits."""
    left, sizes, bits, placed = keys, [], [], []
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("keys are not distinct")
        size = max(64, -(-GAMMA * len(left) // 64) * 64)
        at = _slot(left, len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        order = np.argsort(at[mine])
        placed.append(left[mine][order])
        bits.append(np.packbits(alone, bitorder="little").view(_U))
        sizes.append(size)
        left = left[~mine]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, _U), np.concatenate(placed) if placed else keys


class PerfectHash:
    """Minimal perfect hash over shards: a number from 0 for each key of the set, -1 for any other."""

    def __init__(self, shards: int, rows: list[dict]):
        self.shards = shards
        levels = max((len(r["sizes"]) for r in rows), default=1)
        self.size, self.start = np.zeros((shards, levels), np.int64), np.zeros((shards, levels), np.int64)
        at = 0
        for r in sorted(rows, key=lambda r: r["shard"]):
            for i, s in enumerate(r["sizes"]):
                self.size[r["shard"], i], self.start[r["shard"], i] = s, at
                at += s
        rows = sorted(rows, key=lambda r: r["shard"])
        self.words = np.concatenate([np.frombuffer(r["bits"], _U) for r in rows]) if rows else np.zeros(0, _U)
        self.keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def __len__(self) -> int:
        return len(self.keys)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        shard = shard_of(keys, self.shards)
        for level in range(self.size.shape[1]):
            size = self.size[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.start[shard[left], level] + _slot(keys[left], level, size).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(_U)
            hit = (word >> bit) & _U(1) == 1
            low = word[hit] & ((_U(1) << bit[hit]) - _U(1))
            out[left[hit]] = self.rank[at[hit] >> 6] + np.bitwise_count(low)
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        out[found[self.keys[out[found]] != keys[found]]] = -1  # not of the set
        return out


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    sizes, bits, keys = build(table.column("key").to_numpy())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits.tobytes()]), "keys": pa.array([keys.tobytes()])})


def _count(hasher) -> Callable:
    """One dense vector a task, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mph, counts = hasher.value, None
        for batch in batches:
            counts = np.zeros(len(mph), np.int64) if counts is None else counts
            at = mph(batch.column("keys").flatten().to_numpy())
            ok = at >= 0
            np.add.at(counts, at[ok], batch.column("counts").flatten().to_numpy()[ok])
        if counts is not None:
            node = TaskContext.get().partitionId()
            for i in range(0, len(counts), CHUNK):
                yield _chunk(i // CHUNK, node, counts[i : i + CHUNK])

    return run


def _chunk(chunk: int, node: int, counts: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts))
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([node], pa.int64()), lists], names=["chunk", "node", "counts"])


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = np.sum([x.values.to_numpy() for x in table.column("counts")], axis=0)
    return pa.Table.from_batches([_chunk(key[0].as_py(), key[1].as_py(), total)])


def summed(vectors: DataFrame, tasks: int) -> DataFrame:
    """Dense vectors of many tasks added FAN_IN at a time, one chunk and node of the tree a group."""
    while tasks > 1:
        vectors = vectors.withColumn("node", F.expr(f"node div {FAN_IN}")).groupBy("chunk", "node").applyInArrow(_add, "chunk long, node long, counts array<long>")
        tasks = -(-tasks // FAN_IN)
    return vectors


def _tokens(make: Callable[[], Aligner]):
    """First pass: ids of each document; on a block's first row its distinct pairs and how many of its documents hold each."""

    def run(texts: Texts, lo: int, hi: int) -> dict[str, pa.Array]:
        aligner = make()
        a, b = aligner.ids(_strings(texts, lo, hi))
        keys, n = np.unique(Links(aligner, a, b).of_documents(), return_counts=True)
        rest = [None] * (hi - lo - 1)
        packed = lambda ids: pa.array([x.astype("<u4").tobytes() if x.size and x.max() >> 16 else x.astype("<u2").tobytes() for x in ids], pa.binary())
        wide = lambda ids: pa.array([bool(x.size and x.max() >> 16) for x in ids])
        first = lambda x: pa.array([x, *rest], pa.list_(pa.int64()))
        return {"a": packed(a), "a_wide": wide(a), "b": packed(b), "b_wide": wide(b), "keys": first(keys), "counts": first(n)}

    return run


def _strings(texts: Texts, lo: int, hi: int) -> list[str]:
    raw = texts.data[texts.offsets[lo] : texts.offsets[hi]].tobytes()
    offs = (texts.offsets[lo : hi + 1] - texts.offsets[lo]).tolist()
    return [raw[s:e].decode() for s, e in zip(offs, offs[1:])]


def _lookup(make: Callable[[], Aligner], hasher, counts, best, keep: list[str]):
    """Second pass: documents are aligned again from their ids, and the pairs of this range looked up."""

    def of(rows: pa.RecordBatch) -> pa.RecordBatch:
        aligner = make()
        a, b = ([np.frombuffer(x, "<u4" if w else "<u2") for x, w in zip(rows.column(c).to_pylist(), rows.column(f"{c}_wide").to_pylist())] for c in ("a", "b"))
        links = Links(aligner, a, b)
        n = rows.num_rows
        distinct, back = np.unique(links.key, return_inverse=True)
        at = hasher.value(distinct)
        count = np.where(at >= 0, counts.value[np.maximum(at, 0)], 0) if len(counts.value) else np.zeros(len(distinct), np.int64)
        top = ((at >= 0) & (count == best.value[distinct >> 32]))[back]
        total = np.zeros(n, np.int64)
        np.add.at(total, links.doc, count[back])
        out = {
            "n_a": pa.array(links.n_a), "n_b": pa.array(links.n_b), "n_groups": pa.array(links.n_groups, pa.int64()), "n_links": pa.array(links.n_links, pa.int64()),
            "n_best": pa.array(np.bincount(links.doc[top], minlength=n), pa.int64()), "count_sum": pa.array(total), "groups_sha256": pa.array(links.digests(aligner), pa.string()),
        }
        return pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *out.values()], names=[*keep, *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("a")).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + IDS_BYTES, "right")))
                yield of(batch.slice(at, to - at))
                at = to

    return run


_READY: dict[str, Aligner] = {}


def _ready(name: str, files) -> Aligner:
    if name not in _READY:
        _READY[name] = Aligner(*files.value)
    return _READY[name]


def maker(spark: SparkSession, a_file: str, pattern: str, b_model: bytes) -> Callable[[], Aligner]:
    """An aligner made once in each worker."""
    files = spark.sparkContext.broadcast((a_file, pattern, b_model))
    name = hashlib.sha256(f"{a_file}\0{pattern}\0".encode() + b_model).hexdigest()

    return lambda: _ready(name, files)


def align(docs: DataFrame, id_col: str, text_col: str, a_file: str, pattern: str, b_model: bytes, pairs: int = RANGE) -> DataFrame:
    """One row for each document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link's count is the number of documents, of the whole table, that hold its pair of ids. Texts that are null,
    empty, or not spelled by their tokens have zeros and ''. Rows with repeated or null ids are documents of their
    own. An empty table gives no rows. A very long text is one block by itself. Only the two named columns are read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text_"))
    make = maker(spark, a_file, pattern, b_model)
    tokens = map_blocks(base, "text_", ["doc_id"], "a binary, a_wide boolean, b binary, b_wide boolean, keys array<long>, counts array<long>", _tokens(make))
    tokens = stored(tokens.withColumn("row_", F.monotonically_increasing_id()), "tokens")
    held = tokens.where("keys is not null").select("keys", "counts")
    distinct = stored(held.select(F.explode("keys").alias("key")).distinct(), "distinct-pairs")
    n = distinct.count()
    ranges = max(1, -(-n // pairs))
    shards = max(1, -(-n // (SHARD * ranges))) * ranges

    def number(keys: pa.Array) -> pa.Array:
        return pa.array(shard_of(keys.to_numpy(), shards))

    sharded = distinct.select("key", F.arrow_udf(number, "long")("key").alias("shard"))
    built = stored(sharded.groupBy("shard").applyInArrow(_build_shard, "shard long, sizes array<long>, bits binary, keys binary"), "hash")
    tasks = spark.sparkContext.defaultParallelism
    highest = np.zeros(len(make().a_len), np.int64)

    def hasher(k: int):  # range k holds the shards k, k + ranges, ...
        return spark.sparkContext.broadcast(PerfectHash(shards, [r.asDict() for r in built.where(F.col("shard") % ranges == k).collect()]))

    sums = []
    for k in range(ranges):
        mph = hasher(k)
        vectors = held.repartition(tasks).mapInArrow(_count(mph), "chunk long, node long, counts array<long>")
        sums.append(stored(summed(vectors, tasks).select("chunk", "counts"), f"counts-{k}"))
        np.maximum.at(highest, mph.value.keys >> 32, dense(sums[k]))
        if ranges > 1:
            mph.destroy()
    best = spark.sparkContext.broadcast(highest)
    schema = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    keep = ["doc_id"] if ranges == 1 else ["row_", "doc_id"]

    def looked_up(mph, counts) -> DataFrame:
        kept = ", ".join(f"{c} long" for c in keep)
        return tokens.select(*keep, "a", "a_wide", "b", "b_wide").mapInArrow(_lookup(make, mph, counts, best, keep), f"{kept}, {schema}")

    if ranges == 1:
        return looked_up(mph, spark.sparkContext.broadcast(dense(sums[0])))
    out = None
    for k in range(ranges):
        mph, counts = hasher(k), spark.sparkContext.broadcast(dense(sums[k]))
        one = stored(looked_up(mph, counts), f"range-{k}")
        mph.destroy()
        counts.destroy()
        out = one if out is None else out.unionByName(one)
    same = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = out.groupBy("row_").agg(F.first("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in same], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def dense(chunks: DataFrame) -> np.ndarray:
    """The counts of one range, 8 bytes for each of its pairs."""
    rows = sorted(chunks.collect(), key=lambda r: r["chunk"])
    return np.concatenate([np.array(r["counts"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
