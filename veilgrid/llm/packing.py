"""Lexical retrieval packing: windows of a fixed length filled with BM25 neighbours of their seed.

Full windows of long documents are sequences by themselves. What remains of each document is one unit.
Units are range-partitioned by a content key (least hash of their token 4-grams), which brings copies and
texts with shared passages together, and each partition is walked in shards of bounded size. A shard
has its own inverted index with document frequencies of the whole corpus; its units seed windows in
turn, and the unused units that score highest fill them. A unit that does not fit is cut, and the
rest of it seeds the next window, so only the last window of a partition is short.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import scratch
from .scan import mix

#: Tokens of one shard of the inverted index.
SHARD_TOKENS = 1 << 19
K1, B = 1.2, 0.75

_CUT = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, ids binary, content_key long, df array<struct<token:int,n:long>>"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenCutter:
    """Ids of whole texts by a byte-level tokenizer file; its added tokens are matched first, as its own library does."""

    def __init__(self, content: str, pattern: str, end_id: int):
        import tiktoken  # the same ids as the file's own library, without its records of offsets

        data, symbols = json.loads(content), byte_symbols()
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.end = np.array([end_id], np.uint32)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return self.end
        return np.concatenate([np.asarray(self.encoding.encode_to_numpy(text, allowed_special="all"), np.uint32), self.end])


#: Cutters of this worker, which serves many tasks.
_READY: dict[tuple, TokenCutter] = {}


def _cutter(name: str, content, pattern: str, end_id: int) -> TokenCutter:
    key = (name, pattern, end_id)
    if key not in _READY:
        _READY[key] = TokenCutter(content.value, pattern, end_id)
    return _READY[key]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def content_key(ids: np.ndarray) -> int:
    """Least mixed hash of the unit's 4-grams of tokens (of all its tokens, if fewer)."""
    x = ids.astype(np.uint64)
    width = min(4, len(x))
    acc = np.zeros(len(x) - width + 1, np.uint64)
    for j in range(width):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + x[j : j + len(acc)] + np.uint64(1)
    return int(mix(acc).min() >> np.uint64(1))


def cut_windows(df: DataFrame, id_col: str, text_col: str, tokenizer_json: str, pattern: str, window: int, end_id: int) -> DataFrame:
    """Rows of three kinds from one pass: full windows (``ids`` null), units with their ids, and each task's document frequencies."""
    content = df.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file
    digest = hashlib.sha256(tokenizer_json.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(digest, content, pattern, end_id)
        df_counts = np.zeros(1 << 16, np.int64)
        names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "ids", "content_key", "df"]
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.list_(pa.struct([("token", pa.int32()), ("n", pa.int64())]))]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = cutter(text.as_py())
                n = len(ids)
                for start in range(0, n - n % window, window):
                    rows.append((doc, n, start, window, crc(ids[start : start + window]), None, None, None))
                if n % window:
                    rest = ids[n - n % window :]
                    distinct = np.unique(rest)
                    if distinct[-1] >= len(df_counts):
                        df_counts = np.concatenate([df_counts, np.zeros(int(distinct[-1]) + 1 - len(df_counts), np.int64)])
                    df_counts[distinct] += 1
                    rows.append((doc, n, n - len(rest), len(rest), None, rest.tobytes(), content_key(rest), None))
                held += n
                if held > 1 << 20:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)
        seen = np.flatnonzero(df_counts)
        if len(seen):
            yield made([(None, None, None, None, None, None, None, [{"token": int(t), "n": int(df_counts[t])} for t in seen])])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _CUT)


class Shard:
    """BM25 inverted index over the units of one shard."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean_length: float):
        lengths = np.array([len(u) for u in units])
        owner = np.repeat(np.arange(len(units)), lengths)
        key, tf = np.unique(np.concatenate(units).astype(np.int64) * len(units) + owner, return_counts=True)
        token, unit = np.divmod(key, len(units))
        norm = K1 * (1 - B + B * lengths[unit] / mean_length)
        self.weight = (idf[token] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        self.unit = unit
        self.tokens, self.first = np.unique(token, return_index=True)
        self.last = np.append(self.first[1:], len(token))
        self.size = len(units)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Score of every unit for the distinct tokens of the query."""
        at = np.searchsorted(self.tokens, np.unique(query))
        first, n = self.first[at], self.last[at] - self.first[at]
        rows = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.unit[rows], weights=self.weight[rows], minlength=self.size)


def by_score(score: np.ndarray, few: int = 32) -> Iterator[int]:
    """Places by falling score, ties by position; the few best are found without sorting the rest."""
    done = 0
    if len(score) > 4 * few:
        least = np.partition(score, len(score) - few)[len(score) - few]
        best = np.flatnonzero(score >= least)
        best = best[np.argsort(-score[best], kind="stable")].tolist()
        yield from best
        done = len(best)
    yield from np.argsort(-score, kind="stable")[done:].tolist()


def fill(units: list[np.ndarray], shard: Shard, window: int, room: int, rest: tuple[int, int] | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (unit, from, to). The first window has ``room`` tokens left.

    The next seed is the rest of a cut unit, or the first unused unit. Neighbours are taken by falling
    score, ties by position. The last window may be short.
    """
    used = np.zeros(len(units), bool)
    nxt = 0
    while True:
        if rest is None:
            while nxt < len(units) and used[nxt]:
                nxt += 1
            if nxt == len(units):
                return
            rest, used[nxt] = (nxt, 0), True
        seed, begin = rest
        take = min(room, len(units[seed]) - begin)
        pieces = [(seed, begin, begin + take)]
        rest = (seed, begin + take) if begin + take < len(units[seed]) else None
        left = room - take
        if left:
            score = shard.scores(units[seed])
            score[used] = -1
            for unit in by_score(score):
                if not left or used[unit]:
                    break
                used[unit] = True
                take = min(left, len(units[unit]))
                pieces.append((unit, 0, take))
                left -= take
                if take < len(units[unit]):
                    rest = (unit, take)
        yield pieces
        room = window


def pack(
    df: DataFrame, id_col: str, text_col: str, tokenizer_json: str, pattern: str, window: int = 1024, end_id: int = 0, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens; one row for each piece.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Every id lies in one
    piece. Null and repeated ids of documents are allowed: each row is its own document. An empty table gives
    no rows. Only the two named columns are read.
    """
    spark = df.sparkSession
    where = scratch(spark, "packing")
    cut_windows(df, id_col, text_col, tokenizer_json, pattern, window, end_id).write.parquet(where)
    rows = spark.read.schema(_CUT).parquet(where)

    counts = rows.where(F.col("df").isNotNull()).select(F.explode("df").alias("e")).groupBy("e.token").agg(F.sum("e.n").alias("n"))
    n_units, total = rows.where(F.col("ids").isNotNull()).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    found = counts.toPandas()  # at most one row for each token of the vocabulary
    idf = np.zeros(int(found["token"].max()) + 1 if len(found) else 1)
    idf[found["token"].to_numpy(int)] = np.log1p((n_units - found["n"] + 0.5) / (found["n"] + 0.5))
    statistics = spark.sparkContext.broadcast((idf, total / max(1, n_units)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean_length = statistics.value
        number = TaskContext.get().partitionId() << 33
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        at = 0  # place in the open window

        def packed(held: list[tuple]) -> pa.RecordBatch:
            nonlocal number, at
            units = [np.frombuffer(h[3], "<u4") for h in held]
            out = []
            for pieces in fill(units, Shard(units, idf, mean_length), window, window - at):
                for unit, a, b in pieces:
                    doc, n, start, _ = held[unit]
                    out.append((doc, start + a, b - a, crc(units[unit][a:b]), n, number * 2 + 1, at))
                    at += b - a
                if at == window:
                    number, at = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(row)
                size += len(row[3]) // 4
                if size >= shard_tokens:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    units = rows.where(F.col("ids").isNotNull()).select("doc_id", "doc_tokens", "start", "ids", "content_key")
    near = units.repartitionByRange("content_key", "doc_id", "start").sortWithinPartitions("content_key", "doc_id", "start")
    filled = near.select("doc_id", "doc_tokens", "start", "ids").mapInArrow(run, _PIECE)
    whole = rows.where(F.col("start").isNotNull() & F.col("ids").isNull()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return whole.unionByName(filled)
