"""Vectorised scanning of text columns inside tasks: words, byte offsets and hashes without a Python loop per word.

A block of documents is one byte array. Each byte is mapped by a table to its folded value, or to 0
where it separates words; prefix sums of a polynomial modulo 2**64 then give the hash of any word, or
of any part of one, in constant time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at once; the working arrays take about 60 times as much.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (multiply and shift rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values derived from a seed."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed))


_BYTE = seeded(17, 256)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, _U)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_table(separators: bytes, lower_latin: bool = False) -> np.ndarray:
    """Folded value of each byte, A-Z lowered, 0 for separators."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[np.frombuffer(separators, np.uint8)] = 0
    return t


#: Words between space, tab, newline, vertical tab, form feed and carriage return.
SPACED = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of a-z, digits and all bytes from 0x80.
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class Texts:
    """Bytes and row offsets of a string column; null counts as empty."""

    def __init__(self, col: pa.Array | pa.ChunkedArray):
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
            col = col.cast(pa.string())
        if col.null_count:
            col = pc.fill_null(col, "")
        wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
        _, offs, data = col.buffers()
        self.offsets = np.frombuffer(offs, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)

    def blocks(self, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
        """Row ranges of at most ``limit`` bytes, or of one row."""
        n, at = len(self.offsets) - 1, 0
        while at < n:
            to = int(np.searchsorted(self.offsets, self.offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), n)
            yield at, to
            at = to


class Words:
    """Words of the rows [lo, hi) of ``texts``: row, byte start and end within the block, 64-bit hash."""

    def __init__(self, texts: Texts, lo: int, hi: int, table: np.ndarray = SPACED):
        offs = texts.offsets[lo : hi + 1]
        self.base = int(offs[0])
        self.offs = offs - self.base
        raw = texts.data[offs[0] : offs[-1]]
        self.bytes = b = table[raw]
        n = len(b)
        on = np.zeros(n + 2, bool)
        on[1:-1] = b != 0
        first = np.zeros(n + 1, bool)  # places where a row starts
        first[self.offs] = True
        self.starts = np.flatnonzero(on[1:-1] & (~on[:-2] | first[:-1]))
        self.ends = np.flatnonzero(on[1:-1] & (~on[2:] | first[1:])) + 1
        self.rows = np.searchsorted(self.offs, self.starts, "right") - 1
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[b] * _power(_BASE, n), out=self.prefix[1:])
        self.counts = np.bincount(self.rows, minlength=hi - lo)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])  # index of each row's first word
        self.hashes = self.part(self.starts, self.ends)

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes between start and end."""
        inverse = _power(_INVERSE, len(self.prefix))
        return mix((self.prefix[end] - self.prefix[start]) * inverse[start])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of its first word, hash) of every run of k words within a row."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.flatnonzero(self.rows[:n] == self.rows[k - 1 :])
        acc = np.zeros(n, _U)
        for j in range(k):
            acc = acc * _U(0xD6E8FEB86659FD93) + self.hashes[j : j + n]
        return at, mix(acc[at])


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single lower-case words, as ``Words`` gives them."""
    out = Texts(pa.array(words, pa.string()))
    full = np.arange(256, dtype=np.uint8)
    whole = Words(out, 0, len(words), full)
    return whole.part(whole.offs[:-1], whole.offs[1:])


def hash_gram(words: list[str]) -> int:
    """Hash of one run of words, as ``Words.grams`` gives it."""
    acc = np.zeros(1, _U)
    for h in hash_words(words):
        acc = acc * _U(0xD6E8FEB86659FD93) + h
    return int(mix(acc)[0].astype(np.int64))


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as signed longs."""
    return pa.array(x.view(np.int64))


def nested(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """One list for each count, taken in order from ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def map_blocks(
    df: DataFrame, text: str, keep: list[str], schema: str, fn: Callable[[Texts, int, int], dict[str, pa.Array]], rows: str | None = None, limit: int = BLOCK_BYTES, with_text: bool = False,
) -> DataFrame:
    """Apply ``fn`` to blocks of ``text``; its arrays have a value for each row of the block.

    With ``rows`` it gives any number of rows instead, and the array under that name says which
    row of the block each comes from. ``with_text`` hands the text on as well. ``schema`` lists the columns that ``fn`` adds. Only ``keep``
    and ``text`` are read, so other columns of ``df`` never clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(len(keep)))
            for lo, hi in texts.blocks(limit):
                got = fn(texts, lo, hi)
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(names))]
                if rows is not None:
                    at = pa.array(got.pop(rows))
                    kept = [c.take(at) for c in kept]
                out = pa.RecordBatch.from_arrays([*kept, *got.values()], names=[*names, *got])
                for i in range(0, out.num_rows, 1 << 16):
                    yield out.slice(i, 1 << 16)

    names = [*keep, text] if with_text else keep
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(*keep, text).mapInArrow(run, f"{kinds}, {schema}" if kinds else schema)
