"""Language identification by averaged hashed subword embeddings and a linear softmax.

Every byte n-gram inside a word (with word ends) selects a row of an embedding table by its hash; a text is
the mean of its rows, and a linear layer with softmax gives the language. Table and layer are trained
by stochastic gradient descent in numpy on a bounded sample of labelled documents. As mean and layer are
linear, prediction adds the rows' products with the layer. Temperature and rejection threshold are set on
a part of the sample that was not trained on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Texts, Words, byte_table, map_blocks

#: Documents sampled for the fit, as expected number; at most twice as many are taken.
SAMPLE = 6000
#: Languages at most: the most frequent labels.
LANGUAGES = 256
#: Buckets fit 16 bits: the sample is held as such.
BUCKETS, WIDTH = 1 << 15, 16
GRAMS = (1, 2, 3, 4)
EPOCHS, BATCH, RATE = 12, 64, 0.5
#: Share of the calibration documents that the threshold may reject.
REJECT = 0.001

#: Bytes of text handled at once; all n-grams of a block are held together, about 200 bytes for each byte of text.
BLOCK = 1 << 18

#: ASCII letters and all bytes from 0x80 make words.
_LETTERS = byte_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def subwords(texts: Texts, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the rows' words; words end in a separator byte on both sides."""
    w = Words(texts, lo, hi, _LETTERS)
    b = w.bytes.astype(np.uint32)
    lead = np.flatnonzero((w.bytes[:-1] == 0xC3) & (w.bytes[1:] >= 0x80) & (w.bytes[1:] < 0x9F)) + 1 if len(b) > 1 else np.zeros(0, int)
    b[lead] += 0x20  # capital Latin-1 letters in UTF-8
    n = len(b)
    text_row = np.repeat(np.arange(hi - lo), np.diff(w.offs))
    rows, buckets = [], []
    code = np.zeros(n, np.uint32)
    for size in range(1, max(GRAMS) + 1):
        m = n - size + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + b[size - 1 :]
        if size not in GRAMS:
            continue
        # both ends lie in one row, and all inner bytes belong to a word
        ok = text_row[:m] == text_row[size - 1 :]
        for j in range(size):
            if size <= 2 or 0 < j < size - 1:
                ok &= b[j : j + m] != 0
        at = np.flatnonzero(ok)
        h = code[at] * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        buckets.append((h >> np.uint32(17)).astype(np.int32) & (BUCKETS - 1))
        rows.append(text_row[at])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(buckets)


def crc_of_id(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def _features(texts: Texts, lo: int, hi: int) -> dict[str, pa.Array]:
    rows, buckets = subwords(texts, lo, hi)
    key, n = np.unique(rows.astype(np.int64) * BUCKETS + buckets, return_counts=True)
    row, bucket = np.divmod(key, BUCKETS)
    counts = np.bincount(row, minlength=hi - lo)
    share = n / np.maximum(1, np.bincount(row, weights=n, minlength=hi - lo))[row]
    ends = np.cumsum(counts)
    packed = lambda x, kind: pa.array([p.astype(kind).tobytes() for p in np.split(x, ends[:-1])], pa.binary())
    return {"buckets": packed(bucket, "<u2"), "shares": packed(share, "<f4")}


@dataclass
class Model:
    """Logits of each bucket for each language, with temperature and threshold."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Fit table and layer by SGD on sparse mean vectors; one row in five calibrates."""
    rng = np.random.default_rng(seed)
    n, k = len(x), len(languages)
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 1 / math.sqrt(WIDTH), (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32)
    held = np.arange(n) % 5 == 4 if n >= 50 else np.zeros(n, bool)
    fit = np.flatnonzero(~held)

    def shares(rows: np.ndarray) -> np.ndarray:
        """Share of every bucket in each of a batch's texts; a text names a bucket once."""
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for line, i in zip(out, rows):
            line[x[i][0]] = x[i][1]
        return out

    steps, step = EPOCHS * max(1, -(-len(fit) // BATCH)), 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(fit), max(1, -(-len(fit) // BATCH))):
            rate = RATE * (1 - step / steps)
            step += 1
            batch = shares(rows)
            h = batch @ emb
            z = h @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            down = p @ layer.T
            layer -= rate / len(rows) * (h.T @ p)
            bias -= rate / len(rows) * p.sum(axis=0)
            # rows of the table are touched by few documents of a batch, each with its own small share
            emb -= rate * 8 * (batch.T @ down)
    model = Model(languages, emb @ layer, bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else fit
    logits = np.concatenate([shares(rows) @ emb @ layer + bias for rows in np.array_split(check, -(-len(check) // BATCH))])

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(logits)[np.arange(len(check)), y[check]], 1e-12)).mean()

    model.temperature = min((2.0**e for e in np.arange(-4, 3.01, 0.25)), key=loss)
    top = model.probabilities(logits).max(axis=1)
    model.threshold = float(min(0.5, np.quantile(top, REJECT)))
    return model


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model | None:
    """Model from a sample of the labelled rows of ``docs``, at most 2 * ``sample`` of them.

    Rows are chosen by a hash of id and text, evenly over the languages. None if no row has a label and text.
    """
    known = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), F.col(lang_col).alias("lang_")).where(F.col("lang_").isNotNull() & F.col("text_").isNotNull())
    counts = known.groupBy("lang_").count().orderBy(F.desc("count"), "lang_").limit(LANGUAGES).collect()
    if not counts:
        return None
    languages = sorted(r["lang_"] for r in counts)
    chosen = F.lit(0.0)
    for r in counts:
        chosen = F.when(F.col("lang_") == r["lang_"], F.lit(sample / len(counts) / r["count"])).otherwise(chosen)
    draw = F.pmod(F.xxhash64("id_", "text_"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = known.where(draw < chosen).limit(2 * sample)
    rows = map_blocks(picked, "text_", ["lang_", "id_"], "buckets binary, shares binary", _features, limit=BLOCK).where(F.octet_length("buckets") > 0)
    got = sorted(rows.toLocalIterator(), key=lambda r: (str(r["id_"]), r["lang_"]))  # sparse vectors of the sample
    if not got:
        return None
    number = {name: i for i, name in enumerate(languages)}
    x = [(np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["shares"], "<f4")) for r in got]
    order = np.random.default_rng(3).permutation(len(got))
    return train([x[i] for i in order], np.array([number[got[i]["lang_"]] for i in order]), languages)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, text_col: str, keep: list[str], model: Model | None, with_text: bool = False) -> DataFrame:
    """``keep`` with ``lang_pred``, ``score`` (calibrated probability) and ``accepted``.

    Null texts and texts without letters are ``und`` with score 0 and not accepted; so is every text if
    there is no model. Texts whose probability is under the threshold keep their best language but are not accepted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(texts: Texts, lo: int, hi: int) -> dict[str, pa.Array]:
        m: Model | None = shared.value
        size = hi - lo
        rows, buckets = subwords(texts, lo, hi)
        offs = texts.offsets
        raw = texts.data[offs[lo] : offs[hi]]
        letter = (raw | 0x20) - 97 < 26
        ends = np.concatenate([[0], np.cumsum(letter)])
        seen = ends[offs[lo + 1 : hi + 1] - offs[lo]] > ends[offs[lo:hi] - offs[lo]]
        for i in np.flatnonzero(~seen & (np.diff(offs[lo : hi + 1]) > 0)).tolist():
            seen[i] = has_letter(texts.data[offs[lo + i] : offs[lo + i + 1]].tobytes().decode())
        if m is None:
            return {"lang_pred": pa.array(["und"] * size), "score": pa.array(np.zeros(size)), "accepted": pa.array(np.zeros(size, bool))}
        n = np.maximum(1, np.bincount(rows, minlength=size))
        logits = np.stack([np.bincount(rows, weights=m.table[buckets, j], minlength=size) / n for j in range(len(m.languages))], axis=1) + m.bias
        p = m.probabilities(logits)
        best, top = p.argmax(axis=1), p.max(axis=1)
        names = np.array([*m.languages, "und"], object)
        return {
            "lang_pred": pa.array(names[np.where(seen, best, len(m.languages))], pa.string()),
            "score": pa.array(np.where(seen, top, 0.0)), "accepted": pa.array(seen & (top >= m.threshold)),
        }

    return map_blocks(docs, text_col, keep, "lang_pred string, score double, accepted boolean", run, limit=BLOCK, with_text=with_text)


def identify(docs: DataFrame, id_col: str, text_col: str, lang_col: str, keep: list[str], learn_from: Column | None = None, with_text: bool = False) -> DataFrame:
    """Fit on the rows of ``docs`` that ``learn_from`` allows and predict all of them."""
    return predict(docs, text_col, keep, fit(docs if learn_from is None else docs.where(learn_from), id_col, text_col, lang_col), with_text)
