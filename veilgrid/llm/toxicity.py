"""Toxicity scores of text restored by a noisy-channel decoder.

Words written with look-alike characters, drawn out by repetition or spaced letter by letter become lattices:
each place offers the characters that the writer may have meant, at a channel cost. A Viterbi search over the
lattice under a character trigram model, counted over the whole corpus, gives the likeliest word. Plain
words have a lattice of one path and stay as they are. The restored words and their beginnings are features; their
weights are smoothed log odds between toxic and other documents, counted over all labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import small_side
from .neardup import stored
from .scan import Texts, Words, byte_table, hash_words, longs, map_blocks, nested

#: Characters written for letters, as commonly seen (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou",
}
#: Channel costs in nats: a look-alike, a dropped repetition, a symbol that stands for nothing.
LOOK_COST, REPEAT_COST, DROP_COST = 1.0, 0.5, 8.0

#: Model alphabet: 0 is the word's end, 1-26 letters, the rest by the last byte of longer characters.
ALPHABET = 64

#: Beginnings of words, in bytes, that are features beside whole words.
STEMS = (4, 5, 6, 7)
#: A feature must occur in at least this share of the toxic documents, and in so many of them.
LEAST_SHARE, LEAST_COUNT = 0.003, 3
#: Smoothed log odds from which a feature counts, and pseudo-counts.
LEAST_WEIGHT, PRIOR = 2.0, 0.5
#: A document's score rests on so many of its heaviest features.
HEAVIEST = 3

_PLAIN = byte_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_LOOK = "".join(map(re.escape, LOOKALIKES))
_LETTER = r"[^\W\d_]"
_UNIT = rf"(?:{_LETTER}|[{_LOOK.replace(re.escape('*'), '')}])"
#: Letters or look-alikes spaced out, and places that may make their token suspect: a look-alike, a letter three times in a row.
SPACED_OUT = re.compile(rf"(?<!\S){_UNIT}(?:[\s.\-_*]{{1,2}}{_UNIT}){{2,}}(?!\S)")
SUSPECT = re.compile(rf"[{_LOOK}]|({_LETTER})\1\1")
LETTER = re.compile(_LETTER)
#: Marks around a token that are no part of it; an exclamation mark at its end may be one.
MARKS = ".,;:?\"'"
#: Longer tokens are decoded in parts of this length.
PART = 64
_LOOK_BYTES = np.zeros(256, bool)
_LOOK_BYTES[[ord(c) for c in LOOKALIKES if ord(c) < 128]] = True


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + c.encode()[-1] % (ALPHABET - 27)


def _codes(b: np.ndarray) -> np.ndarray:
    """Model symbols of folded bytes; 0 for bytes outside words. Lead bytes count as -1."""
    code = np.where((b >= 97) & (b <= 122), b.astype(np.int32) - 96, 27 + b.astype(np.int32) % (ALPHABET - 27))
    code[b == 0] = 0
    code[b >= 0xC0] = -1
    return code


def char_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Trigram counts of the characters of all words, ALPHABET**3 of them, over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            texts = Texts(batch.column(0))
            for lo, hi in texts.blocks():
                b = _PLAIN[texts.data[texts.offsets[lo] : texts.offsets[hi]]]
                code = _codes(b)
                code = np.concatenate([[0, 0], code[code >= 0], [0]])
                key = (code[:-2] * ALPHABET + code[1:-1]) * ALPHABET + code[2:]
                total += np.bincount(key[(code[1:-1] > 0) | (code[2:] > 0)], minlength=ALPHABET**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    rows = docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(ALPHABET**3, np.int64)
    out[rows["gram"].to_numpy(int)] = rows["n"].to_numpy(int)
    return out


class CharModel:
    """Costs (negative log probabilities) of a character after two others, interpolated with shorter contexts."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 0.1) / (c1 + 0.1).sum()
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).astype(np.float32)

    def decode(self, token: str, spaced: bool = False, doubled: bool = False) -> str:
        """The likeliest word of a token's lattice; of spaced letters the likeliest words, with a blank between.

        With ``doubled`` look-alikes that stand twice are read twice.
        """
        cost = self.cost
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for k, options in enumerate(lattice_of(token, doubled)):
            if spaced and k:  # a word may end between any two letters
                (a, b), (c, text) = min(best.items(), key=lambda s: s[1][0] + float(cost[s[0][0], s[0][1], 0]))
                if (a, b) != (0, 0):
                    best[0, 0] = (c + float(cost[a, b, 0]), (text, " "))
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (c, text) in best.items():
                for chars, channel in options:
                    x, y, total = a, b, c + channel
                    for ch in chars:
                        s = symbol(ch)
                        total += float(cost[x, y, s])
                        x, y = y, s
                    if (x, y) not in nxt or total < nxt[x, y][0]:
                        nxt[x, y] = (total, (text, chars))
            best = nxt
        text = min(((c + float(cost[a, b, 0]), text) for (a, b), (c, text) in best.items()), key=lambda s: s[0])[1]
        out = []
        while text:
            text, chars = text
            out.append(chars)
        return "".join(out[::-1])


def lattice_of(token: str, doubled: bool = False) -> list[list[tuple[str, float]]]:
    """Options (characters, channel cost) of each place; runs of one character are one place. With ``doubled`` two look-alikes are two letters."""
    lattice: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", re.sub(r"\s+", "", token.lower()), re.S):
        c, n = m[1], len(m[0])
        if c in LOOKALIKES:
            twice = [(x + y, LOOK_COST) for x in LOOKALIKES[c] for y in LOOKALIKES[c]] if n > 1 and len(LOOKALIKES[c]) <= 2 else []
            options = [] if doubled and twice else [(x, LOOK_COST) for x in LOOKALIKES[c]]
            options += [*twice, ("", DROP_COST)]
        elif c.isalpha():
            options = [(c, REPEAT_COST * (n > 1))] + ([(c * 2, REPEAT_COST * (n > 2))] if n > 1 else [])
        else:
            options = [("", 0.0)]
        lattice.append(options)
    return lattice


def suspect_rows(w: Words, raw: np.ndarray) -> np.ndarray:
    """Rows that may hold a suspect place, by their bytes."""
    b, n = w.bytes, len(w.bytes)
    at = [np.flatnonzero(_LOOK_BYTES[raw])]
    if n > 2:
        at.append(np.flatnonzero((raw[:-1] == 0xC2) & (raw[1:] == 0xA3)))
        at.append(np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x82) & (raw[2:] == 0xAC)))
        at.append(np.flatnonzero((b[2:] != 0) & (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2])))
    lone = np.flatnonzero(w.ends - w.starts <= 2)
    near = lone[2:][(lone[2:] - lone[:-2] == 2) & (w.starts[lone[2:]] - w.ends[lone[:-2]] <= 6)] if len(lone) > 2 else lone[:0]
    at.append(w.starts[near])
    return np.unique(np.searchsorted(w.offs, np.concatenate(at), "right") - 1)


def disguised(token: str) -> bool:
    """Whether a token holds a look-alike and a letter, or look-alikes of two kinds that are not all digits, or a letter three times in a row."""
    for m in SUSPECT.finditer(token):
        if m[1]:
            return True
        return bool(LETTER.search(token)) or (len(token) > 2 and len(set(token)) > 1 and all(c in LOOKALIKES for c in token) and not token.isdigit())
    return False


def suspects(text: str) -> Iterator[tuple[str, bool]]:
    """Suspect tokens of a text, whole, each once, and whether they are spaced letters, which are one token."""
    runs = [m.span() for m in SPACED_OUT.finditer(text) if LETTER.search(m[0])]
    for start, end in runs:
        yield text[start:end], True
    done = 0
    for m in SUSPECT.finditer(text):
        if m.start() < done:
            continue
        start, done = m.start(), m.end()
        while start and not text[start - 1].isspace():
            start -= 1
        while done < len(text) and not text[done].isspace():
            done += 1
        yield text[start:done], False


def restored(text: str, model: CharModel, known: dict[tuple[str, bool], list[str]]) -> list[str]:
    """Words restored from the suspect tokens of a text; ``known`` keeps decoded tokens."""
    out = []
    for token, spaced in suspects(text):
        if spaced:
            parts = [token]
        else:
            forms = {token.strip(MARKS + "!"), token.strip(MARKS)}
            parts = [form[i : i + PART] for form in sorted(forms) if disguised(form) for i in range(0, len(form), PART)]
        for part in parts:
            words = known.get((part, spaced))
            if words is None:
                if len(known) > 1 << 16:
                    known.clear()
                found = model.decode(part, spaced).split()
                if not spaced and any(c in LOOKALIKES and c == d for c, d in zip(part, part[1:])):
                    found += model.decode(part, doubled=True).split()
                words = known[part, spaced] = list(dict.fromkeys(found))
            out += words
    return out


def features(texts: Texts, lo: int, hi: int, model: CharModel, known: dict[tuple[str, bool], list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of the restored rows and of its beginnings; rows of a feature may repeat."""
    w = Words(texts, lo, hi, _PLAIN)
    rows, hashes = [w.rows], [w.hashes]
    size = w.ends - w.starts
    for n in STEMS:
        long = size > n
        rows.append(w.rows[long])
        hashes.append(w.part(w.starts[long], w.starts[long] + n) ^ np.uint64(n))
    words, of = [], []
    offs = texts.offsets
    for i in (suspect_rows(w, texts.data[offs[lo] : offs[hi]]) + lo).tolist():
        for word in restored(texts.data[offs[i] : offs[i + 1]].tobytes().decode(), model, known):
            words.append(word)
            of.append(i - lo)
    if words:
        raw = [x.encode() for x in words]
        rows.append(np.array(of))
        hashes.append(hash_words(words))
        for n in STEMS:
            long = [k for k, x in enumerate(raw) if len(x) > n]
            if long:
                # a stem may end inside a character; latin-1 carries its bytes one to one
                cut = Texts(pa.array([raw[k][:n] for k in long], pa.binary()).cast(pa.binary()).view(pa.string()))
                whole = Words(cut, 0, len(long), np.arange(256, dtype=np.uint8))
                rows.append(np.array(of)[long])
                hashes.append(whole.part(whole.offs[:-1], whole.offs[1:]) ^ np.uint64(n))
    return np.concatenate(rows), np.concatenate(hashes)


class Scorer:
    """Feature weights, sorted by hash, and the logistic of the heaviest ones."""

    def __init__(self, model: CharModel, hashes: np.ndarray, weights: np.ndarray, slope: np.ndarray):
        order = np.argsort(hashes)
        self.model, self.hashes, self.weights, self.slope = model, hashes[order], weights[order], slope

    def heaviest(self, texts: Texts, lo: int, hi: int, known: dict[tuple[str, bool], list[str]]) -> np.ndarray:
        """The HEAVIEST greatest weights among each row's distinct features, 0 where there are fewer."""
        out = np.zeros((hi - lo, HEAVIEST))
        if not len(self.hashes):
            return out
        rows, hashes = features(texts, lo, hi, self.model, known)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        key = np.unique(rows[hit].astype(np.int64) * len(self.hashes) + at[hit])
        row, feature = np.divmod(key, len(self.hashes))
        weight = self.weights[feature]
        order = np.lexsort((-weight, row))
        row, weight = row[order], weight[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < HEAVIEST
        out[row[top], rank[top]] = weight[top]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.slope[:-1] + self.slope[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps on weighted rows; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - 0.1 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labelled: DataFrame, text: str) -> Scorer:
    """Character model from all of ``docs``, weights from all rows of ``labelled`` (its ``text`` and ``toxic``).

    Features are first counted in the toxic rows alone. Those in at least LEAST_SHARE of them, of which there are
    at most the mean number of a text's features / LEAST_SHARE, are then counted in the others.
    """
    spark = docs.sparkSession
    model = CharModel(char_counts(docs, text))
    shared = spark.sparkContext.broadcast(model)
    labelled = labelled.where("toxic in (0, 1)")
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    def counted(rows: DataFrame, only: np.ndarray | None) -> DataFrame:
        """Documents with each feature, pre-aggregated in each task's batches."""
        chosen = spark.sparkContext.broadcast(only)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[tuple[str, bool], list[str]] = {}
            for batch in batches:
                texts, parts = Texts(batch.column(0)), []
                for lo, hi in texts.blocks():
                    of, hashes = features(texts, lo, hi, shared.value, known)
                    if chosen.value is not None:
                        at = np.minimum(np.searchsorted(chosen.value, hashes), len(chosen.value) - 1)
                        ok = chosen.value[at] == hashes
                        of, hashes = of[ok], hashes[ok]
                    order = np.lexsort((hashes, of))
                    of, hashes = of[order], hashes[order]
                    new = np.ones(len(of), bool)
                    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
                    parts.append(hashes[new])
                seen, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([longs(seen), pa.array(n.astype(np.int64))], names=["feature", "n"])

        return rows.select(text).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    none = Scorer(model, np.zeros(0, np.uint64), np.zeros(0), np.append(np.zeros(HEAVIEST), math.log((n1 + PRIOR) / (n0 + n1 + 2 * PRIOR - n1 + 1e-9)) if n1 + n0 else 0.0))
    if not n1 or not n0:
        return none
    toxic = counted(labelled.where("toxic = 1"), None).where(F.col("n") >= max(LEAST_COUNT, math.ceil(LEAST_SHARE * n1))).toPandas()
    if not len(toxic):
        return none
    hashes = toxic["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes, pos = hashes[order], toxic["n"].to_numpy(float)[order]
    other = counted(labelled.where("toxic = 0"), hashes).toPandas()
    neg = np.zeros(len(hashes))
    neg[np.searchsorted(hashes, other["feature"].to_numpy(np.int64).view(np.uint64))] = other["n"].to_numpy(float)
    weights = np.log((pos + PRIOR) / (n1 + 2 * PRIOR)) - np.log((neg + PRIOR) / (n0 + 2 * PRIOR))
    weights -= np.sqrt(1 / (pos + PRIOR) + 1 / (neg + PRIOR))  # a standard error below: rare features count less
    keep = weights >= LEAST_WEIGHT
    scorer = Scorer(model, hashes[keep], weights[keep], none.slope)
    # the logistic sees one row for each rounded triple of weights, with its number of documents
    x = weigh(labelled, text, ["toxic"], scorer).select("toxic", *[F.round(F.col("heaviest")[i], 0).alias(f"h{i}") for i in range(HEAVIEST)])
    table = x.groupBy("toxic", *[f"h{i}" for i in range(HEAVIEST)]).count().toPandas()
    scorer.slope = logistic(table[[f"h{i}" for i in range(HEAVIEST)]].to_numpy(float), table["toxic"].to_numpy(float), table["count"].to_numpy(float))
    return scorer


def weigh(docs: DataFrame, text: str, keep: list[str], scorer: Scorer, with_text: bool = False) -> DataFrame:
    """``keep`` with the heaviest weights of each row and its ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    known: dict[tuple[str, bool], list[str]] = {}

    def run(texts: Texts, lo: int, hi: int) -> dict[str, pa.Array]:
        x = shared.value.heaviest(texts, lo, hi, known)
        return {"heaviest": nested(pa.array(x.ravel()), np.full(hi - lo, HEAVIEST)), "score": pa.array(shared.value.scores(np.round(x)))}

    return map_blocks(docs, text, keep, "heaviest array<double>, score double", run, with_text=with_text)


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str) -> DataFrame:
    """Texts with their label; several labels of one id count as toxic if one is.

    Labels are narrow: up to BROADCAST_ROWS of them go to the texts, so that no text is shuffled. Of more, Spark picks the join by measured size.
    """
    known = stored(labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("id_")).agg(F.max("toxic").alias("toxic")), "known")
    return docs.select(F.col(id_col).alias("id_"), text).join(small_side(known, known.count()), "id_").select(text, "toxic")


def score(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, keep: list[str], learn_from=None, with_text: bool = False) -> DataFrame:
    """``keep`` and ``score`` for every row; learned from the rows of ``docs`` that ``learn_from`` allows and that have a label.

    Null and empty texts have the score of a text without features. Without labels of both kinds every text has
    one score, from the share of toxic rows. Only the named columns are read.
    """
    allowed = docs if learn_from is None else docs.where(learn_from)
    rows = stored(labelled_rows(allowed, labels, id_col, text_col), "labelled")
    return weigh(docs, text_col, keep, learn(docs, rows, text_col), with_text).drop("heaviest")
