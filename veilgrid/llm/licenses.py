"""License scans by diagonal voting.

Every run of k words of every text is hashed and joined with the positions of the same run in the
templates. A hit votes for the diagonal (place in the text less place in the template) of its text and
template. For the base phrases a diagonal with a vote for each run of the phrase is a place where the words
stand consecutively. For the longer templates neighbouring diagonals are merged, which bridges words
put in or left out, and a span is verified by the share of the template's places that it holds in order, each
once. A hit counts only if the words themselves are equal, not their hash alone.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .neardup import stored
from .scan import ALNUM, Texts, Words, hash_gram, longs, map_blocks

#: Phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Sentences of well-known license texts and their labels (fixed values).
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution international license": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 3 clause license": "bsd",
    "bsd 2 clause license": "bsd",
}

#: Words of a run for phrases and for templates.
SHORT, LONG = 2, 3
#: Diagonals this close belong to one span.
NEAR = 3
#: Share of a template's runs that a span must cover for its label.
COVER = 0.6
#: Templates of at most so many runs must be covered whole.
FEW = 5


def _runs(texts: Texts, lo: int, hi: int) -> dict[str, pa.Array]:
    """One row for each word of each text, with the runs that begin there and their words, and one row (place null) for the text."""
    w = Words(texts, lo, hi, ALNUM)
    n, size = len(w.hashes), hi - lo
    short, long_ = np.zeros(n, np.int64), np.zeros(n, np.int64)
    has = [np.zeros(n, bool), np.zeros(n, bool)]
    for k, out, ok in ((SHORT, short, has[0]), (LONG, long_, has[1])):
        at, grams = w.grams(k)
        out[at], ok[at] = grams.view(np.int64), True
    place = np.arange(n) - w.first[w.rows]
    some = has[0]
    start = w.starts[some]
    size_of = w.ends[np.flatnonzero(some) + np.where(has[1][some], LONG, SHORT) - 1] - start
    upto = np.cumsum(size_of)
    words = w.bytes[np.repeat(start - (upto - size_of), size_of) + np.arange(int(size_of.sum()))]
    offsets = np.concatenate([[0], upto, np.full(size, upto[-1] if len(upto) else 0)])
    pad = np.zeros(size, np.int64)
    null = np.ones(size, bool)
    cols = {
        "of_row": np.concatenate([w.rows[some], np.arange(size)]),
        "place": pa.array(np.concatenate([place[some], pad]), pa.int64(), mask=np.concatenate([~some[some], null])),
        "short_run": pa.array(np.concatenate([short[some], pad]), pa.int64(), mask=np.concatenate([~some[some], null])),
        "long_run": pa.array(np.concatenate([long_[some], pad]), pa.int64(), mask=np.concatenate([~has[1][some], null])),
        "words": pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words)]).cast(pa.string()),
        "n_words": pa.array(np.concatenate([np.zeros(int(some.sum()), np.int64), w.counts]), pa.int64(), mask=np.concatenate([some[some], ~null])),
    }
    return cols


def positions(spark: SparkSession, texts: dict[str, str], k: int, run: str, prefix: str) -> DataFrame:
    """A row for each run of k words of each text: its hash and words, the text's number and the place in it."""
    rows = []
    for number, text in enumerate(texts):
        words = text.split()
        rows += [(hash_gram(words[i : i + k]), " ".join(words[i : i + k]), number, i, len(words) - k + 1) for i in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, f"{run} long, {prefix}_words string, {prefix}_no int, {prefix}_at int, {prefix}_runs int")


def longest_span(hits: list[dict], near: int, runs: int) -> tuple[int, int, int]:
    """(places of the template, first and last place in the text) of the longest span among ``hits``.

    A span holds places of the template in order, each once; successive hits lie at most ``near`` diagonals apart, so
    only hits within ``runs + near`` words can be followed. ``hits`` are sorted by place; of equal spans the first counts.
    """
    best, recent = (0, 0, 0), deque()
    for hit in hits:
        place, at = hit["place"], hit["at"]
        while recent and recent[0][0] < place - runs - near:
            recent.popleft()
        held, first = 0, place
        for q, b, n, start in recent:
            if n > held and q < place and b < at and abs(place - at - q + b) <= near:
                held, first = n, start
        recent.append((place, at, held + 1, first))
        if held + 1 > best[0]:
            best = held + 1, first, place
    return best


def spans(hits: DataFrame) -> DataFrame:
    """(row_, no, runs, votes, from_word, to_word): the longest verified span of each template hit in each text.

    ``hits`` has (row_, no, runs, place, at). The hits of one text and template are one value, no longer than the text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [longest_span(h, NEAR, n) for h, n in zip(batch.column("hits").to_pylist(), batch.column("runs").to_pylist())]
            votes, lo, hi = np.array(found, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_"), batch.column("no"), batch.column("runs"), pa.array(votes), pa.array(lo), pa.array(hi + LONG - 1)],
                names=["row_", "no", "runs", "votes", "from_word", "to_word"])

    of = hits.groupBy("row_", "no", "runs").agg(F.sort_array(F.collect_set(F.struct("place", "at"))).alias("hits"))
    return of.mapInArrow(run, "row_ long, no int, runs int, votes long, from_word long, to_word long")


def scan(docs: DataFrame, id_col: str, text_col: str, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Base places of ``phrases``, and labels by ``phrases`` and ``templates``, for every row of ``docs``.

    Phrases need at least SHORT words and templates at least LONG, and no text may be in either twice with the same
    words. Null and empty texts have no words and no labels. Rows repeating an id are rows of their own. An empty table
    gives no rows. Only the two named columns are read. ``score`` is the best covered share of any template or
    phrase (1 for a base place), 0 if nothing was hit.
    """
    spark = docs.sparkSession
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_"), F.monotonically_increasing_id().alias("row_"))
    runs = map_blocks(base, "text_", ["doc_id", "row_"], "place long, short_run long, long_run long, words string, n_words long", _runs, rows="of_row")
    # both sides are a few hundred rows made from the fixed texts above
    hits = runs.join(F.broadcast(positions(spark, phrases, SHORT, "short_run", "p")), "short_run", "left").join(
        F.broadcast(positions(spark, templates, LONG, "long_run", "t")), "long_run", "left"
    )
    hits = hits.where("place is null or p_no is not null or t_no is not null")
    words = F.regexp_replace("words", "\\x00+", " ")
    same = {"p": F.substring_index(words, " ", SHORT) == F.col("p_words"), "t": words == F.col("t_words")}
    hits = hits.withColumns({f"{x}_no": F.when(ok, F.col(f"{x}_no")) for x, ok in same.items()})
    hits = stored(hits.drop("short_run", "long_run", "words", "p_words", "t_words"), "hits")
    texts = hits.where("place is null").select("doc_id", "row_", "n_words")

    def of(prefix: str) -> DataFrame:
        """Hits of one kind: text, number of the phrase or template, its runs, and both places."""
        return hits.where(f"{prefix}_no is not null").select("row_", F.col(f"{prefix}_no").alias("no"), F.col(f"{prefix}_runs").alias("runs"), "place", F.col(f"{prefix}_at").alias("at")).distinct()

    label = lambda texts: F.element_at(F.array(*[F.lit(v) for v in texts.values()]), F.col("no") + 1)
    votes = of("p").groupBy("row_", "no", (F.col("place") - F.col("at")).alias("diagonal"), "runs").agg(F.count("*").alias("votes"))
    places = votes.where("votes = runs").withColumn("label", label(phrases))
    based = places.groupBy("row_").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base_set")
    )
    held = spans(of("t")).withColumn("cover", F.col("votes") / F.col("runs"))
    held = held.withColumn("label", F.when((F.col("cover") >= COVER) & ((F.col("runs") > FEW) | (F.col("votes") >= F.col("runs"))), label(templates)))
    tagged = held.groupBy("row_").agg(F.max("cover").alias("cover"), F.collect_set("label").alias("more_set"))
    out = texts.join(based, "row_", "left").join(tagged, "row_", "left")
    none = F.array().cast("array<string>")
    base_set = F.coalesce("base_set", none)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.array_join(base_set, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, F.coalesce("more_set", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
