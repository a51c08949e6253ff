"""Token alignment and the perfect hash against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilgrid.llm import alignment, queries
from veilgrid.llm.packing import byte_symbols

A_FILE, PATTERN, B_MODEL = queries.file_bytes(queries.TOKENIZER).decode(), queries.public_tokenizers.PATTERN, queries.file_bytes(queries.PIECES)
DOC = "doc_id long, text string, key long, shard long, n_a long, row_ string"


def brute(texts):
    a = Tokenizer.from_str(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=B_MODEL)
    symbols = byte_symbols()
    docs = []
    for t in texts:
        x, y = [], []
        if t:
            x = [(i, bytes(symbols[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
            raw = (" " + t).encode()
            if b"".join(s for _, s in x) != raw or b"".join(s for _, s in y) != raw:
                x, y = [], []
        spans = []
        for side in (x, y):
            at, out = 0, []
            for i, s in side:
                out.append((i, at, at + len(s)))
                at += len(s)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, s = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(i) for i, u, v in side if s <= u and v <= e) for side in spans))
            s = e
        docs.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    held = Counter(p for d in docs for p in set(d[3]))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    return [(k, d[0], d[1], d[2], len(d[3]), sum(held[p] == top[p[0]] for p in d[3]), sum(held[p] for p in d[3]), d[4]) for k, d in enumerate(docs)]


@pytest.mark.parametrize("pairs", [alignment.RANGE, 100])
def test_alignment_equals_brute_force(spark, pairs):
    rng = random.Random(5)
    words = "the Haus über naïve 12345 <|endoftext|> </s> <0x41> ▁ _x 日本語 🎉 don't  a\tb\nc éé   ﬁ \x00 ́".split(" ")
    texts = ["", None, " ", "  two  spaces ", "\n\n", "a", "x" * 20000, "word " * 4000] + [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 0, 0, 0, "x") for i, t in enumerate(texts)], DOC).repartition(4)
    got = alignment.align(df, "doc_id", "text", A_FILE, PATTERN, B_MODEL, pairs)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute(texts)
    assert sorted(map(tuple, got.select(*cols).collect())) == want
    assert sum(w[1] > 0 for w in want) > 20 and any(w[1] == 0 for w in want[2:])


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(1, "same words"), (1, "same words"), (None, "same"), (2, None)]
    df = spark.createDataFrame([(*r, 0, 0, 0, "x") for r in rows], DOC)
    got = alignment.align(df, "doc_id", "text", A_FILE, PATTERN, B_MODEL).collect()
    assert sorted((str(r["doc_id"]), r["n_a"] > 0) for r in got) == [("1", True), ("1", True), ("2", False), ("None", True)]
    assert alignment.align(spark.createDataFrame([], DOC), "doc_id", "text", A_FILE, PATTERN, B_MODEL).count() == 0


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 30000))
    for shards in (1, 7):
        rows = []
        for s in range(shards):
            sizes, bits, placed = alignment.build(keys[alignment.shard_of(keys, shards) == s])
            rows.append({"shard": s, "sizes": sizes, "bits": bits.tobytes(), "keys": placed.tobytes()})
        mph = alignment.PerfectHash(shards, rows)
        assert sorted(mph(keys).tolist()) == list(range(len(keys)))
        assert (mph.keys[mph(keys)] == keys).all()
        other = np.setdiff1d(rng.integers(0, 1 << 48, 5000), keys)
        assert (mph(other) == -1).all()
