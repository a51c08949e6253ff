"""Ids of the packing operator are those of the tokenizer file's own library, added tokens included."""

import random

import numpy as np
from tokenizers import Tokenizer

from veilgrid.llm import packing, queries


def test_ids_equal_the_library():
    own = Tokenizer.from_file(queries.TOKENIZER)
    cutter = packing.TokenCutter(queries.file_bytes(queries.TOKENIZER).decode(), queries.public_tokenizers.PATTERN, 0)
    rng = random.Random(1)
    words = ["<|endoftext|>", "<|endoftext", "|>", "hello", " world", "naïve", "日本", "🎉", "\n\n", "  ", "12", "don't", "\x00", "é"]
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x" * 50000] + ["".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    for t in texts:
        assert cutter(t).tolist() == [*own.encode(t, add_special_tokens=False).ids, 0]
    assert cutter("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995, 0]


def test_order_by_score_is_the_whole_order():
    rng = np.random.default_rng(1)
    for n in (0, 5, 129, 1000):
        score = rng.integers(-1, 6, n).astype(float) + (rng.random(n) < 0.2) * rng.random(n)
        assert list(packing.by_score(score)) == np.argsort(-score, kind="stable").tolist()
