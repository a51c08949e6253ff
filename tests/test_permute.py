"""Shuffles by keyed permutations: exact bijections, even chances, and the same sums as a loop."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.operators import permute


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 257])
def test_each_shuffle_is_a_permutation(n):
    keys = permute.round_keys(12345, np.arange(200))
    places = permute.permuted(np.arange(n), n, keys)
    assert (np.sort(places, axis=0) == np.arange(n)[:, None]).all()


@pytest.mark.parametrize("n", [1, 3, 64, 65, 154, 1000, 3_000_000])
def test_chosen_is_a_place_below_k(n):
    keys = permute.round_keys(5, np.arange(60))
    for at in (np.arange(min(n, 300)), np.arange(max(0, n - 300), n)):
        for k in (0, 1, n // 3, n * 7 // 10, n - 1, n):
            assert (permute.chosen(at, n, k, keys) == (permute.permuted(at, n, keys) < k)).all()


def test_places_are_even():
    places = permute.permuted(np.arange(40), 40, permute.round_keys(7, np.arange(4000)))
    chosen = places < 10
    assert np.abs(chosen.mean(axis=1) - 0.25).max() < 0.035  # five standard errors
    pairs = (chosen[:20] & chosen[20:]).mean(axis=1)
    assert np.abs(pairs - 0.25 * 9 / 39).max() < 0.04


def test_sums_equal_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(i, m, f"s{rng.integers(3)}", bool(rng.random() < 0.4), float(rng.integers(100)) if rng.random() < 0.9 else None) for m in ("one", "two") for i in range(150)]
    rows += [(999, "one", "lonely", False, 5.0), (998, "two", "single", True, 7.0)]
    df = spark.createDataFrame(rows, "id long, model string, stratum string, label boolean, x double")
    got = permute.shuffled_sums(df, "id", "label", {"x": F.col("x"), "n": F.lit(1)}, 30, 5, "stratum", ["model"]).collect()
    want = {}
    for model in ("one", "two"):
        for stratum in {r[2] for r in rows if r[1] == model}:
            cells = sorted(r for r in rows if r[1] == model and r[2] == stratum)
            k = sum(r[3] for r in cells)
            start = int(hashlib.md5(f"5|{model}|{stratum}".encode()).hexdigest()[:8], 16)
            places = permute.permuted(np.arange(len(cells)), len(cells), permute.round_keys(start, np.arange(30)))
            for rep in range(30):
                x, n = want.get((model, rep), (0.0, 0))
                chosen = [c for c, p in zip(cells, places[:, rep]) if p < k]
                want[model, rep] = (x + sum(c[4] or 0.0 for c in chosen), n + len(chosen))
    assert {(r["model"], r["rep"]): (r["x"], r["n"]) for r in got} == want


def test_a_null_range_of_a_real_difference(spark):
    # the label goes with the value, so no shuffle reaches the observed sum
    rows = [(i, "m", "all", i >= 80, float(i >= 80)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, model string, stratum string, label boolean, x double")
    draws = permute.shuffled_sums(df, "id", "label", {"x": F.col("x")}, 1000, 1, "stratum", ["model"]).agg(F.avg("x"), F.max("x"), F.count("x")).first()
    assert draws[0] == pytest.approx(4.0, abs=0.2) and draws[1] < 20 and draws[2] == 1000
