"""Resampling against direct enumeration."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilgrid.functions.draws import draw_index, hash32
from veilgrid.operators import resample


def h(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_hash_matches_md5(spark):
    r = spark.range(1).select(hash32(7, F.lit(3), "x"), draw_index(F.lit(10), 7, "y")).first()
    assert r[0] == h(7, 3, "x") and r[1] == h(7, "y") % 10


@pytest.mark.parametrize("bits", [None, 1, 12])
def test_permuted_sums_exact(spark, bits):
    """The bucketed selection equals a full sort, with most rows in one stratum."""
    rng = np.random.default_rng(2)
    n = 1500
    f = pd.DataFrame({"id": np.arange(n), "s": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n)),
                      "lab": rng.random(n) < 0.3, "w": rng.integers(0, 9, n)})
    got = resample.permuted_sums(spark.createDataFrame(f).withColumn("m", F.lit("m")), "id", "lab", {"w": F.col("w"), "one": F.lit(1)}, 3, 5, "s", ["m"], bits)
    got = got.toPandas().set_index("rep")
    for rep in range(3):
        f["h"] = [h(5, "m", rep, i) for i in f["id"]]
        picked = [part.sort_values(["h", "id"]).head(int(part["lab"].sum())) for _, part in f.groupby("s")]
        assert got.loc[rep, "w"] == sum(p["w"].sum() for p in picked)
        assert got.loc[rep, "one"] == f["lab"].sum()


def cells(spark, n=800, blocks=40):
    rng = np.random.default_rng(4)
    f = pd.DataFrame({"row": rng.integers(0, blocks, n), "col": rng.integers(0, 30, n), "vlm_mm_yr": np.round(rng.uniform(-12, 4, n), 2),
                      "n_obs": rng.integers(0, 8, n), "population": rng.integers(0, 100, n).astype(float), "builtup_m2": rng.uniform(0, 9e5, n)})
    f["base"], f["strong"], f["majority"] = True, f["vlm_mm_yr"] <= -5, f["n_obs"] >= 4
    return spark.createDataFrame(f), f


def test_one_block_is_constant(spark):
    df, _ = cells(spark)
    t = resample.bootstrap_table(resample.block_stats(df, "row", "col", 1000), [], 20, 1).first()
    for m in resample.METRICS:
        assert t[f"{m}_q025"] == t[f"{m}_q975"] == pytest.approx(t[m])
    assert t.n_blocks == 1


def test_bootstrap_replicates(spark):
    df, f = cells(spark)
    stats = resample.block_stats(df, "row", "col", 10)
    got = resample.bootstrap_blocks(stats, [], 5, 9).toPandas().set_index("rep")
    f = f.assign(br=f["row"] // 10, bc=f["col"] // 10)
    blocks = [b for _, b in f.groupby(["br", "bc"])]
    for rep in range(5):
        draw = pd.concat([blocks[h(9, rep, pos) % len(blocks)] for pos in range(1, len(blocks) + 1)])
        s = draw[draw["strong"]]
        assert got.loc[rep, resample.METRICS[0]] == pytest.approx((~s["majority"]).mean())
        assert got.loc[rep, resample.METRICS[1]] == pytest.approx(s.loc[~s["majority"], "population"].sum() / s["population"].sum())


def test_sweep_blocks_sum_up(spark):
    """Observed metrics do not depend on the block size."""
    df, _ = cells(spark)
    df = df.withColumn("n2", F.least(F.col("n_obs") + 1, F.lit(7)))
    t = resample.robustness_sweep(df, {0.3: "n_obs", 0.2: "n2"}, [3.0, 5.0], [4, 6], 7, 3, 1, "row", "col").toPandas()
    assert len(t) == 8
    assert (t.groupby(["threshold", "strong_threshold"])[resample.METRICS[3]].nunique() == 1).all()


def test_surface_rule(spark):
    df, f = cells(spark)
    t = resample.threshold_surface(df, [3.0, 6.0], [0.25, 0.6], [1, 5], 7).toPandas()
    assert list(t.sort_values("run")["run"]) == list(range(8))
    for r in t.itertuples():
        s = f[f["vlm_mm_yr"] <= -r.deformation_abs_threshold_mm_yr]
        hid = (s["n_obs"] / 7 < r.observability_fraction_threshold) | (s["n_obs"] < r.min_observable_count)
        assert (r.strong_cells, r.hidden_strong_cells) == (len(s), hid.sum())
        assert r.hidden_population == pytest.approx(s.loc[hid, "population"].sum())


def test_shifted_blocks_keep_totals(spark):
    df, f = cells(spark)
    t = resample.shifted_blocks(df, "row", "col", [3, 5]).toPandas()
    assert (t["strong_cells"] == f["strong"].sum()).all() and t["strong_hidden_population_fraction"].round(12).nunique() == 1


def test_monte_carlo_direct(spark):
    df, f = cells(spark)
    t = resample.monte_carlo(df, 30, 3, 7, (3.0, 8.0), (2, 5), (0.8, 1.2)).toPandas()
    assert len(t) == 30
    for r in t.itertuples():
        hit = (f["vlm_mm_yr"] <= -r.threshold) & (f["n_obs"] < r.min_count)
        assert r.hidden_population == pytest.approx(f.loc[hit, "population"].sum() * r.scale)


def test_monte_carlo_meets_thresholds_exactly(spark):
    df, f = cells(spark)
    # velocities on the very thresholds of the iterations, and next to them
    t = resample.monte_carlo(df, 200, 3, 7, (3.0, 8.0), (2, 5), (1.0, 1.0)).select("threshold", "min_count").toPandas()
    rows = [(True, -float(v), 1, 1.0, 1.0) for x in t["threshold"] for v in (x, np.nextafter(x, 0), np.nextafter(x, 9))]
    at = spark.createDataFrame(rows, "base boolean, vlm_mm_yr double, n_obs int, population double, builtup_m2 double")
    got = resample.monte_carlo(at, 200, 3, 7, (3.0, 8.0), (2, 5), (1.0, 1.0), bin_mm=0.3).toPandas()
    falls = np.array([-r[1] for r in rows])
    assert len(got) == 200
    for r in got.itertuples():
        assert r.hidden_population == (falls >= r.threshold).sum()


def test_null_summary(spark):
    draws = spark.createDataFrame([(float(i), 100.0) for i in range(19)], "m double, o double")
    r = resample.null_summary(draws, "m", "o").first()
    assert r.two_sided_empirical_p == pytest.approx(2 / 20) and r.null_mean == 9 and r.observed == 100
