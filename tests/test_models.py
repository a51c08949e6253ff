"""Model operators against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilgrid.operators import binomial as B
from veilgrid.operators import regression as R


def newton(x, y, t, m=None, ridge=1e-6):
    m = np.ones(len(y)) if m is None else m
    beta, pen = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pen[0, 0] = 0
    for _ in range(100):
        eta = x @ beta
        p = 1 / (1 + np.exp(-eta))
        v = np.clip(t * p * (1 - p), 1e-12, None)
        h = (x.T * (m * v)) @ x + pen
        new = np.linalg.solve(h, (x.T * (m * v)) @ (eta + (y - t * p) / v))
        done = np.abs(new - beta).max() < 1e-9
        beta = new
        if done:
            break
    p = 1 / (1 + np.exp(-x @ beta))
    v = np.clip(t * p * (1 - p), 1e-12, None)
    return beta, np.linalg.inv((x.T * (m * v)) @ x + pen), p


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    n = 900
    x = np.column_stack([np.ones(n), rng.random(n) < 0.4, rng.normal(size=(n, 2))]).astype(float)
    t = rng.integers(3, 9, n).astype(float)
    y = rng.binomial(t.astype(int), 1 / (1 + np.exp(-(x @ [0.2, 0.8, -0.5, 0.1])))).astype(float)
    block = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 9, n))
    return x, y, t, block


def rows(spark, data, extra=None):
    x, y, t, block = data
    data = [(a.tolist(), float(b), float(c), int(d)) for a, b, c, d in zip(x, y, t, block)]
    return spark.createDataFrame(data, "x array<double>, y double, t double, block int").repartition(3)


def test_fit(spark, data):
    x, y, t, _ = data
    fit = B.fit_binomial(rows(spark, data), 4)
    beta, cov, p = newton(x, y, t)
    assert fit.converged[0] and fit.beta[0] == pytest.approx(beta, abs=1e-8)
    assert fit.cov[0] == pytest.approx(cov, abs=1e-9)
    assert fit.log_likelihood[0] == pytest.approx((y * np.log(p) + (t - y) * np.log(1 - p)).sum())


def test_agrees_with_spark_ml(spark, data):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GeneralizedLinearRegression

    df = rows(spark, data).select(array_to_vector(F.slice("x", 2, 3)).alias("features"), (F.col("y") / F.col("t")).alias("label"), F.col("t").alias("w"))
    ml = GeneralizedLinearRegression(family="binomial", weightCol="w", maxIter=50, tol=1e-10).fit(df)
    fit = B.fit_binomial(rows(spark, data), 4)
    assert fit.beta[0] == pytest.approx([ml.intercept, *ml.coefficients], abs=1e-5)


def test_sandwich(spark, data):
    x, y, t, block = data
    beta, bread, p = newton(x, y, t)
    got = B.sandwich(rows(spark, data), ["block"], beta, bread)
    s = np.stack([((y - t * p)[:, None] * x)[block == b].sum(axis=0) for b in np.unique(block)])
    assert got == pytest.approx(bread @ s.T @ s @ bread, abs=1e-10)


def test_leave_block_out(spark, data):
    x, y, t, block = data
    got = B.leave_block_out(rows(spark, data), 4, ["block"], at_once=3).collect()
    assert sorted(r.block for r in got) == sorted(set(block.tolist())) and all(r.converged for r in got)
    for r in got:
        keep = block != r.block
        beta, cov, _ = newton(x[keep], y[keep], t[keep])
        assert r.beta == pytest.approx(beta, abs=1e-7) and r.cov == pytest.approx(cov.ravel(), abs=1e-7)
        assert r.n_cells_left_out == (~keep).sum()


def test_bootstrap_uses_draw_counts(spark, data):
    x, y, t, block = data
    tagged = B.with_draws(rows(spark, data), ["block"], [], 6, 11).toPandas()
    per_block = tagged.groupby("block")["m"].first()
    counts = np.array([[np.count_nonzero(np.asarray(per_block[b]) == r) for b in sorted(per_block.index)] for r in range(6)])
    assert (counts.sum(axis=1) == len(per_block)).all()
    fit = B.bootstrap_fits(rows(spark, data), 4, ["block"], [], 6, 11)
    for r in range(6):
        assert fit.beta[r] == pytest.approx(newton(x, y, t, counts[r][block])[0], abs=1e-7)


def test_left_out_of_nothing(spark, data):
    assert B.leave_block_out(rows(spark, data).limit(0), 4, ["block"]).count() == 0


def test_replicate_effect_weights(spark, data):
    block = data[3]
    base = rows(spark, data).withColumns({"region": F.when(F.col("block") % 2 == 0, "a").otherwise("b"), "pop_z": F.col("x")[1], "built_z": F.col("x")[2],
                                          "lc": F.when(F.col("y") > 1, "wet").otherwise("dry")})
    tagged = B.with_draws(base, ["block"], ["region"], 5, 3)
    terms = ["intercept", "strong_subsidence", "strong_x_b", "strong_x_lc_wet", "strong_x_population_z", "strong_x_builtup_z"]
    got = B.replicate_effect_weights(tagged, ["block"], "region", ["a", "b"], "lc", terms, 5)
    cells = tagged.toPandas()
    for rep in range(5):
        drawn = np.repeat(np.arange(len(cells)), [list(m).count(rep) for m in cells["m"]])
        for name, own in (("a", cells.iloc[drawn][lambda f: f["region"] == "a"]), ("b", cells.iloc[drawn][lambda f: f["region"] == "b"]), ("ALL", cells.iloc[drawn])):
            want = [0, 1, (own["region"] == "b").mean(), (own["lc"] == "wet").mean(), own["pop_z"].mean(), own["built_z"].mean()]
            assert got[name][rep] == pytest.approx(want)


def test_infer_trials(spark):
    df = spark.createDataFrame([(3, 3 / 7), (0, 0.0), (5, 5 / 7)], "n int, f double")
    assert B.infer_trials(df, "n", "f").first().n_pairs == 7
    with pytest.raises(Exception, match="no positive observable fraction"):
        B.infer_trials(df.filter("f = 0"), "n", "f").collect()


def wls(x, y, w, ridge):
    pen = ridge * np.eye(x.shape[1])
    pen[0, 0] = 0
    a = (x.T * w) @ x + pen
    return np.linalg.solve(a, (x.T * w) @ y), np.linalg.pinv(a)


@pytest.fixture(scope="module")
def studies():
    rng = np.random.default_rng(8)
    f = pd.DataFrame({"id": np.arange(14), "a": rng.normal(size=14), "b": rng.normal(3, 2, 14), "c": 0.3, "y": rng.normal(size=14), "v": rng.uniform(0.05, 0.5, 14)})
    f.loc[[2, 9], "b"] = np.nan
    return f


def frame(spark, f):
    return spark.createDataFrame(f).withColumn("b", F.nanvl("b", F.lit(None).cast("double"))).withColumn("w", 1 / F.col("v"))


def test_wls(spark, studies):
    got = R.wls_ridge(frame(spark, studies), ["a"], "y", F.col("w"), 0.01).orderBy("position").toPandas()
    beta, cov = wls(np.column_stack([np.ones(14), studies["a"]]), studies["y"], 1 / studies["v"].to_numpy(), 0.01)
    assert got["beta"].to_numpy() == pytest.approx(beta) and got["se"].to_numpy() == pytest.approx(np.sqrt(np.diag(cov)))


def test_wls_leave_one_out(spark, studies):
    got = R.wls_leave_one_out(frame(spark, studies), "id", ["a"], "y", F.col("w"), 0.01).toPandas().set_index("id")
    x, w, y = np.column_stack([np.ones(14), studies["a"]]), 1 / studies["v"].to_numpy(), studies["y"].to_numpy()
    for i in range(14):
        k = np.arange(14) != i
        beta, cov = wls(x[k], y[k], w[k], 0.01)
        assert got.loc[i, "predicted_log_or"] == pytest.approx(x[i] @ beta)
        assert got.loc[i, "predicted_se"] == pytest.approx(np.sqrt(x[i] @ cov @ x[i]))


def test_standardized_leave_one_out(spark, studies):
    """Missing values and a constant column, against a refit of every fold."""
    got = R.standardized_leave_one_out(frame(spark, studies), "id", ["a", "b", "c"], "y", F.col("w")).toPandas().set_index("id")
    raw, w, y = studies[["a", "b", "c"]].to_numpy(), 1 / studies["v"].to_numpy(), studies["y"].to_numpy()
    for i in range(14):
        k = np.arange(14) != i
        mean, sd = np.nanmean(raw[k], axis=0), np.nanstd(raw[k], axis=0)
        sd = np.where(sd < 1e-9, 1.0, sd)
        z = (np.where(np.isnan(raw), mean, raw) - mean) / sd
        x = np.column_stack([np.ones(14), z])
        beta, _ = wls(x[k], y[k], w[k], 1e-3)
        assert got.loc[i, "predicted_log_or"] == pytest.approx(x[i] @ beta, rel=1e-8)


def test_bootstrap_cells_stand_side_by_side(spark, data):
    """More replicates than are worked out at once and a block longer than a pack, whose cells carry no list of draws each."""
    x, y, t, block = data
    block = np.where(np.arange(len(y)) < 600, 0, block)
    base = rows(spark, (x, y, t, block)).withColumn("s", F.lit("all"))
    drawn = B.drawn_blocks(base, ["block"], ["s"], 300, 5)
    assert B._packed(base, 4, drawn, ["s", "block"], 300).count() < len(y) / 4
    fit = B.bootstrap_fits(base, 4, ["block"], ["s"], 300, 5, drawn=drawn)
    counts = {r["block"]: np.frombuffer(r["drawn"], np.uint8) for r in drawn.collect()}
    for r in (0, 255, 256, 299):
        m = np.array([counts[b][r] for b in block.tolist()], float)
        beta, cov, _ = newton(x, y, t, m)
        assert fit.beta[r] == pytest.approx(beta, abs=1e-7) and fit.cov[r] == pytest.approx(cov, abs=1e-7)


def test_left_out_blocks_without_passes_over_all_cells(spark, monkeypatch):
    """Many small blocks settle on their own cells; the one that weighs much goes over all cells."""
    rng = np.random.default_rng(12)
    n = 40_000
    x = np.column_stack([np.ones(n), rng.random(n) < 0.4, rng.normal(size=(n, 2)).clip(-2, 2)]).astype(float)
    t = np.full(n, 5.0)
    y = rng.binomial(5, 1 / (1 + np.exp(-(x @ [0.2, 0.8, -0.5, 0.1])))).astype(float)
    block = np.where(np.arange(n) < 15_000, 0, np.arange(n) // 25)
    passed, sums = [], B._sums
    monkeypatch.setattr(B, "_sums", lambda r, betas, omit=None: passed.extend([] if omit is None else omit.tolist()) or sums(r, betas, omit))
    got = {r["block"]: r for r in B.leave_block_out(rows(spark, (x, y, t, block)), 4, ["block"]).collect()}
    assert len(got) == 1001 and all(r["converged"] for r in got.values()) and set(passed) == {0}
    for b in (0, 600, 1111, 1599):
        beta, cov, p = newton(x[block != b], y[block != b], t[block != b])
        assert got[b]["beta"] == pytest.approx(beta, abs=1e-8) and got[b]["cov"] == pytest.approx(cov.ravel(), rel=1e-7, abs=1e-12)
        keep = block != b
        assert got[b]["log_likelihood"] == pytest.approx((y[keep] * np.log(p) + (t - y)[keep] * np.log(1 - p)).sum(), rel=1e-10)
