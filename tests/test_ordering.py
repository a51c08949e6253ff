"""Global order operators against numpy and pandas, with a group that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilgrid.operators import ordering


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 6000
    return pd.DataFrame({
        "id": np.arange(n), "g": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n)),
        "v": np.where(rng.random(n) < 0.3, 7.0, np.round(rng.normal(0, 10, n), 1)), "w": rng.integers(1, 5, n),
    })


def test_rank_and_total(spark, frame):
    got = ordering.global_rank(spark.createDataFrame(frame), [F.col("v").desc(), F.col("id")], ["g"], total="n").toPandas().set_index("id")
    want = frame.sort_values(["v", "id"], ascending=[False, True])
    want["rank"] = want.groupby("g").cumcount() + 1
    want = want.set_index("id")
    assert (got["rank"].sort_index() == want["rank"].sort_index()).all()
    assert (got["n"].sort_index() == frame.set_index("id").groupby("g")["v"].transform("size")).all()


def test_running_total(spark, frame):
    got = ordering.running_total(spark.createDataFrame(frame), ["v", "id"], "w", out="run").toPandas().set_index("id")["run"].sort_index()
    want = frame.sort_values(["v", "id"]).set_index("id")["w"].cumsum().sort_index()
    assert (got == want).all()


def test_quantiles(spark, frame):
    probs = {"a": 0.025, "b": 0.5, "c": 0.975, "lo": 0.0, "hi": 1.0}
    got = ordering.exact_quantiles(spark.createDataFrame(frame), "v", probs, ["g"]).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert list(got.loc[g, list(probs)]) == pytest.approx(list(np.quantile(part["v"], list(probs.values()))))


def test_nearest_rank_rounds_half_even(spark):
    for n in (2, 3, 6, 11):
        df = spark.createDataFrame([(float(i),) for i in range(n)], "x double")
        got = ordering.exact_quantiles(df, "x", {"m": 0.5, "q": 0.25}, nearest=True).first()
        assert got.m == round(0.5 * (n - 1)) and got.q == round(0.25 * (n - 1))


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,), (float("inf"),)], "x double")
    assert ordering.exact_quantiles(df, "x", {"m": 0.5}).first().m == 2.0


def test_next_in_group(spark, frame):
    f = frame.sort_values(["g", "id"])
    want = f.assign(nxt=f.groupby("g")["v"].shift(-1)).set_index("id")["nxt"].sort_index()
    got = ordering.with_next(spark.createDataFrame(frame), ["g"], ["id"], {"v": "nxt"}).toPandas().set_index("id")["nxt"].sort_index()
    assert (got.isna() == want.isna()).all() and (got.dropna() == want.dropna()).all()


def test_ntile(spark):
    for n in (7, 10, 23):
        df = spark.range(1, n + 1).withColumn("n", F.lit(n))
        got = [r[0] for r in df.orderBy("id").select(ordering.ntile_of("id", "n", 10)).collect()]
        base, extra = divmod(n, 10)
        want = [t + 1 for t in range(10) for _ in range(base + (t < extra))]
        assert got == want


def test_zscore_constant_and_train(spark):
    df = spark.createDataFrame([(1.0, 5.0, True), (3.0, 5.0, True), (None, 5.0, False), (9.0, 5.0, False)], "x double, c double, t boolean")
    rows = ordering.zscore(df, ["x", "c"], train=F.col("t")).collect()
    assert sorted(r.x_z for r in rows) == [-1.0, 0.0, 1.0, 7.0]
    assert all(r.c_z == 0 for r in rows)


def test_first_by(spark, frame):
    got = ordering.first_by(spark.createDataFrame(frame), ["g"], [F.col("v"), F.col("id")], ["id", "v"]).toPandas().set_index("g")
    want = frame.sort_values(["v", "id"]).groupby("g").first()
    assert (got["id"].sort_index() == want["id"].sort_index()).all()


def test_selection_of_hard_distributions(spark, monkeypatch):
    rng = np.random.default_rng(8)
    parts = {
        "wide": 10.0 ** rng.uniform(-300, 300, 3000) * rng.choice([-1, 1], 3000), "ties": np.repeat([1.0, 2.0, 3.0], [1500, 2, 1500]),
        "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "same": np.full(999, 5.0), "smooth": rng.normal(size=5000),
    }
    frame = pd.DataFrame({"g": np.repeat(list(parts), [len(p) for p in parts.values()]), "x": np.concatenate(list(parts.values()))}).sample(frac=1, random_state=1)
    df = spark.createDataFrame(frame)
    probs = {"a": 0.0, "b": 0.0005, "c": 0.05, "d": 0.5, "e": 0.97, "f": 1.0}

    def check():
        got = ordering.exact_quantiles(df, "x", probs, ["g"]).toPandas().set_index("g")
        for g, p in parts.items():
            assert list(got.loc[g, list(probs)]) == pytest.approx(list(np.quantile(p, list(probs.values()))), rel=1e-12), g
        near = ordering.exact_quantiles(df, "x", probs, ["g"], nearest=True).toPandas().set_index("g")
        for g, p in parts.items():
            assert list(near.loc[g, list(probs)]) == [np.sort(p)[round(q * (len(p) - 1))] for q in probs.values()], g

    check()
    # brackets that miss their ranks fall back to the whole range
    monkeypatch.setattr(ordering, "MARGIN", -400.0)
    check()


def test_selection_of_nothing(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert ordering.exact_quantiles(none, "x", {"m": 0.5}).first().m is None
    assert ordering.exact_quantiles(none, "x", {"m": 0.5}, ["g"]).count() == 0
