"""Leave-one-out pooling in tiles against a loop, and with many studies in one group."""

import math

import numpy as np
import pytest

from veilgrid.operators import meta


def without(y, v, i):
    """Random-effects pooling of all studies but one."""
    y, v = np.delete(y, i), np.delete(v, i)
    w = 1 / v
    q = max(0.0, float((w * y * y).sum() - (w * y).sum() ** 2 / w.sum()))
    c = w.sum() - (w * w).sum() / w.sum()
    tau2 = max(0.0, (q - max(len(y) - 1, 1)) / c) if c > 0 else 0.0
    wr = 1 / (v + tau2)
    return math.exp((wr * y).sum() / wr.sum()), math.sqrt(1 / wr.sum()), tau2


@pytest.mark.parametrize("tile", [3, 2048])
def test_tiles_equal_a_loop(spark, tile):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(y), float(v)) for g, n in (("a", 17), ("b", 2), ("c", 1), (None, 5)) for i, (y, v) in enumerate(zip(rng.normal(size=n), rng.uniform(0.05, 1, n)))]
    df = spark.createDataFrame(rows, "g string, id long, log_or double, var double")
    got = {(r["g"], r["left_out"]): r for r in meta.pooled_without_each(df.filter("g is not null"), "id", group=["g"], tile=tile).collect()}
    assert len(got) == 20 and got["c", 0]["pooled_random_or"] is None
    for g in "ab":
        y, v = (np.array([r[k] for r in rows if r[0] == g]) for k in (2, 3))
        for i in range(len(y)):
            pooled, se, tau2 = without(y, v, i)
            r = got[g, i]
            assert (r["pooled_random_or"], r["tau2"]) == pytest.approx((pooled, tau2), rel=1e-9, abs=1e-12)
            assert r["pooled_random_ci_high"] == pytest.approx(pooled * math.exp(1.96 * se), rel=1e-9)


def test_twenty_thousand_studies_in_one_group(spark):
    rng = np.random.default_rng(2)
    n = 20_000
    y, v = rng.normal(0.2, 0.5, n), rng.uniform(0.05, 1, n)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, v))], "id long, log_or double, var double")
    got = {r["left_out"]: r for r in meta.pooled_without_each(df, "id").collect()}
    assert len(got) == n
    for i in (0, 7, 12_345, n - 1):
        pooled, _, tau2 = without(y, v, i)
        assert (got[i]["pooled_random_or"], got[i]["tau2"]) == pytest.approx((pooled, tau2), rel=1e-9)
