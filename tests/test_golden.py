"""Published results of the six-region synthesis, recomputed from its inputs."""

import math

import pytest
from pyspark.sql import functions as F

from veilgrid.functions import labels
from veilgrid.functions.numeric import se_from_ci
from veilgrid.operators import exposure, meta

# Region, odds ratio, lower and upper limit, cells.
REGIONS = [
    ("Po", 1.32894, 1.129, 1.55664, 2255), ("Chao Phraya", 3.56187, 2.25134, 5.78079, 18077), ("Indus", 3.3894, 2.32898, 4.86955, 7087),
    ("Rhone", 1.59178, 1.23975, 2.07457, 3392), ("Brantas", 1.59171, 1.01473, 2.69633, 1320), ("Rhine", 0.810149, 0.544942, 1.26623, 9011),
]
# Pooled odds ratio and limits, tau2 without each region.
WITHOUT = {
    "Po": (1.896379515343537, 1.1445852185829057, 3.141972487349662, 0.2888242488647115),
    "Chao Phraya": (1.5622205556559021, 1.0799641544552874, 2.2598278419201727, 0.14603576242101626),
    "Indus": (1.5449679104690053, 1.0961680158110028, 2.177518236210341, 0.11854278599393127),
    "Rhone": (1.819428857341335, 1.0957389065697634, 3.021085905664732, 0.2942318057727878),
    "Brantas": (1.8068303624205668, 1.1679612674236133, 2.7951577245076322, 0.21648415135138063),
    "Rhine": (2.0471147011437973, 1.3840202562499095, 3.0279026476172733, 0.16592370156149513),
}


@pytest.fixture(scope="module")
def studies(spark):
    df = spark.createDataFrame(REGIONS, "region string, odds double, lo double, hi double, n_cells bigint")
    return df.withColumn("log_or", F.log("odds")).withColumn("var", F.pow(se_from_ci("lo", "hi"), F.lit(2.0))).withColumn("signal", labels.signal_class("odds", "lo", "hi"))


def test_pooled(studies):
    r = meta.pooled_effects(studies).first()
    assert r.k == 6
    assert r.random_or == pytest.approx(1.770236788348802, rel=1e-10)
    assert r.random_ci_low == pytest.approx(1.2118630603494314, rel=1e-10)
    assert r.random_ci_high == pytest.approx(2.5858848159955397, rel=1e-10)
    assert r.tau2 == pytest.approx(0.188553, abs=1e-6)


def test_without_each(studies):
    rows = {r.left_out: r for r in meta.pooled_without_each(studies, "region").collect()}
    assert set(rows) == set(WITHOUT)
    for name, (odds, lo, hi, tau2) in WITHOUT.items():
        r = rows[name]
        assert (r.pooled_random_or, r.pooled_random_ci_low, r.pooled_random_ci_high, r.tau2) == pytest.approx((odds, lo, hi, tau2), rel=1e-9)


def test_weighted(studies):
    r = exposure.weighted_odds_ratio(studies, "odds", {"cells": "n_cells"}).first()
    assert r.cells == pytest.approx(2.205861435639213, rel=1e-12)


def test_signals(studies):
    got = {r.region: r.signal for r in studies.collect()}
    assert got == {"Po": "positive", "Chao Phraya": "strong_positive", "Indus": "strong_positive", "Rhone": "positive", "Brantas": "positive", "Rhine": "inconclusive"}


def test_one_study(spark):
    one = spark.createDataFrame([("a", 0.3, 0.04)], "region string, log_or double, var double")
    r = meta.pooled_effects(one).first()
    assert r.tau2 == 0 and r.i2 == 0 and r.random_or == pytest.approx(math.exp(0.3))


def test_subsets_overlap(studies):
    rows = {r.subset: r for r in meta.pooled_subsets(studies, {"all": F.lit(True), "positive": F.col("signal") != "inconclusive"}).collect()}
    assert rows["all"].k == 6 and rows["positive"].k == 5
    assert rows["positive"].random_or == pytest.approx(WITHOUT["Rhine"][0], rel=1e-9)
