"""The metric range join against all pairs."""

import numpy as np
import pytest

from veilgrid.llm import metricjoin

SCHEMA = "vec_id long, embedding array<double>, label int, cell string, home boolean, vec string, members long"


def brute(rows, least):
    n = len(rows)
    ok = [r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) > 0 and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) for r in rows]
    unit = [np.array(r[1]) / np.abs(r[1]).max() if o else None for r, o in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links = [[j for j in range(n) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    root = {r[0]: r[0] for r in rows if r[0] is not None}
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                m = min(root[rows[i][0]], root[rows[j][0]])
                changed |= root[rows[i][0]] != m or root[rows[j][0]] != m
                root[rows[i][0]] = root[rows[j][0]] = m
    return sorted(((r[0], len(links[i]), root.get(r[0]), r[0] is not None and root[r[0]] == r[0]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("cell, tile", [(metricjoin.CELL, metricjoin.TILE), (24, 7)])
def test_links_equal_all_pairs(spark, cell, tile):
    rng = np.random.default_rng(cell)
    vecs = []
    for _ in range(30):  # chains and clouds of near copies
        x = rng.normal(size=8)
        for _ in range(rng.integers(1, 9)):
            x = x + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.3])
            vecs.append(x * 10.0 ** rng.integers(-3, 3))
    vecs += [vecs[0]] * 40 + [vecs[0] * 2] + list(rng.normal(size=(60, 8)) * 0.03 + vecs[5])
    rows = [(i, v.tolist(), int(rng.integers(2))) for i, v in enumerate(vecs)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [None] * 8, 1), (904, vecs[0].tolist(), None), (None, vecs[0].tolist(), 1), (905, [1.0], 1), (906, [], 1)]
    rows += [(907, [1e200] * 8, 1), (908, [1e-200] * 8, 1), (3, rows[9][1], 0), (3, rows[9][1], 1), (909, [-0.0] + [1.0] * 7, 1), (910, [0.0] + [1.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "x", False, "y", 0) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in metricjoin.link(df, "vec_id", "embedding", "label", cell=cell, tile=tile).collect()), key=str)
    assert got == brute(rows, 0.98)


def test_empty(spark):
    assert metricjoin.link(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", "label").count() == 0


def test_replication_keeps_every_pair(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), "l", 1) for i, v in enumerate(x)], "cls long, vec array<double>, label string, weight long")
    placed = metricjoin.cells(df, 0.2, 32).collect()
    home = {r["cls"]: r["cell"] for r in placed if r["home"]}
    assert len(home) == 400 and len(set(home.values())) > 8
    members = {(r["cell"], r["cls"]) for r in placed}
    near = np.argwhere(np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.2)
    assert all((home[a], b) in members for a, b in near.tolist())
