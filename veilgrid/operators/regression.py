"""Weighted ridge regression from summed moments; only p x p systems are solved locally."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import Z95
from ..runtime import attach


def _moment_aggs(names: list[str], w: Column, y: Column) -> list[Column]:
    """Upper triangle of X'WX, X'Wy as named sums. ``names`` are columns; the first may be '1'."""
    xs = [F.lit(1.0) if n == "1" else F.col(n) for n in names]
    p = len(xs)
    out = [F.sum(w * xs[i] * xs[j]).alias(f"_m_{i}_{j}") for i in range(p) for j in range(i, p)]
    return out + [F.sum(w * xs[i] * y).alias(f"_g_{i}") for i in range(p)]


def _moment_names(p: int) -> list[str]:
    return [f"_m_{i}_{j}" for i in range(p) for j in range(i, p)] + [f"_g_{i}" for i in range(p)]


def _unpack(pdf: pd.DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(pdf)
    m, g = np.zeros((n, p, p)), np.zeros((n, p))
    for i in range(p):
        g[:, i] = pdf[f"_g_{i}"]
        for j in range(i, p):
            m[:, i, j] = m[:, j, i] = pdf[f"_m_{i}_{j}"]
    return m, g


def _solve(m: np.ndarray, g: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Ridge solution and covariance for a stack of systems; the intercept is not penalised."""
    penalty = ridge * np.eye(m.shape[-1])
    penalty[0, 0] = 0.0
    a = m + penalty
    cov = np.linalg.pinv(a)
    try:
        beta = np.linalg.solve(a, g[..., None])[..., 0]
    except np.linalg.LinAlgError:
        beta = np.einsum("nij,nj->ni", cov, g)
    return beta, cov


def wls_ridge(df: DataFrame, terms: list[str], y: str, weight: Column, ridge: float = 1e-3,
              group: list[str] | None = None) -> DataFrame:
    """Coefficient table per group: term, beta, se, z, odds ratio and limits."""
    group = group or []
    names = ["1", *terms]
    p = len(names)
    labels = ["intercept", *terms]
    moments = df.groupBy(*group).agg(*_moment_aggs(names, weight, F.col(y)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            beta, cov = _solve(*_unpack(pdf, p), ridge)
            se = np.sqrt(np.clip(np.einsum("nii->ni", cov), 0.0, None))
            for i in range(p):
                out = pdf[group].copy()
                out["position"], out["term"], out["beta"], out["se"] = i, labels[i], beta[:, i], se[:, i]
                yield out

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*[f"{g} {types[g]}" for g in group], "position int, term string, beta double, se double"])
    return coefficient_columns(moments.mapInPandas(solve, schema))


def coefficient_columns(coefs: DataFrame, beta: str = "beta", se: str = "se") -> DataFrame:
    """Add z, odds ratio and its 95 % limits; NULL limits where the error is 0."""
    b, s = F.col(beta), F.when(F.col(se) > 0, F.col(se))
    return coefs.withColumns({
        "z": b / s, "odds_ratio": F.exp(b), "odds_ratio_ci_low": F.exp(b - Z95 * s), "odds_ratio_ci_high": F.exp(b + Z95 * s),
    })


def wls_leave_one_out(df: DataFrame, key: str, terms: list[str], y: str, weight: Column, ridge: float = 1e-3,
                      group: list[str] | None = None) -> DataFrame:
    """Refit without each row and predict it: total moments less the row's own."""
    group = group or []
    names = ["1", *terms]
    p = len(names)
    total = df.groupBy(*group).agg(*[c for c in _moment_aggs(names, weight, F.col(y))])
    xs = {n: (F.lit(1.0) if n == "1" else F.col(n)) for n in names}
    joined = attach(df, total, group)
    own = [(F.col(f"_m_{i}_{j}") - weight * xs[names[i]] * xs[names[j]]).alias(f"_m_{i}_{j}") for i in range(p) for j in range(i, p)]
    own += [(F.col(f"_g_{i}") - weight * xs[names[i]] * F.col(y)).alias(f"_g_{i}") for i in range(p)]
    rest = joined.select(*group, key, F.col(y).alias("observed_log_or"), F.array(*[xs[n].cast("double") for n in names]).alias("_x"), *own)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            beta, cov = _solve(*_unpack(pdf, p), ridge)
            x = np.stack(pdf["_x"].to_numpy())
            out = pdf[[*group, key, "observed_log_or"]].copy()
            out["predicted_log_or"] = np.einsum("ni,ni->n", x, beta)
            out["predicted_se"] = np.sqrt(np.clip(np.einsum("ni,nij,nj->n", x, cov, x), 0.0, None))
            yield out

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in [*group, key]],
                        "observed_log_or double, predicted_log_or double, predicted_se double"])
    pred, se = F.col("predicted_log_or"), F.col("predicted_se")
    return rest.mapInPandas(predict, schema).withColumns({
        "residual_log_or": F.col("observed_log_or") - pred, "predicted_or": F.exp(pred),
        "predicted_or_ci_low": F.exp(pred - Z95 * se), "predicted_or_ci_high": F.exp(pred + Z95 * se),
    })


def _gram(raw: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """X'WX, X'Wy and the plain sums of x and x*x, summed over tasks; p x p numbers come back."""
    p = len(names)
    width = p * p + 3 * p

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(width)
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            xw = x * pdf["_w"].to_numpy(dtype=float)[:, None]
            acc += np.concatenate([(xw.T @ x).ravel(), xw.T @ pdf["_y"].to_numpy(dtype=float), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pd.DataFrame({"position": np.arange(width), "value": acc})

    sums = raw.mapInPandas(partial, "position int, value double").groupBy("position").agg(F.sum("value").alias("value"))
    flat = sums.orderBy("position").toPandas()["value"].to_numpy()
    return flat[: p * p].reshape(p, p), flat[p * p : p * p + p], flat[p * p + p : -p], flat[-p:]


def standardized_leave_one_out(df: DataFrame, key: str, terms: list[str], y: str, weight: Column,
                               ridge: float = 1e-3) -> DataFrame:
    """Leave-one-out where each fold standardises its predictors and imputes by its own mean.

    With x0 = x or 0 and d = "x is present", a fold's score is (x0 - mean * d) / sd, which is
    linear in the raw columns. So the fold's moments are a small transform of raw moments, and
    those are totals less the row's own: no refit passes over the data.
    """
    raw = df.select(
        key, F.col(y).alias("_y"), weight.alias("_w"), F.lit(1.0).alias("_one"),
        *[F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, t in enumerate(terms)],
        *[F.col(t).isNotNull().cast("double").alias(f"_d{i}") for i, t in enumerate(terms)],
    )
    q = len(terms)
    names = ["_one", *[f"_x{i}" for i in range(q)], *[f"_d{i}" for i in range(q)]]
    p = len(names)
    m_all, g_all, s_all, sq_all = _gram(raw, names)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            n = len(pdf)
            x = pdf[names].to_numpy(dtype=float)
            w, obs = pdf["_w"].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float)
            m = m_all - w[:, None, None] * x[:, :, None] * x[:, None, :]
            g = g_all - (w * obs)[:, None] * x
            change = np.zeros((n, p, q + 1))
            change[:, 0, 0] = 1.0
            for i in range(q):
                x0, d = x[:, 1 + i], x[:, 1 + q + i]
                count = s_all[1 + q + i] - d
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = (s_all[1 + i] - x0) / count
                    var = (sq_all[1 + i] - x0 * x0) / count - mean * mean
                mean = np.where(np.isfinite(mean), mean, 0.0)
                spread = np.isfinite(var) & (var > 1e-13 * mean * mean)
                sd = np.sqrt(np.where(spread, var, 1.0))
                change[:, 1 + i, 1 + i] = 1.0 / sd
                change[:, 1 + q + i, 1 + i] = -mean / sd
            back = change.transpose(0, 2, 1)
            beta, _ = _solve(back @ m @ change, (back @ g[..., None])[..., 0], ridge)
            z = np.einsum("np,npk->nk", x, change)
            yield pd.DataFrame({key: pdf[key], "observed_log_or": obs, "predicted_log_or": np.einsum("nk,nk->n", z, beta)})

    kind = df.schema[key].dataType.simpleString()
    out = raw.mapInPandas(fold, f"{key} {kind}, observed_log_or double, predicted_log_or double")
    return out.withColumn("abs_log_error", F.abs(F.col("predicted_log_or") - F.col("observed_log_or")))


def loo_error(predictions: DataFrame, group: list[str] | None = None) -> DataFrame:
    err = F.abs(F.col("predicted_log_or") - F.col("observed_log_or"))
    return predictions.groupBy(*(group or [])).agg(F.avg(err).alias("loo_mae"), F.max(err).alias("loo_max_abs_error"))
