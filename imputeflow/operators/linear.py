"""Linear and Bayesian ridge regression from second moments summed by Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE_MOMENTS = 400
# Hyperpriors, rounds and tolerance of the Bayesian ridge.
RIDGE_PRIOR = 1e-6
RIDGE_ROUNDS = 300
RIDGE_TOL = 1e-3
PINV_CUT = 1e-10


def unpack_symmetric(flat, q: int) -> np.ndarray:
    m = np.zeros((q, q))
    m[np.triu_indices(q)] = flat
    return m + np.triu(m, 1).T


def moments(df: DataFrame, exprs: list[Column], by: list[str] | None = None,
            weight: Column | None = None) -> dict[tuple, np.ndarray]:
    """``sum w [1,x][1,x]'`` over the rows, one matrix per group, in one scan.

    The map side sums; only one small matrix per group and partition is shuffled. Narrow
    tables stay in generated code, wide ones sum Arrow batches with one product each.
    """
    by = by or []
    q = len(exprs) + 1
    # named first, so that each value is worked out once per row and not once per product
    df = df.select(*by, *[e.alias(f"__x{i}") for i, e in enumerate(exprs)],
                   (F.lit(1.0) if weight is None else weight).alias("__wt"))
    vec, w = [F.lit(1.0), *[F.col(f"__x{i}") for i in range(len(exprs))]], F.col("__wt")
    if q * (q + 1) // 2 <= WIDE_MOMENTS:
        sums = [F.sum(w * vec[i] * vec[j]) for i in range(q) for j in range(i, q)]
        rows = df.groupBy(*by).agg(F.array(*sums).alias("m")).collect()
        return {tuple(r[b] for b in by): unpack_symmetric(r.m, q) for r in rows if r.m[0] is not None}

    upper = np.triu_indices(q)

    def partial(batches):
        acc = {}
        for pdf in batches:
            x = np.asarray(pdf["x"].tolist(), dtype=float).reshape(-1, q)
            ws = pdf["w"].to_numpy(float)
            groups = pdf.groupby(by, dropna=False).indices if by else {(): np.arange(len(pdf))}
            for g, at in groups.items():
                g = g if isinstance(g, tuple) else (g,)
                acc[g] = acc.get(g, 0.0) + (x[at] * ws[at, None]).T @ x[at]
        for g, m in acc.items():
            yield pd.DataFrame({**{b: [v] for b, v in zip(by, g)}, "m": [m[upper].tolist()]})

    src = df.select(*by, F.array(*vec).alias("x"), w.alias("w"))
    fields = [f"{b} {src.schema[b].dataType.simpleString()}" for b in by] + ["m array<double>"]
    rows = (src.mapInPandas(partial, ", ".join(fields))
            .select(*by, F.posexplode("m").alias("at", "v"))
            .groupBy(*by, "at").agg(F.sum("v").alias("v")).collect())
    flat: dict[tuple, np.ndarray] = {}
    for r in rows:
        flat.setdefault(tuple(r[b] for b in by), np.zeros(len(upper[0])))[r["at"]] = r["v"]
    return {g: unpack_symmetric(v, q) for g, v in flat.items()}


@dataclass
class LinearFit:
    """``intercept + coef . x``; for the Bayesian ridge also the spread of a prediction."""

    coef: np.ndarray
    intercept: float
    center: np.ndarray | None = None
    cov: np.ndarray | None = None
    noise_var: float | None = None

    def predict(self, xs: list[Column]) -> Column:
        out = F.lit(float(self.intercept))
        for w, x in zip(self.coef, xs):
            out = out + F.lit(float(w)) * x
        return out

    def spread(self, xs: list[Column]) -> Column:
        """Predictive std: noise plus the coefficients' covariance around the train means."""
        if self.cov is None:
            return F.lit(0.0)
        d = [x - F.lit(float(c)) for x, c in zip(xs, self.center)]
        out = F.lit(float(self.noise_var))
        for i in range(len(d)):
            for j in range(len(d)):
                out = out + F.lit(float(self.cov[i, j])) * d[i] * d[j]
        return F.sqrt(F.greatest(out, F.lit(0.0)))


def centered(m: np.ndarray, target: int, preds: list[int]):
    n = m[0, 0]
    mean = m[0] / n
    c = m - n * np.outer(mean, mean)
    return n, mean[preds], mean[target], c[np.ix_(preds, preds)], c[preds, target], max(c[target, target], 0.0)


def fit_lr(m: np.ndarray, target: int, preds: list[int]) -> LinearFit:
    """Least squares; directions without spread get weight zero."""
    n, mx, my, sxx, sxy, _ = centered(m, target, preds)
    d = np.sqrt(np.clip(np.diag(sxx), 0, None))
    d[d <= 1e-9 * np.sqrt(n) * (1 + np.abs(mx))] = np.inf
    scaled = sxx / np.outer(d, d)
    w = np.linalg.pinv(scaled, rcond=PINV_CUT, hermitian=True) @ (sxy / d) / d
    return LinearFit(w, float(my - w @ mx))


def fit_br(m: np.ndarray, target: int, preds: list[int]) -> LinearFit:
    """Bayesian ridge by evidence iteration on the eigenvalues of the centred Gram matrix."""
    n, mx, my, sxx, sxy, syy = centered(m, target, preds)
    eig, vec = np.linalg.eigh((sxx + sxx.T) / 2)
    eig = np.clip(eig, 0.0, None)
    proj = vec.T @ sxy
    alpha, lam = 1.0 / (syy / n + np.finfo(float).eps), 1.0

    def solve():
        w = vec @ (proj / (eig + lam / alpha))
        return w, max(syy - 2 * w @ sxy + w @ sxx @ w, 0.0)

    last = None
    for _ in range(RIDGE_ROUNDS):
        w, sse = solve()
        gamma = np.sum(alpha * eig / (lam + alpha * eig))
        lam = (gamma + 2 * RIDGE_PRIOR) / (w @ w + 2 * RIDGE_PRIOR)
        alpha = (n - gamma + 2 * RIDGE_PRIOR) / (sse + 2 * RIDGE_PRIOR)
        if last is not None and np.abs(last - w).sum() < RIDGE_TOL:
            break
        last = w
    w, _ = solve()
    cov = (vec / (eig + lam / alpha)) @ vec.T / alpha
    return LinearFit(w, float(my - w @ mx), mx, cov, 1.0 / alpha)


LINEAR_FITS = {"LR": fit_lr, "BR": fit_br}
