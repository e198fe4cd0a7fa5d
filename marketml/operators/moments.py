"""Linear models from mergeable moments.

A linear fit and its squared error need only the number of rows, the means and the covariances of the
features and the label.  ``moments`` takes them for every value of a group column, such as a fold, in one
aggregation.  Moments of disjoint rows merge exactly like the aggregation's own partial results, so
the rows outside a fold are the merger of the other folds, and any number of folds, penalties and
feature sets is fitted and scored from one scan.

Scale: (k + 1)(k + 2) / 2 covariances a group are combined map-side in the JVM (``covar_pop``
keeps centred sums, so large means lose no digits); the driver gets them and nothing else.  The solvers
work on k x k matrices.

The objective is MLlib's: squared error over two, features and label scaled to unit variance, penalty
``regParam`` with its ``elasticNetParam`` share of L1.  A feature without variance gets coefficient 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Rows, means and population covariances of columns, the label last."""

    n: int
    mean: np.ndarray
    cov: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        far = other.mean - self.mean
        cov = (self.n * self.cov + other.n * other.cov) / n + np.outer(far, far) * (self.n / n) * (other.n / n)
        return Moments(n, self.mean + far * (other.n / n), cov)

    def of(self, places: Sequence[int]) -> Moments:
        """Of some columns."""
        places = list(places)
        return Moments(self.n, self.mean[places], self.cov[np.ix_(places, places)])


def merged(parts: Sequence[Moments]) -> Moments:
    return reduce(lambda a, b: a + b, parts)


def moments(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict:
    """{value of ``by``: moments}, or {None: moments}, from one aggregation.  No column may hold NULLs."""
    number = [F.col(f"`{c}`").cast("double") for c in columns]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    rows = df.groupBy(*([F.col(by).alias("by")] if by else [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.count(c) for c in number]).alias("counts"),
        F.array(*[F.avg(c) for c in number]).alias("mean"),
        F.array(*[F.covar_pop(number[i], number[j]) for i, j in pairs]).alias("cov")).collect()
    out = {}
    for r in rows:
        if r.n and any(c != r.n for c in r["counts"]):
            raise ValueError(f"NULLs in {[c for c, k in zip(columns, r['counts'], strict=True) if k != r.n]}")
        cov = np.zeros((len(columns), len(columns)))
        for (i, j), v in zip(pairs, r["cov"], strict=True):
            cov[i, j] = cov[j, i] = v or 0.0
        out[r["by"] if by else None] = Moments(r.n, np.array([m or 0.0 for m in r["mean"]]), cov)
    return out


def solve(m: Moments, reg: float = 0.0, alpha: float = 0.0, tol: float = 1e-14, sweeps: int = 100_000) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the elastic net over ``m``."""
    sd = np.sqrt(np.maximum(np.diag(m.cov), 0))
    sx, sy = sd[:-1], sd[-1]
    if not sy:  # a constant label
        return np.zeros(len(sx)), float(m.mean[-1])
    live = np.flatnonzero(sx > 0)
    corr = m.cov[np.ix_(live, live)] / np.outer(sx[live], sx[live])
    with_y = m.cov[live, -1] / (sx[live] * sy)
    l1, l2 = reg / sy * alpha, reg / sy * (1 - alpha)
    if not l1:
        b = np.linalg.lstsq(corr + l2 * np.eye(len(live)), with_y, rcond=None)[0]
    else:
        b = np.zeros(len(live))
        for _ in range(sweeps):
            before = b.copy()
            for j in range(len(b)):
                z = with_y[j] - corr[j] @ b + b[j]
                b[j] = np.sign(z) * max(abs(z) - l1, 0) / (1 + l2)
            if np.abs(b - before).max(initial=0) <= tol:
                break
    out = np.zeros(len(sx))
    out[live] = b * sy / sx[live]
    return out, float(m.mean[-1] - out @ m.mean[:-1])


def optimality_gap(m: Moments, coef: np.ndarray, reg: float, alpha: float) -> float:
    """How far coefficients are from the elastic net's optimum: the largest distance, over the features, of the
    residual's correlation from the penalty's subgradient (0 at the optimum)."""
    sd = np.sqrt(np.diag(m.cov))
    b = coef * sd[:-1] / sd[-1]
    rest = (m.cov[:-1, -1] - m.cov[:-1, :-1] @ coef) / np.where(sd[:-1] > 0, sd[:-1] * sd[-1], 1) - reg / sd[-1] * (1 - alpha) * b
    l1 = reg / sd[-1] * alpha
    return float(np.where(b != 0, np.abs(rest - l1 * np.sign(b)), np.maximum(np.abs(rest) - l1, 0)).max(initial=0))


def score(m: Moments, coef: np.ndarray, intercept: float) -> dict:
    """n, rmse and r2 of a linear model on the rows of ``m``."""
    off = m.mean[-1] - intercept - coef @ m.mean[:-1]
    mse = max(m.cov[-1, -1] - 2 * coef @ m.cov[:-1, -1] + coef @ m.cov[:-1, :-1] @ coef, 0.0) + off**2
    return {"n": m.n, "rmse": float(np.sqrt(mse)), "r2": float(1 - mse / m.cov[-1, -1]) if m.cov[-1, -1] else float("nan")}
