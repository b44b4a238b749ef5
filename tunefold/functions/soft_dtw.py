"""Soft dynamic time warping between vectors seen as series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def soft_dtw(x, y, gamma: float = 1.0, bandwidth: int = 0) -> float:
    """R[i,j] = D[i,j] + softmin(R[i-1,j-1], R[i-1,j], R[i,j-1]) over squared Euclidean costs, along anti-diagonals.
    ``bandwidth`` > 0 leaves out cells farther than it from the diagonal."""
    import numpy as np

    x, y = (np.asarray(v, "f8") for v in (x, y))
    x, y = (v[:, None] if v.ndim == 1 else v for v in (x, y))
    cost = ((x[:, None, :] - y[None]) ** 2).sum(-1)
    n, m = cost.shape
    r = np.full((n + 1, m + 1), np.inf)
    r[0, 0] = 0.0
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        j = k - i
        if bandwidth > 0:
            near = np.abs(i - j) <= bandwidth
            i, j = i[near], j[near]
            if not len(i):
                continue
        options = -np.stack([r[i - 1, j - 1], r[i - 1, j], r[i, j - 1]]) / gamma
        top = options.max(0)
        with np.errstate(invalid="ignore"):
            soft = -gamma * (top + np.log(np.exp(options - top).sum(0)))
        r[i, j] = cost[i - 1, j - 1] + np.where(np.isinf(top), np.inf, soft)
    return float(r[n, m])


def normalized_soft_dtw(x, y, gamma: float = 1.0, bandwidth: int = 0) -> float:
    """Zero for equal series: xy - (xx + yy) / 2."""
    return soft_dtw(x, y, gamma, bandwidth) - 0.5 * (soft_dtw(x, x, gamma, bandwidth) + soft_dtw(y, y, gamma, bandwidth))


def distance(a: Column, b: Column, gamma: float = 1.0, bandwidth: int = 0, normalize: bool = False) -> Column:
    f = normalized_soft_dtw if normalize else soft_dtw

    def run(xs, ys):
        import pandas as pd

        return pd.Series([None if x is None or y is None else f(x, y, gamma, bandwidth) for x, y in zip(xs, ys)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())(a, b)
