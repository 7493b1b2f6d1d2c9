"""Tail probabilities and quantiles as Arrow-batched column functions over aggregated rows."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT_LIMIT = 50


def chi2_tail(x: float, dof: float) -> float:
    """P(X > x) for integer degrees of freedom, by the recurrence on half-integer shape."""
    if x <= 0:
        return 1.0
    h, dof = x / 2, int(dof)
    shape = 0.5 if dof % 2 else 1.0
    tail = math.erfc(math.sqrt(h)) if dof % 2 else math.exp(-h)
    while shape < dof / 2 - 0.25:
        tail += math.exp(shape * math.log(h) - h - math.lgamma(shape + 1))
        shape += 1
    return min(1.0, tail)


def t_upper_tail(t: float, dof: float) -> float:
    """P(T > t), t >= 0, by Simpson integration of the angle form of the density."""
    top = math.atan(t / math.sqrt(dof))
    grid = np.linspace(0.0, top, 2001)
    y = np.cos(grid) ** (dof - 1)
    weights = np.ones(2001)
    weights[1:-1:2], weights[2:-1:2] = 4, 2
    area = float((weights * y).sum() * (top / 2000) / 3)
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
    return 0.5 - scale * area


def t_quantile_value(p: float, dof: float) -> float:
    if dof < 1:
        return math.nan
    lo, hi = 0.0, 1.0
    while t_upper_tail(hi, dof) > 1 - p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_upper_tail(mid, dof) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def signed_rank_p(w: float, n: float, tie_term: float, approximate: float) -> float:
    """Two-sided p of W = min(W+, W-): exact counts for small n without ties or zeros, else the normal tail."""
    n = int(n)
    if n == 0:
        return 1.0
    if n <= EXACT_LIMIT and not approximate:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for rank in range(1, n + 1):
            ways[rank:] = ways[rank:] + ways[:-rank]
        return float(min(1.0, 2 * ways[: int(round(w)) + 1].sum() / 2.0**n))
    mean = n * (n + 1) / 4
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_term / 2) / 24)
    return math.erfc(abs(w - mean) / sd / math.sqrt(2)) if sd > 0 else 1.0


def _each(fn, *cols: pd.Series) -> pd.Series:
    """One value per row of a batch of already aggregated statistics; NULL in, NULL out."""
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*cols)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _each(chi2_tail, x, dof)


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, dof: pd.Series) -> pd.Series:
    return _each(t_quantile_value, p, dof)


@F.pandas_udf(T.DoubleType())
def wilcoxon_p(w: pd.Series, n: pd.Series, tie_term: pd.Series, approximate: pd.Series) -> pd.Series:
    return _each(signed_rank_p, w, n, tie_term, approximate)
