"""Tails of the t and binomial distributions, vectorised: their incomplete beta has no SQL form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), by Lentz's continued fraction on the side where it converges."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    todo = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if not todo.any():
        return out
    a, b, x = a[todo], b[todo], x[todo]
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(z), 1 / guard(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 2000):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / guard(1 + even * d), guard(1 + even / c)
        h *= d * c
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
        step = d * c
        h *= step
        if np.nanmax(np.abs(step - 1)) < 1e-14:
            break
    out[todo] = np.where(swap, 1 - front * h, front * h)
    return out


def t_two_tailed(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def binomial_log_pmf(k, n, p) -> np.ndarray:
    k, n, p = (np.asarray(v, float) for v in (k, n, p))
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = np.where(k == 0, 0.0, k * np.log(p)) + np.where(n - k == 0, 0.0, (n - k) * np.log1p(-p))
    return _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + hit


def binomial_cdf(k, n, p) -> np.ndarray:
    """P(X <= k)."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, 1 - incomplete_beta(np.maximum(k + 1, 1e-9), np.maximum(n - k, 1e-9), p)))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-tailed; null where t or the degrees of freedom are missing."""
    good = t.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index, dtype=float)
    out[good] = t_two_tailed(t[good], df[good])
    return out.astype(object).where(good, None).astype("Float64")


@F.pandas_udf(T.DoubleType())
def binomial_pmf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(np.exp(binomial_log_pmf(k, n, p)))


@F.pandas_udf(T.DoubleType())
def binomial_ln_pmf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_log_pmf(k, n, p))


@F.pandas_udf(T.DoubleType())
def binomial_two_tailed(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Twice P(X <= k) where that is under a half, else twice what lies above k."""
    low = binomial_cdf(k, n, p)
    return pd.Series(2 * np.minimum(low, 1 - low))


def one_sample_t(n, mean, sd, mu, max_dist=0.01):
    """Two-tailed p: 1 within max_dist of mu, else 0 where sd is 0 or missing."""
    from .scalars import col, t_statistic

    t = t_statistic(n, mean, sd, mu)
    near = F.abs(col(mean) - col(mu)) < max_dist
    return F.when(near, 1.0).when(col(sd).isNull() | (col(sd) == 0), 0.0).otherwise(t_pvalue(t, (col(n) - 1).cast("double")))


def welch_t(n1, m1, s1, n2, m2, s2):
    """Two-tailed p of Welch's test."""
    from .scalars import welch_statistic

    t, df = welch_statistic(n1, m1, s1, n2, m2, s2)
    return t_pvalue(t, df)
