"""p-values Spark has no built-in for, as Arrow UDFs over already aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling series after shifting the argument above 10; relative error below 1e-14."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        small = y < 10
        shift = np.where(small, shift + np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1, y)
    inv = 1 / (y * y)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(z)
    d = 1 / guard(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / guard(1 + num * d)
            c = guard(1 + num / c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(
            p * np.log(z) + q * np.log1p(-z) + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)
        ) / p
    val = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - val, val)


@F.pandas_udf(T.DoubleType())
def _t_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    tv, dv = t.to_numpy(dtype=float), dof.to_numpy(dtype=float)
    ok = np.isfinite(tv) & np.isfinite(dv) & (dv > 0)
    out = np.full(len(tv), np.nan)
    if ok.any():
        # with this many degrees of freedom t is normal to eight digits, log-gamma differences are not
        wide = ok & (dv > 1e7)
        few = ok & ~wide
        d = dv[few]
        out[few] = incomplete_beta(d / 2, np.full(d.shape, 0.5), d / (d + tv[few] ** 2))
        out[wide] = [math.erfc(abs(v) / math.sqrt(2.0)) for v in tv[wide]]
    return pd.Series(out)


def t_two_sided(t: str | Column, dof: str | Column) -> Column:
    """Two-sided p of Student's t; null where t or the degrees of freedom are missing."""
    p = _t_udf(t, dof)
    return F.when(~F.isnan(p), p)


def hypergeom_tail_values(k, M, n, N) -> np.ndarray:
    """P(X >= k) drawing N from M with n marked, by the term ratio from the first term."""
    k, M, n, N = (np.asarray(v, dtype=float) for v in (k, M, n, N))
    hi = np.minimum(n, N)
    lo = np.maximum(0, N + n - M)
    k0 = np.maximum(k, lo)
    lg = lambda a, b: _log_gamma(a + 1) - _log_gamma(b + 1) - _log_gamma(a - b + 1)
    valid = k0 <= hi
    ks = np.where(valid, k0, lo)
    term = np.exp(lg(n, ks) + lg(M - n, N - ks) - lg(M, N))
    total = np.where(valid, term, 0.0)
    i = ks.copy()
    while True:
        more = valid & (i < hi) & (term > total * 1e-17)
        if not more.any():
            break
        ratio = np.where(more, (n - i) * (N - i) / ((i + 1) * (M - n - N + i + 1)), 0.0)
        term = np.where(more, term * ratio, term)
        total = np.where(more, total + term, total)
        i = np.where(more, i + 1, i)
    return np.minimum(total, 1.0)


@F.pandas_udf(T.DoubleType())
def hypergeom_tail(k: pd.Series, M: pd.Series, n: pd.Series, N: pd.Series) -> pd.Series:
    """One-sided (greater) Fisher p for k marked among N drawn from M with n marked."""
    return pd.Series(hypergeom_tail_values(k, M, n, N))
