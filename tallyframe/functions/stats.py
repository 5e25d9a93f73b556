"""Distribution functions and small dense algebra on numpy arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_ln_gamma(p + q) - _ln_gamma(p) - _ln_gamma(q)
                       + p * np.log(z) + q * np.log1p(-z)) / p
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        value = d.copy()
        for k in range(1, 500):
            step = 1.0
            for term in (k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k)),
                         -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1))):
                d = 1 + term * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + term / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = step * d * c
                value = value * d * c
            if np.all(np.abs(step - 1) < 1e-15):
                break
        result = np.where(z <= 0, 0.0, front * value)
    return np.where(swap, 1 - result, result)


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| > |t|) for Student's t."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p > 0.5, by bisection on the tail."""
    target, low, high = 2 * (1 - p), 0.0, 1.0
    while t_two_sided(high, df) > target:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_two_sided(middle, df) > target else (low, middle)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def _t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    out = np.full(len(t), np.nan)
    ok = (t.notna() & df.notna() & (df > 0)).to_numpy()
    if ok.any():
        out[ok] = t_two_sided(t[ok], df[ok])
    return pd.Series(out).where(ok, None)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value as a column; NULL where t or df is NULL or df < 1."""
    return _t_p_value(t.cast("double"), df.cast("double"))


def solve_normal(a: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solve the symmetric system a x = b, leaving out dependent columns.

    Returns (x, inverse, kept): a column whose pivot falls below ``tol`` of its
    diagonal is dropped and has NaN in x and 0 in the inverse.
    """
    size = len(b)
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    unit = a / np.outer(scale, scale)
    work, kept = unit.copy(), np.zeros(size, dtype=bool)
    for j in range(size):
        if a[j, j] > 0 and work[j, j] > tol:
            kept[j] = True
            work -= np.outer(work[:, j], work[j]) / work[j, j]
    inverse = np.zeros_like(unit)
    if kept.any():
        inverse[np.ix_(kept, kept)] = np.linalg.inv(unit[np.ix_(kept, kept)])
    inverse /= np.outer(scale, scale)
    x = np.where(kept, inverse @ b, np.nan)
    return x, inverse, kept
