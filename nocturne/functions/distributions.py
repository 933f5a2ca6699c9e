"""Tail probabilities for rows that are already aggregated."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 10."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(10):
        low = x < 10
        shift = shift - np.where(low, np.log(x), 0.0)
        x = np.where(low, x + 1, x)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated by Lentz."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for 0 <= x <= 1."""
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(
        _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
        + a * np.log(inside) + b * np.log1p(-inside)
    )
    direct = inside < (a + 1) / (a + b + 2)
    aa, bb = np.where(direct, a, b), np.where(direct, b, a)
    xx = np.where(direct, inside, 1 - inside)
    part = front * _beta_fraction(aa, bb, xx) / aa
    result = np.where(direct, part, 1 - part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, result))


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    t, df = t.astype("float64"), df.astype("float64")
    known = (t.notna() & df.notna()).to_numpy()
    p = np.full(len(t), np.nan)
    if known.any():
        p[known] = two_sided_p(t.to_numpy()[known], df.to_numpy()[known])
    return pd.Series(p).where(known, None)


_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(x) / math.sqrt(2)).astype(float)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def t_quantile(p: float, df: float) -> float:
    """Student's t below which a share ``p`` > 0.5 lies; an infinite ``df`` is the normal's."""
    if math.isinf(df):
        return normal_quantile(p)
    low, high = 0.0, 1.0
    tail = lambda t: float(two_sided_p(np.array([t]), np.array([float(df)]))[0]) / 2
    while tail(high) > 1 - p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(middle) > 1 - p else (low, middle)
    return (low + high) / 2


_Z, _Z_WEIGHTS = np.polynomial.legendre.leggauss(160)
_S, _S_WEIGHTS = np.polynomial.legendre.leggauss(80)


def normal_range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= w), by quadrature over the largest of them."""
    z = 8.5 * _Z
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inside = normal_cdf(z)[None, :] - normal_cdf(z[None, :] - np.asarray(w)[:, None])
    return np.clip(k * 8.5 * (np.maximum(inside, 0) ** (k - 1) * density * _Z_WEIGHTS).sum(1), 0, 1)


def studentized_range_tail(q: float, k: int, df: float) -> float:
    """P(Q > q) of the studentized range of ``k`` means with ``df`` degrees of freedom."""
    if math.isinf(df):
        return float(1 - normal_range_cdf(np.array([q]), k)[0])
    low, high = max(0.0, 1 - 9 / math.sqrt(2 * df)), 1 + 12 / math.sqrt(2 * df)
    s = low + (high - low) * (_S + 1) / 2
    log_density = (math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
                   + (df - 1) * np.log(s) - df * s * s / 2)
    weights = np.exp(log_density) * _S_WEIGHTS * (high - low) / 2
    return float(min(1, max(0, 1 - (weights * normal_range_cdf(q * s, k)).sum() / weights.sum())))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    z = z.astype("float64")
    p = pd.Series(2 * normal_cdf(-np.abs(z.fillna(0).to_numpy())))
    return p.where(z.notna().to_numpy(), None)


@F.pandas_udf(T.DoubleType())
def range_tail(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    """Tail of the studentized range for aggregated rows; a null ``df`` is infinite."""
    free = df.astype("float64").fillna(math.inf)
    return pd.Series([
        None if pd.isna(a) or pd.isna(b) or b < 2 else studentized_range_tail(float(a), int(b), float(c))
        for a, b, c in zip(q, k, free)], dtype="object").astype("float64")
