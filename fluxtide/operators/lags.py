"""Lag of colour behind flux, one source per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .stochastic import spread


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, value = 1.0, 0.0, 1.0
    for k in range(500):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + term * d or 1e-300)
        c = 1.0 + term / c or 1e-300
        value *= c * d
        if k and abs(c * d - 1.0) < 1e-15:
            break
    return front * (value - 1.0)


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs."""
    if n < 3:
        return 1.0
    return beta_share(n / 2.0 - 1.0, 0.5, max(0.0, 1.0 - r * r))


def peak_lag(t: np.ndarray, x: np.ndarray, y: np.ndarray, grid: int = 200) -> tuple[float, float]:
    """(lag, height) of the highest cross-correlation of y behind x over all lags, both
    interpolated to an even grid and standardised; the first of equal peaks."""
    even = np.linspace(t[0], t[-1], grid)
    a, b = np.interp(even, t, x), np.interp(even, t, y)
    a, b = (a - a.mean()) / (a.std() + 1e-8), (b - b.mean()) / (b.std() + 1e-8)
    c = np.correlate(b, a, "full")
    k = int(np.argmax(c))
    return (k - (grid - 1)) * (t[-1] - t[0]) / grid, float(c[k] / grid)


def colour_lag(df: DataFrame, key: str, flux: str, colour: str, time: str = "mjd", least: int = 20, grid: int = 200) -> DataFrame:
    """(key, n, range, r, p, lag, peak): range of the colour, its correlation with the flux and
    that one's p-value, lag of the colour in the unit of time (positive: behind the flux) and
    height of the peak.  Equal times count once, by their mean."""
    names = [key, "n", "range", "r", "p", "lag", "peak"]
    kind = df.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[[time, flux, colour]].dropna().groupby(time, as_index=False).mean().sort_values(time)
        n = len(p)
        if n < least:
            return pd.DataFrame([], columns=names)
        t, x, y = (p[c].to_numpy(float) for c in (time, flux, colour))
        varies = x.std() > 0 and y.std() > 0
        r = float(np.clip(np.corrcoef(x, y)[0, 1], -1.0, 1.0)) if varies else None
        lag, peak = peak_lag(t, x, y, grid) if varies else (None, None)
        return pd.DataFrame([(pdf[key].iloc[0], n, float(y.max() - y.min()), r, correlation_p(r, n) if varies else None, lag, peak)], columns=names)

    return spread(df.select(key, time, flux, colour), key).groupBy(key).applyInPandas(one, f"`{key}` {kind}, n long, range double, r double, p double, lag double, peak double")
