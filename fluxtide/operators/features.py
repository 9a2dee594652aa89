"""Features of light curves for the classifiers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stochastic import spread

from .seasons import sessionize

# The eight low-pass coefficients of the db4 wavelet.
DB4 = np.array([0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278])


def flux_ratio_stats(df: DataFrame, keys: list[str], a: str, b: str, time: str = "mjd", least: int = 10) -> DataFrame:
    """Of a / b per key: mean, population spread, trend per day, skewness, range, p90 - p10,
    and the means of the halves by row."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("r", F.col(a) / (F.col(b) + 1e-12)).filter("r IS NOT NULL")
    r = r.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy(time))).filter(F.col("n") >= least)
    early = F.col("i") <= F.floor(F.col("n") / 2)
    return r.groupBy(*keys).agg(F.max("n").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.regr_slope("r", time).alias("trend"), F.skewness("r").alias("skew"), (F.max("r") - F.min("r")).alias("range"), (F.percentile("r", F.lit(0.9)) - F.percentile("r", F.lit(0.1))).alias("p90_p10"), F.avg(F.when(early, F.col("r"))).alias("first_half"), F.avg(F.when(~early, F.col("r"))).alias("second_half"))


def colour_slopes(df: DataFrame, keys: list[str], colour: str, gap: float, time: str = "mjd", least: int = 4) -> DataFrame:
    """Slopes per year of the colour over the first and last seasons (three, or half of them)
    and their ratio within -10..10."""
    s = sessionize(df, keys, gap, time)
    k = s.withColumn("last", F.max("season").over(Window.partitionBy(*keys)))
    n = F.least(F.lit(3), F.floor((F.col("last") + 1) / 2))
    early, late = F.col("season") < n, F.col("season") > F.col("last") - n
    slope = lambda on: F.regr_slope(F.when(on, F.col(colour)), F.when(on, F.col(time))) * 365.25
    g = k.groupBy(*keys).agg(F.count_if(early).alias("n_early"), F.count_if(late).alias("n_late"), slope(early).alias("slope_early"), slope(late).alias("slope_late"), (F.max(colour) - F.min(colour)).alias("range"))
    ratio = F.when(F.abs("slope_late") < 1e-6, 10.0 * F.signum("slope_early")).otherwise(F.least(F.greatest(F.col("slope_early") / F.col("slope_late"), F.lit(-10.0)), F.lit(10.0)))
    return g.filter((F.col("n_early") >= least) & (F.col("n_late") >= least)).withColumn("slope_ratio", ratio)


def redshift_scalings(z: Column, size: Column, slope: Column, trend: Column, sigma: Column) -> dict[str, Column]:
    """Rest-frame forms of time-dependent features, for 0 < z <= 5."""
    ok = (z > 0) & (z <= 5)
    one = lambda c: F.when(ok, c)
    return {"log1z": one(F.log1p(z)), "size_rest": one(size / (1.0 + z)), "slope_rest": one(slope * (1.0 + z)), "trend_rest": one(trend * (1.0 + z)), "sigma_rest": one(sigma / F.sqrt(1.0 + z))}


def _resampled(t: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    n = 1 << max(4, min(int(math.log2(most)), int(math.ceil(math.log2(max(len(t), 2))))))
    x = np.interp(np.linspace(t[0], t[-1], n), t, y)
    i = np.arange(n)
    return x - np.polyval(np.polyfit(i, x, 1), i)


def wavelet_bands(df: DataFrame, key: str, value: str = "flux", time: str = "mjd", levels: int = 3, least: int = 20, most: int = 512) -> DataFrame:
    """Variances of three detail bands and the rest of a periodic db4 transform of the
    evenly resampled, detrended curve; their entropy."""
    high = DB4[::-1] * np.array([1, -1] * 4)

    def step(x: np.ndarray, f: np.ndarray) -> np.ndarray:
        n = len(x)
        return np.array([x[(2 * i + np.arange(8)) % n] @ f for i in range(n // 2)])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna().sort_values(time, kind="stable").drop_duplicates(time)
        names = [key, "n", "d1", "d2", "d3", "rest", "entropy"]
        if len(p) < least:
            return pd.DataFrame([], columns=names)
        x, bands = _resampled(p[time].to_numpy(float), p[value].to_numpy(float), most), []
        for _ in range(levels):
            bands.append(step(x, high))
            x = step(x, DB4)
        power = np.array([b.var() for b in [*bands, x]])
        share = power / max(power.sum(), 1e-300)
        return pd.DataFrame([(pdf[key].iloc[0], len(p), *power, float(-(share * np.log(share + 1e-12)).sum()))], columns=names)

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, time, value), key).groupBy(key).applyInPandas(one, f"`{key}` {kind}, n long, d1 double, d2 double, d3 double, rest double, entropy double")


def pelt(y: np.ndarray, penalty: float, least: int = 3) -> list[int]:
    """Exact change points of the mean under a quadratic cost, by pruned dynamic programming."""
    n = len(y)
    s, q = np.concatenate(([0.0], np.cumsum(y))), np.concatenate(([0.0], np.cumsum(y * y)))
    best, last, open_ = np.full(n + 1, math.inf), np.zeros(n + 1, int), np.array([0])
    best[0], until = -penalty, np.full(n + 1, n + 1)
    for end in range(least, n + 1):
        ok = open_[end - open_ >= least]
        cost = best[ok] + (q[end] - q[ok]) - (s[end] - s[ok]) ** 2 / (end - ok) + penalty
        i = int(np.argmin(cost))
        best[end], last[end] = cost[i], ok[i]
        # A beaten start goes once segments from this end are long enough.
        beaten = ok[cost - penalty > best[end]]
        until[beaten] = np.minimum(until[beaten], end + least)
        open_ = np.append(open_[until[open_] > end + 1], end)
    cuts, at = [], n
    while last[at] > 0:
        at = last[at]
        cuts.append(int(at))
    return cuts[::-1]


def structural_breaks(df: DataFrame, key: str, value: str = "flux", time: str = "mjd", least: int = 15, scale: float = 3.0) -> DataFrame:
    """Number of breaks, and time, size and F statistic of the first."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna().sort_values(time, kind="stable")
        names = [key, "n", "n_breaks", "first_mjd", "size", "f"]
        if len(p) < least:
            return pd.DataFrame([], columns=names)
        t, y = p[time].to_numpy(float), p[value].to_numpy(float)
        sd = y.std() or 1.0
        cuts = pelt((y - y.mean()) / sd, scale * math.log(len(y)))
        if not cuts:
            return pd.DataFrame([(pdf[key].iloc[0], len(y), 0, None, 0.0, 0.0)], columns=names)
        a, b = y[: cuts[0]], y[cuts[0] :]
        inner = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
        f = (((y - y.mean()) ** 2).sum() - inner) / max(inner / (len(y) - 2), 1e-300)
        return pd.DataFrame([(pdf[key].iloc[0], len(y), len(cuts), float(t[cuts[0]]), float(b.mean() - a.mean()), float(f))], columns=names)

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, time, value), key).groupBy(key).applyInPandas(one, f"`{key}` {kind}, n long, n_breaks int, first_mjd double, size double, f double")


def season_coherence(df: DataFrame, key: str, gap: float, value: str = "flux", time: str = "mjd", least: int = 3, points: int = 20) -> DataFrame:
    """Correlation of consecutive seasons resampled to equal length: mean, least, greatest."""
    s = sessionize(df, [key], gap, time)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        curves = []
        for _, g in pdf.dropna().groupby("season"):
            g = g.sort_values(time, kind="stable")
            if len(g) >= least:
                n = min(points, len(g))
                curves.append(np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(g)), g[value].to_numpy(float)))
        rs = []
        for a, b in zip(curves, curves[1:]):
            n = min(len(a), len(b))
            a, b = np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(a)), a), np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(b)), b)
            if a.std() > 0 and b.std() > 0:
                rs.append(float(np.corrcoef(a, b)[0, 1]))
        names = [key, "n", "mean", "low", "high"]
        return pd.DataFrame([(pdf[key].iloc[0], len(rs), np.mean(rs), min(rs), max(rs))] if rs else [], columns=names)

    kind = df.schema[key].dataType.simpleString()
    return spread(s.select(key, "season", time, value), key).groupBy(key).applyInPandas(one, f"`{key}` {kind}, n long, mean double, low double, high double")
