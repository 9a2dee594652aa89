"""Structure functions: squared differences of pairs by lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stochastic import spread


def structure_function(df: DataFrame, keys: list[str], value: str = "mag", err: str = "err", time: str = "mjd", tie: str = "event_id", bins: int = 20, least_pairs: int = 5, least_rows: int = 10, shortest: float = 1.0) -> DataFrame:
    """Per key and log-spaced lag bin [lo, hi): mean squared difference less the noise,
    centre and number of pairs.  Bins run from the 5th percentile of positive lags (or
    ``shortest``) to the longest lag.  A key's rows are one array and its pairs arrays of one
    task, never rows."""
    number = F.transform(F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(tie).alias("k"), F.col(value).cast("double").alias("v"), F.col(err).cast("double").alias("e")))), lambda x: F.struct(*[F.coalesce(x[n], F.lit(float("nan"))).alias(n) for n in "tve"]))
    g = spread(df.select(*keys, *dict.fromkeys((time, value, err, tie))).dropna(subset=keys), *keys).groupBy(*keys).agg(number.alias("_x")).filter(F.size("_x") >= least_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("_x")
            ends = lists.offsets.to_numpy()
            t, v, e = (lists.values.field(n).to_numpy(zero_copy_only=False) for n in "tve")
            found = [binned_pairs(t[i:j], v[i:j], e[i:j], bins, least_pairs, shortest) for i, j in zip(ends, ends[1:])]
            at = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * 4
            kinds = pa.int32(), pa.float64(), pa.int64(), pa.float64()
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at)) for k in keys], *[pa.array(c).cast(x) for c, x in zip(columns, kinds)]], names=[*keys, "bin", "lag", "pairs", "sf"])

    schema = g.select(*keys).schema.add("bin", "integer").add("lag", "double").add("pairs", "long").add("sf", "double")
    return g.mapInArrow(run, schema)


def binned_pairs(t: np.ndarray, v: np.ndarray, e: np.ndarray, bins: int, least: int, shortest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, lag, pairs, sf) of one curve in order of time; a NaN in ``e`` is a missing error, in
    ``t`` or ``v`` a row without pairs."""
    ok = np.isfinite(t) & ~np.isnan(v)
    t, v, e = t[ok], v[ok], e[ok]
    i, j = np.triu_indices(len(t), 1)
    lag = t[j] - t[i]
    i, j, lag = i[lag > 0], j[lag > 0], lag[lag > 0]
    none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
    if not len(lag):
        return none
    at = 0.05 * (len(lag) - 1)
    k = int(at)
    near = np.partition(lag, sorted({k, min(k + 1, len(lag) - 1)}))
    low = max((k + 1 - at) * near[k] + (at - k) * near[min(k + 1, len(lag) - 1)] if at > k else near[k], shortest)
    high = float(lag.max())
    if not high > low:
        return none
    inside = (lag >= low) & (lag < high)
    i, j, lag = i[inside], j[inside], lag[inside]
    step = np.log(high / low) / bins
    place = np.minimum(np.floor(np.round(np.log(lag / low) / step, 9)), bins - 1).astype(np.int64)
    noise = e[i] * e[i] + e[j] * e[j]
    known = ~np.isnan(noise)
    pairs, errors = np.bincount(place, minlength=bins), np.bincount(place[known], minlength=bins)
    square = np.bincount(place, (v[i] - v[j]) ** 2, bins) / np.maximum(pairs, 1)
    noise = np.bincount(place[known], noise[known], bins) / np.maximum(errors, 1)
    sf = np.where(errors > 0, np.maximum(square - noise, 0.0), 0.0)
    full = np.flatnonzero(pairs >= least)
    return full, low * np.exp((full + 0.5) * step), pairs[full], sf[full]


def slope_and_plateau(sf: DataFrame, keys: list[str]) -> DataFrame:
    """Log-log slope over the lower half of the valid bins, plateau (median of the last 30
    percent) and excess (last bin over the first third's median)."""
    w = Window.partitionBy(*keys)
    v = sf.filter("sf > 0").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("bin")))
    lower = F.col("i") <= F.greatest(F.lit(2), F.floor(F.col("n") / 2))
    tail = F.col("i") > F.col("n") - F.greatest(F.lit(1), F.floor(0.3 * F.col("n")))
    head = F.col("i") <= F.greatest(F.lit(2), F.floor(F.col("n") / 3))
    y, x = F.when(lower, F.log(F.col("sf"))), F.when(lower, F.log(F.col("lag")))
    return v.groupBy(*keys).agg(F.max("n").alias("n_bins"), F.regr_slope(y, x).alias("slope"), F.median(F.when(tail, F.col("sf"))).alias("plateau"), F.try_divide(F.max_by("sf", "bin"), F.median(F.when(head, F.col("sf")))).alias("excess")).filter("n_bins >= 3")


__all__ = ["slope_and_plateau", "structure_function"]


def root_structure(sf: DataFrame, keys: list[str], lag: float) -> DataFrame:
    """Amplitude form: log-log slope of sqrt(sf), and its fitted value at one lag."""
    v = sf.filter("sf > 0").withColumn("y", F.log(F.sqrt("sf"))).withColumn("x", F.log("lag"))
    g = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bins"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("level")).filter("n_bins >= 3")
    return g.select(*keys, "n_bins", "slope", F.exp(F.col("level") + F.col("slope") * F.log(F.lit(lag))).alias("amplitude"))


def power_law_break(sf: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """One log-log line against two that part at a bin: the best break by BIC, from the sums
    of each side.  A key has as many rows as bins."""
    v = sf.filter("sf > 0").withColumn("y", F.log("sf")).withColumn("x", F.log("lag"))
    whole, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin")
    v = v.withColumn("n", F.count(F.lit(1)).over(whole)).filter(F.col("n") >= least).withColumn("i", F.row_number().over(up))

    def misfit(w):
        xx, yy, xy = F.regr_sxx("y", "x").over(w), F.regr_syy("y", "x").over(w), F.regr_sxy("y", "x").over(w)
        return F.greatest(yy - F.coalesce(F.try_divide(xy * xy, xx), F.lit(0.0)), F.lit(0.0))

    v = v.withColumn("one", misfit(whole)).withColumn("left", misfit(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("right", misfit(up.rowsBetween(1, Window.unboundedFollowing)))
    n = F.col("n")
    gain = n * F.log((F.col("one") + 1e-9) / (F.col("left") + F.col("right") + 1e-9)) - 3.0 * F.log(n.cast("double"))
    v = v.withColumn("gain", F.when((F.col("i") >= 2) & (F.col("i") <= n - 2), gain))
    best = F.max_by(F.struct(F.col("lag"), F.col("gain")), F.struct(F.round("gain", 9), -F.col("i")))
    return v.filter("gain IS NOT NULL").groupBy(*keys).agg(F.max("n").alias("n_bins"), best.alias("b")).select(*keys, "n_bins", F.col("b.lag").alias("break_lag"), F.col("b.gain").alias("delta_bic"))
