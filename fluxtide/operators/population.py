"""Candidates against the population they come from."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import cumulative
from .resampling import drawn_medians

# Edges of the redshift bins.
Z_EDGES = (0.0, 0.1, 0.3, 0.5, 1.0, 2.0, 5.0)


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
    if x <= 0.0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return total * front
    b, c = x + 1.0 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return 1.0 - front * h


def gamma_quantile(a: float, p: float) -> float:
    """x with ``gamma_share(a, x) = p``, by bisection."""
    low, high = 0.0, max(1.0, 2.0 * a)
    while gamma_share(a, high) < p:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if gamma_share(a, mid) < p else (low, mid)
    return 0.5 * (low + high)


def poisson_interval(k: int, alpha: float = 0.32) -> tuple[float, float]:
    """Exact interval of a Poisson mean from a count of k."""
    return (gamma_quantile(k, alpha / 2.0) if k else 0.0), gamma_quantile(k + 1, 1.0 - alpha / 2.0)


def occurrence(candidates: int, total: int) -> dict[str, float | None]:
    """Rate of candidates with the exact interval on their number; null rates where there is
    no population."""
    if not total:
        return {"rate": None, "rate_lo": None, "rate_hi": None}
    low, high = poisson_interval(candidates)
    return {"rate": candidates / total, "rate_lo": low / total, "rate_hi": high / total}


def ks_p(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    lam = F.sqrt(n1 * n2 / (n1 + n2)) * d
    # A loop over the terms, so that the expression stays small.
    term = lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), term)
    return F.when(lam < 0.04, 1.0).otherwise(F.least(F.greatest(2.0 * total, F.lit(0.0)), F.lit(1.0)))


def ks_against(df: DataFrame, value: str, chosen: str) -> DataFrame:
    """(ks, n_all, n_chosen, p): the chosen rows against all rows (themselves included, as
    a parent sample has its members), by cumulative counts over distinct values."""
    c = cumulative(df.select(F.col(value).cast("double").alias("_v"), F.col(chosen).cast("int").alias("_c")), "_v", "_c")
    share_all = (F.col("tp") + F.col("fp")) / (F.col("positives") + F.col("negatives"))
    g = c.agg(F.max(F.abs(F.col("tp") / F.col("positives") - share_all)).alias("ks"), (F.max("positives") + F.max("negatives")).alias("n_all"), F.max("positives").alias("n_chosen"))
    return g.withColumn("p", ks_p(F.col("ks"), F.col("n_all"), F.col("n_chosen")))


def fraction_by(df: DataFrame, value: str, chosen: str, edges: tuple = Z_EDGES) -> DataFrame:
    """(low, high, n_all, n_chosen, fraction) of each bin, empty ones included."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    v = F.col(value)
    at = sum((F.when(v >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0))
    g = df.filter((v >= edges[0]) & (v < edges[-1])).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col(chosen)).alias("n_chosen"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return bins.join(F.broadcast(g), "bin", "left").select("low", "high", zero("n_all"), zero("n_chosen")).withColumn("fraction", F.col("n_chosen") / F.greatest("n_all", F.lit(1)))


def bootstrap_median(df: DataFrame, value: str, keys: list[str], row_key: str, replicates: int = 1000, inside: float = 0.68, seed: int = 42) -> DataFrame:
    """(keys, n, median, lo, hi) of the value's median: rows are drawn with replacement n times a
    replicate.  Draw k of replicate r takes the row whose place, in the order of the row key, is
    floor(u n).  Draws are never rows: a task has a group's values as one array and draws twenty
    replicates.  A group has a thousand times as many draws as values, so its draws outgrow the
    time of any run long before its values outgrow a task."""
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), row_key).dropna(subset=keys)
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    g = d.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(row_key, "_v"))), lambda x: x["_v"]).alias("_values"), F.count(F.lit(1)).alias("n"), F.median("_v").alias("median"))
    blocks = g.select(*keys, name.alias("_name"), "_values", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(20))).alias("_low"))
    blocks = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                low = b.column("_low")[i].as_py()
                found = drawn_medians(b.column("_values")[i].values.to_numpy(zero_copy_only=False), b.column("_name")[i].as_py(), low, min(low + 20, replicates), seed)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array([i] * len(found))) for k in keys], pa.array(found)], names=[*keys, "_b"])

    m = blocks.mapInArrow(run, blocks.select(*keys).schema.add("_b", "double"))
    tail = (1.0 - inside) / 2.0
    spread = m.groupBy(*keys).agg(F.percentile("_b", F.lit(tail)).alias("lo"), F.percentile("_b", F.lit(1.0 - tail)).alias("hi"))
    return g.select(*keys, "n", "median").join(spread, keys)


def summary(df: DataFrame, value: str, chosen: str) -> DataFrame:
    """One row: sizes, occurrence rate with its interval, medians, and the test of the value's
    distribution."""
    a = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col(chosen)).alias("n_candidates"), F.median(F.col(value)).alias("median_all"), F.median(F.when(F.col(chosen), F.col(value))).alias("median_candidates"))
    row = a.first()
    rate = occurrence(row["n_candidates"], row["n_total"])
    out = a.sparkSession.createDataFrame([(row["n_total"], row["n_candidates"], row["median_all"], row["median_candidates"], *rate.values())], "n_total long, n_candidates long, median_all double, median_candidates double, rate double, rate_lo double, rate_hi double")
    return out.crossJoin(F.broadcast(ks_against(df.filter(F.col(value).isNotNull()), value, chosen).select("ks", F.col("p").alias("ks_p"))))
