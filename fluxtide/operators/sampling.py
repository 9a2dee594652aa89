"""Apportionment, seeded samples and splits.

Random order is md5 of (seed, id): the same on any cluster and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """A hexadecimal string by which rows are in random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, allocated): whole parts, then one more by descending remainder, earlier keys
    first; zero weights share evenly.  One row per class, so the window is small."""
    whole = Window.partitionBy()
    w = weights.withColumn("_sum", F.sum(weight).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    exact = F.when(F.col("_sum") > 0, total * F.col(weight) / F.col("_sum")).otherwise(total / F.col("_n"))
    w = w.withColumn("_exact", exact).withColumn("_floor", F.floor(F.col("_exact") + 1e-9)).withColumn("_left", total - F.sum("_floor").over(whole))
    place = F.row_number().over(Window.orderBy(F.round(F.col("_exact") - F.col("_floor"), 9).desc(), key))
    return w.withColumn("allocated", (F.col("_floor") + (place <= F.col("_left")).cast("int")).cast("long")).select(key, weight, "allocated")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def placed(df: DataFrame, key: str, stratum: str, seed: int = 42) -> DataFrame:
    """Adds ``_place`` (from 1, in random order) and ``_n`` within the stratum.  The order is that
    of hexadecimal draws, so rows are numbered within (stratum, first three digits) and the
    sizes of earlier digits are added: no stratum is sorted in one task."""
    d = df.withColumn("_draw", draw(F.col(key), seed)).withColumn("_head", F.substring("_draw", 1, 3))
    sizes = d.groupBy(F.col(stratum).alias("_s"), F.col("_head").alias("_h")).agg(F.count(F.lit(1)).alias("_here"))
    upto, whole = Window.partitionBy("_s").orderBy("_h"), Window.partitionBy("_s")  # 4096 rows a stratum at most
    sizes = sizes.select("_s", "_h", (F.sum("_here").over(upto) - F.col("_here")).alias("_before"), F.sum("_here").over(whole).alias("_n"))
    met = d.join(sizes, d[stratum].eqNullSafe(sizes["_s"]) & (d["_head"] == sizes["_h"]))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_s", "_h").orderBy("_draw", key))
    return met.withColumn("_place", place).select(*df.columns, "_place", "_n")


def stratified(df: DataFrame, key: str, stratum: str, allocation: DataFrame, seed: int = 42) -> DataFrame:
    """The allocated number of rows of each stratum, in random order."""
    return placed(df, key, stratum, seed).join(allocation.select(stratum, "allocated"), stratum).filter("_place <= allocated").drop("_place", "_n", "allocated")


def split(df: DataFrame, key: str, stratum: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Adds ``split``: within each stratum, random order cut at the rounded-up shares."""
    marked, bound, out = placed(df, key, stratum, seed).withColumn("_p", (F.col("_place") - 1) / F.col("_n")), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        bound += shares[name]
        cond = F.col("_p") < round(bound, 9)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return marked.withColumn("split", F.lit(names[-1]) if out is None else out.otherwise(names[-1])).drop("_p", "_place", "_n")


def top_n(df: DataFrame, score: str, key: list[str], n: int) -> DataFrame:
    """The n best with rank from 1; ties by the keys."""
    best = df.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc(), *key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), *key)))


def per_group_top_n(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def thin(df: DataFrame, keys: list[str], most: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``most`` rows per key: half evenly spaced in time, half in random order."""
    w = Window.partitionBy(*keys)
    half = most // 2
    s = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy("mjd", key)) - 1)
    even = F.floor(F.col("_i") * half / F.col("_n")) != F.floor((F.col("_i") - 1) * half / F.col("_n"))
    s = s.withColumn("_even", (F.col("_i") == 0) | even).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_even").orderBy(draw(F.col(key), seed), key)))
    return s.filter((F.col("_n") <= most) | F.col("_even") | (F.col("_r") <= most - half)).drop("_n", "_i", "_even", "_r")


def bootstrap_weights(df: DataFrame, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """(row, replicate, weight): Poisson(1) weights from md5, which stand for resampling."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    out, bound, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        bound += term
        out = out + (F.col("_u") > bound).cast("int")
        term /= k + 1
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_u", u).withColumn("weight", out).drop("_u")
