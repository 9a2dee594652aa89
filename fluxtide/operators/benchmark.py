"""Benchmark tables: registry order, evaluation core, discovery pool, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import ranked_first
from .sampling import draw, largest_remainder, split, stratified

# Order of provenance and of confidence.
PROVENANCE = {"LIT_STRONG": 0, "LIT_WEAK": 1, "CATALOG_STRONG": 2, "CATALOG_WEAK": 3, "unknown": 4}
CONFIDENCE = {"gold": 0, "silver": 1, "bronze": 2, "weak": 3, "unknown": 4}
Z_EDGES = (0.1, 0.3, 0.6, 1.0, 2.0)


def with_priority(df: DataFrame) -> DataFrame:
    """Adds the columns by which the best of equal entries is chosen; unknown words last."""
    rank = lambda c, table: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)], F.lit(9))
    return df.withColumn("p_provenance", rank("provenance", PROVENANCE)).withColumn("p_confidence", rank("confidence", CONFIDENCE))


def registry(df: DataFrame) -> DataFrame:
    """One row per canonical id (blank: the position rounded to six places)."""
    at = F.concat(F.lit("COORD_"), F.round("ra", 6).cast("string"), F.lit("_"), F.round("dec", 6).cast("string"))
    keyed = with_priority(df).withColumn("key", F.coalesce(F.nullif(F.trim("canonical_id"), F.lit("")), at))
    return ranked_first(keyed, ["key"], ["p_provenance", "tier", "p_confidence", "source_id"]).drop("p_provenance", "p_confidence")


def z_bin(z):
    """Left-closed strata of redshift, from 0."""
    out = F.lit(0)
    for i, edge in enumerate(Z_EDGES):
        out = F.when(z >= edge, i + 1).otherwise(out)
    return F.when(z.isNotNull(), out)


def class_targets(df: DataFrame, klass: str, total: int) -> DataFrame:
    """Rows per class that keep the classes' ratio."""
    w = df.groupBy(klass).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return largest_remainder(w, klass, "weight", total)


def balanced(df: DataFrame, key: str, klass: str, per_class: int, seed: int = 42) -> DataFrame:
    """Up to ``per_class`` rows of each class in random order."""
    sizes = df.select(klass).distinct().withColumn("allocated", F.lit(per_class))
    return stratified(df, key, klass, sizes, seed)


def eval_core(df: DataFrame, key: str, klass: str, eligible, floor: int, per_class: int, seed: int = 42) -> DataFrame:
    """Eligible rows of the classes that reach the floor, balanced, split 70:15:15."""
    ok = df.filter(eligible)
    large = ok.groupBy(klass).count().filter(F.col("count") >= floor).select(klass)
    return split(balanced(ok.join(large, klass, "left_semi"), key, klass, per_class, seed), key, klass, {"train": 0.7, "dev": 0.15, "test": 0.15}, seed)


def discovery_pool(df: DataFrame, core: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows outside the core, in random order."""
    return df.join(core.select(key), key, "left_anti").orderBy(draw(F.col(key), seed), key).limit(n)


def check(master: DataFrame, parts: dict[str, DataFrame], key: str, klass: str) -> DataFrame:
    """(check, ok): parts are disjoint, together the master, and hold every class."""
    union = None
    for part in parts.values():
        union = part.select(key) if union is None else union.unionAll(part.select(key))
    rows = [("disjoint", union.groupBy(key).count().filter("count > 1").agg((F.count(F.lit(1)) == 0).alias("ok"))), ("complete", master.select(key).exceptAll(union).unionAll(union.exceptAll(master.select(key))).agg((F.count(F.lit(1)) == 0).alias("ok")))]
    n = master.agg(F.count_distinct(klass).alias("all"))
    rows += [(f"classes_{name}", part.agg(F.count_distinct(klass).alias("own")).crossJoin(n).select((F.col("own") == F.col("all")).alias("ok"))) for name, part in sorted(parts.items())]
    out = None
    for name, frame in rows:
        one = frame.select(F.lit(name).alias("check"), "ok")
        out = one if out is None else out.unionAll(one)
    return out
