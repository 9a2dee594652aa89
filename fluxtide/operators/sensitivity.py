"""How much the benchmark's measures depend on each threshold, all settings in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import confusion_columns

# Settings that are swept, one at a time.
SWEEPS = {
    "min_baseline": (5.0, 7.0, 10.0), "epochs_per_season": (2.0, 3.0, 5.0), "min_seasons": (3.0, 4.0, 5.0), "min_delta_mag": (0.2, 0.3, 0.4, 0.5),
    "operating_threshold": (0.3, 0.4, 0.5, 0.6),
}
USUAL = {"min_baseline": 7.0, "epochs_per_season": 3.0, "min_seasons": 4.0, "min_delta_mag": 0.3, "operating_threshold": 0.35}


def settings(spark, sweeps: dict[str, tuple] = SWEEPS, usual: dict[str, float] = USUAL) -> DataFrame:
    """(param, value, one column a parameter): each swept value with the others as usual."""
    rows = [(name, float(v), *[float(v) if n == name else float(usual[n]) for n in usual]) for name, values in sweeps.items() for v in values]
    return spark.createDataFrame(rows, "param string, value double, " + ", ".join(f"{n} double" for n in usual))


def amplitudes(seasons: DataFrame, key: str, variants: DataFrame) -> DataFrame:
    """(param, value, thresholds, key, score, delta_mag): for every setting, the amplitude from
    the last two seasons against the first two of those with enough epochs, and its score; null
    where too few seasons are left or the baseline is short.  ``seasons`` has (key, season,
    n, med, err, baseline); settings are few, so each season row meets them all."""
    names = [c for c in variants.columns if c not in ("param", "value")]
    s = seasons.crossJoin(F.broadcast(variants)).filter(F.col("n") >= F.col("epochs_per_season"))
    by = ["param", "value", key]
    up, down = Window.partitionBy(*by).orderBy("season"), Window.partitionBy(*by).orderBy(F.col("season").desc())
    s = s.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down), "_w": 1.0 / (F.col("err") * F.col("err"))})
    mean = lambda c: F.sum(F.when(F.col(c) <= 2, F.col("_w") * F.col("med"))) / F.sum(F.when(F.col(c) <= 2, F.col("_w")))
    g = s.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_seasons"), F.max("baseline").alias("_baseline"), mean("_u").alias("_early"), mean("_d").alias("_late"))
    ok = (F.col("_seasons") >= F.col("min_seasons")) & (F.col("_baseline") >= F.col("min_baseline")) & (F.col("_early") > 0) & (F.col("_late") > 0)
    ratio = F.when(ok, F.col("_late") / F.col("_early"))
    score = F.least(F.abs(ratio - 1.0) / 2.0, F.lit(1.0))
    return g.select(*by, *names, score.alias("score"), (2.5 * F.log10(ratio)).alias("delta_mag"))


def average_precision(scored: DataFrame, keys: list[str], score: str, truth: str, ranges: int = 1024) -> DataFrame:
    """(keys, auc_pr) for many settings at once: rows are summed by distinct score, cumulated
    within ranges of the score and over the ranges, so that no setting is one task's."""
    by = scored.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.col(truth)).alias("_p"), F.sum(1 - F.col(truth)).alias("_n"))
    by = by.withColumn("_range", F.least(F.floor(F.col("_s") * ranges), F.lit(ranges - 1)))
    over = by.groupBy(*keys, "_range").agg(F.sum("_p").alias("_rp"), F.sum("_n").alias("_rn"))
    down = Window.partitionBy(*keys).orderBy(F.col("_range").desc())
    over = over.withColumns({"_ap": F.sum("_rp").over(down) - F.col("_rp"), "_an": F.sum("_rn").over(down) - F.col("_rn"), "_all": F.sum("_rp").over(Window.partitionBy(*keys))})
    inside = Window.partitionBy(*keys, "_range").orderBy(F.col("_s").desc())
    c = by.join(over.drop("_rp", "_rn"), [*keys, "_range"]).withColumns({"_tp": F.col("_ap") + F.sum("_p").over(inside), "_fp": F.col("_an") + F.sum("_n").over(inside)})
    return c.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_p") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))), F.max("_all")).alias("auc_pr"))


def sweep(seasons: DataFrame, truth: DataFrame, key: str, label: str, variants: DataFrame) -> DataFrame:
    """One row a setting: candidates, confusion and rates at the operating threshold, and the
    average precision; ``auc_range`` is the spread of that over the parameter's values."""
    a = amplitudes(seasons, key, variants)
    j = a.join(truth.select(key, F.col(label).cast("long").alias("_y")), key)
    pred = F.coalesce((F.col("score") >= F.col("operating_threshold")) & (F.abs("delta_mag") >= F.col("min_delta_mag")), F.lit(False))
    n = lambda y, on: F.count_if((F.col("_y") == y) & on)
    four = j.groupBy("param", "value").agg(F.count_if(pred).alias("n_candidates"), n(1, pred).alias("tp"), n(0, pred).alias("fp"), n(1, ~pred).alias("fn"), n(0, ~pred).alias("tn"))
    rates = four.withColumns(confusion_columns(*map(F.col, ("tp", "fp", "fn", "tn"))))
    usable = j.filter(F.col("score").isNotNull())
    out = rates.join(average_precision(usable, ["param", "value"], "score", "_y"), ["param", "value"], "left")
    w = Window.partitionBy("param")
    return out.withColumn("auc_range", F.max("auc_pr").over(w) - F.min("auc_pr").over(w))
