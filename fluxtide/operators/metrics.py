"""Evaluation of rankings and labels.

Curves come from one aggregation by distinct score and cumulative sums over it.  The number
of distinct scores may be large, so cumulative sums run in two levels: within ranges of the
score, and over the ranges."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation, wilson


def confusion_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall, spec = z(tp, tp + fn), z(tn, tn + fp)
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return {"precision": z(tp, tp + fp), "recall": recall, "balanced_accuracy": (recall + spec) / 2.0, "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, root), F.lit(0.0)), "accuracy": z(tp + tn, tp + fp + fn + tn)}


def confusion(df: DataFrame, truth: Column, predicted: Column, keys: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and rates, over all rows or per key."""
    c = lambda a, b, n: F.count_if((truth == a) & (predicted == b)).alias(n)
    g = (df.groupBy(*keys) if keys else df).agg(c(1, 1, "tp"), c(0, 1, "fp"), c(1, 0, "fn"), c(0, 0, "tn"))
    return g.withColumns(confusion_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def threshold_sweep(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Confusion at each threshold (score >= it): each row adds to the thresholds it passes."""
    levels = df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    joined = df.select(score, truth).crossJoin(F.broadcast(levels))
    return confusion(joined.filter(F.col(score).isNotNull()), F.col(truth), (F.col(score) >= F.col("threshold")).cast("int"), ["threshold"])


def cumulative(df: DataFrame, score: str, truth: str, ranges: int = 1024) -> DataFrame:
    """(score, tp, fp, positives, negatives): counts at or above each distinct score."""
    by = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(truth)).alias("p"), F.sum(1 - F.col(truth)).alias("n"))
    span = by.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    by = by.crossJoin(F.broadcast(span)).withColumn("range", F.least(F.floor(F.coalesce(F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * ranges), F.lit(ranges - 1)))
    over = by.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    down = Window.orderBy(F.col("range").desc())
    whole = Window.partitionBy()
    over = over.withColumn("above_p", F.sum("rp").over(down) - F.col("rp")).withColumn("above_n", F.sum("rn").over(down) - F.col("rn")).withColumn("positives", F.sum("rp").over(whole)).withColumn("negatives", F.sum("rn").over(whole))
    inside = Window.partitionBy("range").orderBy(F.col("score").desc())
    out = by.withColumn("cp", F.sum("p").over(inside)).withColumn("cn", F.sum("n").over(inside)).join(over, "range")
    return out.select("score", (F.col("cp") + F.col("above_p")).alias("tp"), (F.col("cn") + F.col("above_n")).alias("fp"), "positives", "negatives", "p", "n")


def pr_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    c = cumulative(df, score, truth)
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.coalesce(F.try_divide(F.col("tp"), F.col("positives")), F.lit(0.0))
    return c.select(F.col("score").alias("threshold"), "tp", "fp", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")), F.lit(0.0)).alias("f1"))


def best_f1(df: DataFrame, score: str, truth: str) -> DataFrame:
    """The threshold with the highest F1; the highest threshold of equals."""
    p = pr_curve(df, score, truth)
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(F.round("f1", 12), "threshold"))
    return p.agg(best.alias("b")).select("b.*")


def roc_auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    c = cumulative(df, score, truth)
    below = F.col("negatives") - F.col("fp")
    return c.agg(F.try_divide(F.sum(F.col("p") * (below + F.col("n") / 2.0)), F.max("positives") * F.max("negatives")).alias("auc"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives"))


def at_k(df: DataFrame, score: str, truth: str, key: str, ks: list[int]) -> DataFrame:
    """Precision (over k, even if there are fewer rows) and recall of the k best."""
    top = df.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc(), key).limit(max(ks)).withColumn("place", F.row_number().over(Window.orderBy(F.col(score).desc(), key)))
    positives = df.filter(F.col(score).isNotNull()).agg(F.sum(truth).alias("positives"))
    levels = df.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    hits = F.broadcast(levels).join(top, F.col("place") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum(truth), F.lit(0)).alias("tp"))
    return hits.crossJoin(positives).select("k", "tp", (F.col("tp") / F.col("k")).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("positives")), F.lit(0.0)).alias("recall"))


def reliability(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """Right-closed bins of equal width, the lowest edge included."""
    b = F.greatest(F.ceil(F.round(F.col(score) * bins, 9)), F.lit(1)).cast("int")
    return df.filter(F.col(score).between(0.0, 1.0)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("positive_rate"))


def brier(df: DataFrame, score: str, truth: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(score) - F.col(truth), 2.0)).alias("brier"))


def rate_by(df: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """Per key: n, k, rate and its Wilson interval."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("k"))
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return g.select(*keys, "n", "k", (F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def class_false_positives(df: DataFrame, klass: str, truth: str, predicted: str) -> DataFrame:
    g = df.groupBy(klass).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == 0).alias("negatives"), F.count_if((F.col(truth) == 0) & (F.col(predicted) == 1)).alias("fp"))
    return g.withColumn("fpr", F.coalesce(F.try_divide(F.col("fp"), F.col("negatives")), F.lit(0.0)))


def quantile_bins(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Adds the quantile bin, right-closed, from 0, in order of the edges."""
    edges = df.agg(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("_edges"))
    inner = F.slice(F.array_distinct("_edges"), 2, bins)
    number = F.size(F.filter(inner, lambda e: F.col(value) > e))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(value).isNotNull(), F.least(number, F.size(inner) - 1))).drop("_edges")


def mid_ranks(counts: DataFrame, group: str, value: str, weight: str, buckets: int = 1024) -> DataFrame:
    """(group, value, rank, total): the mean rank of each distinct value of (group, value, weight)
    rows.  Values are dealt to buckets between approximate quantiles; sizes of lower buckets are
    added to ranks within a bucket, so that no group is sorted in one task."""
    edges = counts.agg(F.percentile_approx(F.col(value).cast("double"), [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    cut = Bucketizer(splits=[-math.inf, *sorted(set(edges or [0.0])), math.inf], inputCol="_v", outputCol="_b")
    each = cut.transform(counts.groupBy(group, value).agg(F.sum(weight).alias("_m")).withColumn("_v", F.col(value).cast("double")))
    sizes = each.groupBy(group, "_b").agg(F.sum("_m").alias("_here"))
    upto, whole = Window.partitionBy(group).orderBy("_b"), Window.partitionBy(group)  # as many rows as buckets
    sizes = sizes.select(group, "_b", (F.sum("_here").over(upto) - F.col("_here")).alias("_before"), F.sum("_here").over(whole).alias("total"))
    inside = F.sum("_m").over(Window.partitionBy(group, "_b").orderBy(value))
    rank = F.col("_before") + inside - F.col("_m") + (F.col("_m") + 1) / 2.0
    return each.join(sizes, [group, "_b"]).select(group, value, rank.alias("rank"), "total")


def spearman(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """Rank correlation, mean ranks for ties, of three rows or more; over all rows or per key.
    Rows are summed by distinct pair first."""
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group.alias("_g"), F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    rx = mid_ranks(pairs, "_g", "_x", "_w").withColumnRenamed("rank", "_rx")
    ry = mid_ranks(pairs, "_g", "_y", "_w").select("_g", "_y", F.col("rank").alias("_ry"))
    j = pairs.join(rx, ["_g", "_x"]).join(ry, ["_g", "_y"])
    a, b = F.col("_rx") - (F.col("total") + 1) / 2.0, F.col("_ry") - (F.col("total") + 1) / 2.0
    g = j.groupBy("_g").agg(F.max("total").alias("n"), F.sum(F.col("_w") * a * b).alias("_ab"), F.sum(F.col("_w") * a * a).alias("_aa"), F.sum(F.col("_w") * b * b).alias("_bb"))
    rho = F.when((F.col("_aa") > 0) & (F.col("_bb") > 0), F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb")))
    return g.filter("n >= 3").select(*[F.col("_g")[k].alias(k) for k in keys], "n", rho.alias("rho"))


def ks_two_sample(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Largest distance of the two groups' distribution functions."""
    c = cumulative(df.withColumn("_g", group.cast("long")), value, "_g")
    return c.agg(F.max(F.abs(F.col("tp") / F.col("positives") - F.col("fp") / F.col("negatives"))).alias("ks"), F.max("positives").alias("n1"), F.max("negatives").alias("n0"))


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    a = roc_auc(df, value, group)
    return a.select((F.col("auc") * F.col("positives") * F.col("negatives")).alias("u"), "auc", F.col("positives").alias("n1"), F.col("negatives").alias("n0"))


def gate_matrix(df: DataFrame, klass: str, gates: list[str]) -> DataFrame:
    """Per class the share that passes each gate."""
    return df.groupBy(klass).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(g).cast("double")).alias(f"pass_{g}") for g in gates])


def feature_quantiles(df: DataFrame, klass: str, features: list[str]) -> DataFrame:
    """(class, feature, n, min, q25, q50, q75, max)."""
    parts = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    long = df.select(klass, F.expr(f"stack({len(features)}, {parts}) AS (feature, value)")).filter("value IS NOT NULL")
    q = lambda p, n: F.percentile("value", F.lit(p)).alias(n)
    return long.groupBy(klass, "feature").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), F.max("value").alias("max"))


def grid_tuning(df: DataFrame, truth: str, grid: DataFrame, predicted: Column, keys: list[str], recall_target: float) -> DataFrame:
    """Confusion at each point of a small parameter grid, the best first: those that reach the
    recall by balanced accuracy, true negatives, precision; then the others."""
    c = confusion(df.crossJoin(F.broadcast(grid)), F.col(truth), predicted, keys)
    order = Window.orderBy(F.col("eligible").desc(), F.round("balanced_accuracy", 9).desc(), F.col("tn").desc(), F.round("precision", 9).desc(), *keys)
    return c.withColumn("eligible", (F.col("recall") >= recall_target).cast("int")).withColumn("place", F.row_number().over(order))


def operating_threshold(df: DataFrame, score: str, truth: str, least_recall: float = 0.8) -> DataFrame:
    """The threshold with the best balanced accuracy among those that reach the recall."""
    c = cumulative(df, score, truth).withColumn("recall", F.try_divide(F.col("tp"), F.col("positives"))).filter(F.col("recall") >= least_recall)
    c = c.withColumn("balanced_accuracy", (F.col("recall") + 1.0 - F.try_divide(F.col("fp"), F.col("negatives"))) / 2.0)
    best = F.max_by(F.struct(F.col("score").alias("threshold"), "recall", "balanced_accuracy"), F.struct(F.round("balanced_accuracy", 12), "score"))
    return c.agg(best.alias("b")).select("b.*")


def prevalence_shift(df: DataFrame, score: str, truth: str, shares: list[float]) -> DataFrame:
    """Brier score and mean score as they would be at other shares of positives: each class
    weighted to its target instead of drawn again."""
    g = df.filter(F.col(score).isNotNull()).agg(*[F.avg(F.when(F.col(truth) == t, e)).alias(f"{n}{t}") for t in (0, 1) for n, e in (("b", F.pow(F.col(score) - F.col(truth), 2.0)), ("s", F.col(score)))])
    levels = df.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return g.crossJoin(levels).select("share", (F.col("share") * F.col("b1") + (1.0 - F.col("share")) * F.col("b0")).alias("brier"), (F.col("share") * F.col("s1") + (1.0 - F.col("share")) * F.col("s0")).alias("mean_score"))
