"""Queries that evaluate scores against labels: quality is the truth, n_chars the score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from .registry import query, table

EV = "ev AS (SELECT d.doc_id, least(n_chars / 6000.0::DOUBLE, 1) AS score, quality AS y, toxic, lang AS class, source, n_chars FROM documents d JOIN labels l USING (doc_id))"
CUM = """cum AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg, p, n FROM (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM ev GROUP BY score) WINDOW w AS (ORDER BY score DESC))"""


def evaluated(spark, sf) -> DataFrame:
    d, lab = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", F.least(F.col("n_chars") / 6000.0, F.lit(1.0)).alias("score"), F.col("quality").cast("long").alias("y"), F.col("toxic").cast("long").alias("toxic"), F.col("lang").alias("class"), "source", "n_chars")


RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2 AS balanced_accuracy,
CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc, (tp + tn) / (tp + fp + fn + tn) AS accuracy"""
FOUR = "count(*) FILTER (y = 1 AND {p}) AS tp, count(*) FILTER (y = 0 AND {p}) AS fp, count(*) FILTER (y = 1 AND NOT {p}) AS fn, count(*) FILTER (y = 0 AND NOT {p}) AS tn"
RATE_NAMES = "precision recall balanced_accuracy mcc accuracy"


@query(f"WITH {EV}, c AS (SELECT class, {FOUR.format(p='score >= 0.2')} FROM ev GROUP BY class) SELECT *, {RATES} FROM c", RATE_NAMES)
def confusion(spark, sf):
    return metrics.confusion(evaluated(spark, sf), F.col("y"), (F.col("score") >= 0.2).cast("int"), ["class"])


@query(f"WITH {EV}, c AS (SELECT t AS threshold, {FOUR.format(p='score >= t')} FROM ev, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS t) GROUP BY t) SELECT *, {RATES} FROM c", RATE_NAMES)
def threshold_sweep(spark, sf):
    return metrics.threshold_sweep(evaluated(spark, sf), "score", "y", [0.1, 0.2, 0.3, 0.4, 0.5])


@query(f"WITH {EV}, {CUM} SELECT score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tp / (tp + fp) AS precision, tp / pos AS recall, 2 * tp / (tp + fp + pos) AS f1 FROM cum", "threshold precision recall f1")
def pr_curve(spark, sf):
    return metrics.pr_curve(evaluated(spark, sf), "score", "y")


@query(f"WITH {EV}, {CUM} SELECT score AS threshold, tp / (tp + fp) AS precision, tp / pos AS recall, 2 * tp / (tp + fp + pos) AS f1 FROM cum ORDER BY round(2 * tp / (tp + fp + pos), 12) DESC, score DESC LIMIT 1", "threshold precision recall f1")
def best_f1_threshold(spark, sf):
    return metrics.best_f1(evaluated(spark, sf), "score", "y")


@query(f"WITH {EV}, {CUM} SELECT sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg)) AS auc, max(pos)::BIGINT AS positives, max(neg)::BIGINT AS negatives FROM cum", "auc")
def roc_auc(spark, sf):
    return metrics.roc_auc(evaluated(spark, sf), "score", "y")


AT_K = f"WITH {EV}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM ev) SELECT k, sum(y) FILTER (place <= k)::BIGINT AS tp, sum(y) FILTER (place <= k) / k AS precision, sum(y) FILTER (place <= k) / sum(y) AS recall FROM r, (SELECT unnest([10, 20, 50]) AS k) GROUP BY k"


@query(f"SELECT k, tp, recall FROM ({AT_K})", "recall")
def recall_at_k(spark, sf):
    return metrics.at_k(evaluated(spark, sf), "score", "y", "doc_id", [10, 20, 50]).select("k", "tp", "recall")


@query(f"SELECT k, precision FROM ({AT_K})", "precision")
def precision_at_k(spark, sf):
    return metrics.at_k(evaluated(spark, sf), "score", "y", "doc_id", [10, 20, 50]).select("k", "precision")


@query(f"WITH {EV} SELECT greatest(ceil(round(score * 10, 9)), 1)::INTEGER AS bin, count(*) AS n, avg(score) AS mean_score, avg(y) AS positive_rate FROM ev GROUP BY 1", "mean_score positive_rate")
def reliability_bins(spark, sf):
    return metrics.reliability(evaluated(spark, sf), "score", "y")


@query(f"WITH {EV} SELECT count(*) AS n, avg(power(score - y, 2)) AS brier FROM ev", "brier")
def brier(spark, sf):
    return metrics.brier(evaluated(spark, sf), "score", "y")


@query(f"WITH {EV}, g AS (SELECT class, count(*) AS n, count(*) FILTER (y = 0) AS negatives, count(*) FILTER (y = 0 AND score >= 0.2) AS fp FROM ev GROUP BY class) SELECT *, CASE WHEN negatives > 0 THEN fp / negatives ELSE 0 END AS fpr FROM g", "fpr")
def class_fpr(spark, sf):
    e = evaluated(spark, sf).withColumn("p", (F.col("score") >= 0.2).cast("int"))
    return metrics.class_false_positives(e, "class", "y", "p")


@query(f"""WITH {EV}, l AS (SELECT class, 'score' AS feature, score AS value FROM ev UNION ALL SELECT class, 'n_chars', n_chars FROM ev)
SELECT class, feature, count(*) AS n, min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS max FROM l GROUP BY ALL""", "min q25 q50 q75 max")
def fp_quantiles(spark, sf):
    return metrics.feature_quantiles(evaluated(spark, sf), "class", ["score", "n_chars"])


@query(f"WITH {EV} SELECT class, count(*) AS n, avg((score >= 0.2)::INT) AS pass_a, avg((toxic = 0)::INT) AS pass_b FROM ev GROUP BY class", "pass_a pass_b")
def gate_pass_matrix(spark, sf):
    e = evaluated(spark, sf).withColumn("a", F.col("score") >= 0.2).withColumn("b", F.col("toxic") == 0)
    return metrics.gate_matrix(e, "class", ["a", "b"])


@query(f"""WITH {EV}, grid AS (SELECT a AS low, b AS high FROM (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS a), (SELECT unnest([0.5, 0.9, 1.0]::DOUBLE[]) AS b)),
c AS (SELECT low, high, {FOUR.format(p='(score >= low AND score <= high)')} FROM ev, grid GROUP BY ALL), r AS (SELECT *, {RATES} FROM c)
SELECT *, (recall >= 0.6)::INTEGER AS eligible, row_number() OVER (ORDER BY (recall >= 0.6) DESC, round(balanced_accuracy, 9) DESC, tn DESC, round(precision, 9) DESC, low, high)::INTEGER AS place FROM r""", RATE_NAMES)
def grid_tuning(spark, sf):
    grid = spark.sql("SELECT low, high FROM VALUES (0.05D), (0.1D), (0.2D) AS a(low) CROSS JOIN VALUES (0.5D), (0.9D), (1.0D) AS b(high)")
    return metrics.grid_tuning(evaluated(spark, sf), "y", grid, F.col("score").between(F.col("low"), F.col("high")).cast("int"), ["low", "high"], 0.6)


@query(f"""WITH {EV}, r AS (SELECT class, rank() OVER (PARTITION BY class ORDER BY n_chars) + (count(*) OVER (PARTITION BY class, n_chars) - 1) / 2 AS a, rank() OVER (PARTITION BY class ORDER BY y) + (count(*) OVER (PARTITION BY class, y) - 1) / 2 AS b FROM ev)
SELECT class, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS rho FROM r GROUP BY class HAVING count(*) >= 3""", "rho")
def spearman(spark, sf):
    return metrics.spearman(evaluated(spark, sf), "n_chars", "y", ["class"])


@query(f"WITH {EV}, {CUM} SELECT max(abs(tp / pos - fp / neg)) AS ks, max(pos)::BIGINT AS n1, max(neg)::BIGINT AS n0 FROM cum", "ks")
def ks_two_sample(spark, sf):
    return metrics.ks_two_sample(evaluated(spark, sf), "score", F.col("y"))


@query(f"WITH {EV}, {CUM} SELECT sum(p * (neg - fp + n / 2)) AS u, sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg)) AS auc, max(pos)::BIGINT AS n1, max(neg)::BIGINT AS n0 FROM cum", "u auc")
def mann_whitney_u(spark, sf):
    return metrics.mann_whitney(evaluated(spark, sf), "score", "y")


WILSON = "greatest(({k} / {n} + 3.8414588206941236 / (2 * {n})) / (1 + 3.8414588206941236 / {n}) - 1.959963984540054 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8414588206941236 / (4 * {n} * {n})) / (1 + 3.8414588206941236 / {n}), 0) AS low, least(({k} / {n} + 3.8414588206941236 / (2 * {n})) / (1 + 3.8414588206941236 / {n}) + 1.959963984540054 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8414588206941236 / (4 * {n} * {n})) / (1 + 3.8414588206941236 / {n}), 1) AS high"


@query(f"WITH {EV}, g AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (y = 0)::DOUBLE AS k FROM ev GROUP BY source) SELECT source, n::BIGINT AS n, k::BIGINT AS k, k / n AS rate, {WILSON.format(k='k', n='n')} FROM g", "rate low high")
def wilson_ci(spark, sf):
    return metrics.rate_by(evaluated(spark, sf), ["source"], F.col("y") == 0)


@query(f"""WITH {EV}, e AS (SELECT quantile_cont(n_chars, [0.2, 0.4, 0.6, 0.8]) AS q FROM ev), b AS (SELECT len(list_filter(list_distinct(q), lambda x: n_chars > x))::INTEGER AS bin, y FROM ev, e),
g AS (SELECT bin, count(*)::DOUBLE AS n, count(*) FILTER (y = 0)::DOUBLE AS k FROM b GROUP BY bin) SELECT bin, n::BIGINT AS n, k::BIGINT AS k, k / n AS rate, {WILSON.format(k='k', n='n')} FROM g""", "rate low high")
def qcut_rejection(spark, sf):
    return metrics.rate_by(metrics.quantile_bins(evaluated(spark, sf), "n_chars", 5), ["bin"], F.col("y") == 0)


@query(f"WITH {EV} SELECT CASE WHEN score < 0.1 THEN 0 WHEN score < 0.3 THEN 1 WHEN score < 0.6 THEN 2 ELSE 3 END AS bin, count(*) AS n, avg(y) AS fraction FROM ev GROUP BY 1", "fraction")
def z_bin_fraction(spark, sf):
    b = F.when(F.col("score") < 0.1, 0).when(F.col("score") < 0.3, 1).when(F.col("score") < 0.6, 2).otherwise(3)
    return evaluated(spark, sf).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("fraction"))


@query(f"""WITH {EV} SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM ev UNION ALL SELECT 'positives', sum(y)::DOUBLE FROM ev UNION ALL SELECT 'toxic_rate', avg(toxic) FROM ev UNION ALL SELECT 'score_median', median(score) FROM ev""", "value")
def quality_summary(spark, sf):
    a = evaluated(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("rows"), F.sum("y").cast("double").alias("positives"), F.avg("toxic").alias("toxic_rate"), F.median("score").alias("score_median"))
    return a.select(F.expr("stack(4, 'rows', rows, 'positives', positives, 'toxic_rate', toxic_rate, 'score_median', score_median) AS (metric, value)"))


@query(f"""WITH {EV}, u AS (SELECT doc_id, score, y, r, (('0x' || substr(md5('42:' || r || ':' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM ev, (SELECT unnest(range(200)) AS r)),
w AS (SELECT r, y, score, (u > 0.36787944117144233)::INT + (u > 0.36787944117144233 * 2)::INT + (u > 0.36787944117144233 * 2.5)::INT + (u > 0.36787944117144233 * (2.5 + 1 / 6.0))::INT + (u > 0.36787944117144233 * (2.5 + 1 / 6.0 + 1 / 24.0))::INT + (u > 0.36787944117144233 * (2.5 + 1 / 6.0 + 1 / 24.0 + 1 / 120.0))::INT AS w FROM u),
m AS (SELECT r, sum(w * y)::DOUBLE / sum(w) AS rate FROM w WHERE score >= 0.2 GROUP BY r) SELECT quantile_cont(rate, 0.025) AS low, quantile_cont(rate, 0.975) AS high FROM m""", "low high", 4)
def bootstrap_precision(spark, sf):
    from ..operators.sampling import bootstrap_weights

    b = bootstrap_weights(evaluated(spark, sf).filter("score >= 0.2"), "doc_id", 200)
    m = b.groupBy("replicate").agg((F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("rate"))
    return m.agg(F.percentile("rate", F.lit(0.025)).alias("low"), F.percentile("rate", F.lit(0.975)).alias("high"))


@query(f"WITH {EV}, {CUM}, b AS (SELECT score AS threshold, tp / pos AS recall, (tp / pos + 1 - fp / neg) / 2 AS balanced_accuracy FROM cum WHERE tp / pos >= 0.8) SELECT * FROM b ORDER BY round(balanced_accuracy, 12) DESC, threshold DESC LIMIT 1", "threshold recall balanced_accuracy")
def operating_threshold(spark, sf):
    return metrics.operating_threshold(evaluated(spark, sf), "score", "y", 0.8)


@query(f"WITH {EV}, g AS (SELECT avg(power(score - y, 2)) FILTER (y = 0) AS b0, avg(score) FILTER (y = 0) AS s0, avg(power(score - y, 2)) FILTER (y = 1) AS b1, avg(score) FILTER (y = 1) AS s1 FROM ev) SELECT share, share * b1 + (1 - share) * b0 AS brier, share * s1 + (1 - share) * s0 AS mean_score FROM g, (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS share)", "brier mean_score")
def prevalence_shift(spark, sf):
    return metrics.prevalence_shift(evaluated(spark, sf), "score", "y", [0.1, 0.5, 0.9])
