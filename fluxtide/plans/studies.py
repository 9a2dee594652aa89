"""Queries over kernel models, posteriors, lags, score uncertainty, threshold search and
injection campaigns."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..functions.params import P
from ..operators import campaign, cascade, kernels, lags, posterior, resampling, stochastic, tuning
from ..operators.sampling import top_n
from ..operators.variability import delta_standard
from . import lightcurves
from .evaluation import RATES
from .lightcurves import LC, SEASONS, SOURCE, light_curve, season_table
from ..sources.store import shared_path
from .models import _days, _vectors, _w1
from .registry import ORACLE_SQL, query, table


@query()
def stepped_walk(spark, sf):
    """The walk with a step in its covariance, every epoch tried, all four parameters fitted."""
    return kernels.fit_stepped_walk(_w1(spark, sf))


@query()
def distribution_breaks(spark, sf):
    """Over ten to the power of -0.4 magnitudes, as the penalty is in the signal's own unit."""
    share = (F.col("flux") / (1000.0 * P.zero_point_jy["W1"])).alias("share")
    return kernels.distribution_breaks(light_curve(spark, sf).filter("flux > 0").select("source_id", "mjd", share), value="share")


@query()
def color_lag(spark, sf):
    return lags.colour_lag(_days(spark, sf).withColumn("c", F.col("a") - F.col("b")), "source_id", "a", "c", least=5)


def _largest(spark, sf, n: int):
    """The n sources with the largest amplitude."""
    a = delta_standard(season_table(spark, sf), SOURCE).withColumn("a", F.abs("delta_mag"))
    return top_n(a, "a", SOURCE, n).select("source_id", "rank")


@query()
def walk_posterior(spark, sf):
    """Full sampling for the ten sources with the largest amplitude."""
    top = _largest(spark, sf, 10).select("source_id")
    return posterior.walk_posterior(light_curve(spark, sf).filter("flux > 0").join(F.broadcast(top), "source_id"))


@query()
def advanced_walks(spark, sf):
    """The three models of the best candidates side by side: posterior, broken walk and stepped
    walk.  A candidate with too few epochs for a model has nulls there."""
    top = _largest(spark, sf, 10)
    curves = light_curve(spark, sf).filter("flux > 0").join(F.broadcast(top.select("source_id")), "source_id")
    p = posterior.walk_posterior(curves).select("source_id", "tau16", "tau50", "tau84", "sigma50", "converged", "rhat_tau")
    b = stochastic.fit_broken_walk(curves).select("source_id", F.col("delta_bic").alias("broken_bic"), F.col("break_mjd").alias("broken_mjd"))
    s = kernels.fit_stepped_walk(curves).select("source_id", F.col("log_bayes").alias("step_log_bayes"), F.col("break_mjd").alias("step_mjd"))
    return top.join(p, "source_id", "left").join(b, "source_id", "left").join(s, "source_id", "left")


# --- score uncertainty -------------------------------------------------------------------

U = lambda *parts: "(('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"

REPLICATES = f"""{SEASONS}, num AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY season) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS s, sum(n) OVER (PARTITION BY source_id) AS pts FROM sf),
rounds AS (SELECT source_id, s, unnest(range(100)) AS r FROM num WHERE i = 0 AND s >= 4 AND pts >= 10), draws AS (SELECT source_id, s, r, unnest(range(s)) AS k FROM rounds),
times AS (SELECT source_id, r, floor({U("'42'", "r", "source_id", "k")} * s)::BIGINT AS i, count(*) AS times FROM draws GROUP BY ALL),
rep0 AS (SELECT t.source_id, r, season, num.t, med, greatest(1.4826 * mad / sqrt(n * times), 1e-10) AS stat_err FROM times t JOIN num USING (source_id, i)),
rep AS (SELECT *, greatest(sqrt(power(stat_err, 2) + power(0.028 * abs(med), 2)), 1e-10) AS err FROM rep0),
od AS (SELECT *, row_number() OVER (PARTITION BY source_id, r ORDER BY season) AS up, row_number() OVER (PARTITION BY source_id, r ORDER BY season DESC) AS down, 1 / (err * err) AS w, med / (err * err) AS x, count(*) OVER (PARTITION BY source_id, r) AS m FROM rep),
am AS (SELECT source_id, r, CASE WHEN max(m) >= 4 THEN abs((sum(x) FILTER (down <= 2) / sum(w) FILTER (down <= 2)) / (sum(x) FILTER (up <= 2) / sum(w) FILTER (up <= 2)) - 1) END AS change FROM od GROUP BY ALL),
cu AS (SELECT *, sum(w) OVER u AS a, sum(x) OVER u AS ax, sum(w) OVER v AS tw, sum(x) OVER v AS tx, lead(t) OVER (PARTITION BY source_id, r ORDER BY season) AS nx FROM od WINDOW u AS (PARTITION BY source_id, r ORDER BY season ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY source_id, r)),
bk AS (SELECT source_id, r, nx, season, ax * ax / a + (tx - ax) * (tx - ax) / (tw - a) - tx * tx / tw - 2 * ln(m) AS bic FROM cu WHERE nx IS NOT NULL),
be AS (SELECT * FROM bk QUALIFY row_number() OVER (PARTITION BY source_id, r ORDER BY round(bic, 6) DESC, season) = 1),
js AS (SELECT am.source_id, coalesce(least(greatest(change / 2, 0), 1), 0) AS c, coalesce(least(greatest(bic / 20, 0), 1), 0) AS b, nx FROM am LEFT JOIN be USING (source_id, r)),
jj AS (SELECT *, (3 * c + 3 * b) / 6 AS j FROM js)"""


@query(f"""WITH {REPLICATES} SELECT source_id, count(*) AS n_replicates, stddev_pop(c) AS score_err, quantile_cont(c, 0.16) AS score_lo, quantile_cont(c, 0.84) AS score_hi, quantile_cont(nx, 0.16) AS break_lo, quantile_cont(nx, 0.84) AS break_hi,
stddev_pop(j) AS joint_err, quantile_cont(j, 0.16) AS joint_lo, quantile_cont(j, 0.84) AS joint_hi FROM jj GROUP BY source_id""", "score_err score_lo score_hi break_lo break_hi joint_err joint_lo joint_hi", 5)
def score_uncertainty(spark, sf):
    return resampling.score_uncertainty(season_table(spark, sf), "source_id")


# --- threshold search --------------------------------------------------------------------

KINDS = {1: "star", 2: "blazar", 3: "sn"}
CAPS, WEIGHTS = {"normal_agn": 0.25, "star": 0.25}, {"normal_agn": 0.5, "star": 0.3, "sn": 0.2}
EVAL = f"""te AS (SELECT c_custkey AS id, (c_custkey * 7) % 10 < 3 AS y, CASE c_custkey % 5 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in KINDS.items())} ELSE 'normal_agn' END AS kind, c_acctbal > -500 AS base, state_change_ratio AS ratio, nonpeak, adjacency, seasons AS band_seasons, n AS points, nb AS bins
FROM customer LEFT JOIN ({ORACLE_SQL['state_change_ratio']}) ON c_custkey = source_id LEFT JOIN ({ORACLE_SQL['transient_spike']}) t ON c_custkey = t.source_id
LEFT JOIN (SELECT user_id, count(*) AS n, count(DISTINCT date_trunc('week', ts)) AS nb FROM events GROUP BY user_id) e ON c_custkey = e.user_id)"""
_points = ", ".join(f"({', '.join(f'{x}::DOUBLE' for x in p)})" for p in product(*tuning.GRID.values()))
_four = "count(*) FILTER (y AND pred) AS tp, count(*) FILTER (NOT y AND pred) AS fp, count(*) FILTER (y AND NOT pred) AS fn, count(*) FILTER (NOT y AND NOT pred) AS tn"
_fpr = lambda k: f"CASE WHEN count(*) FILTER (NOT y AND kind = '{k}') > 0 THEN count(*) FILTER (NOT y AND kind = '{k}' AND pred) / count(*) FILTER (NOT y AND kind = '{k}') END AS fpr_{k}"
_names = "ratio, peak, near, points, seasons"


@query(f"""WITH {EVAL}, grid({_names}) AS (VALUES {_points}),
p AS (SELECT g.*, y, kind, floor({U("'42'", "id")} * 5) AS fold, coalesce(base, false) AND coalesce(te.points, -1) >= g.points AND coalesce(bins, -1) >= g.seasons AND coalesce(te.ratio >= g.ratio, false) AND NOT (coalesce(nonpeak < peak, false) AND coalesce(adjacency < near, false) AND coalesce(band_seasons, 0) >= g.seasons) AS pred FROM te, grid g),
f AS (SELECT {_names}, fold, {_four} FROM p GROUP BY {_names}, fold), fr AS (SELECT *, {RATES} FROM f), cv AS (SELECT {_names}, avg(balanced_accuracy) AS cv_balanced_accuracy FROM fr GROUP BY {_names}),
w AS (SELECT {_names}, {_four}, {', '.join(_fpr(k) for k in ('blazar', 'normal_agn', 'sn', 'star'))} FROM p GROUP BY {_names}), wr AS (SELECT *, {RATES} FROM w),
m AS (SELECT *, 0.5 * coalesce(fpr_normal_agn, 0) + 0.3 * coalesce(fpr_star, 0) + 0.2 * coalesce(fpr_sn, 0) AS weighted_fp, recall >= 0.5 AS meets_recall, coalesce(fpr_blazar <= 0.3, false) AS meets_veto, coalesce(fpr_normal_agn <= 0.25, true) AND coalesce(fpr_star <= 0.25, true) AS meets_caps FROM wr JOIN cv USING ({_names}))
SELECT *, row_number() OVER (ORDER BY (meets_recall AND meets_veto AND meets_caps) DESC, round(cv_balanced_accuracy, 9) DESC, CASE WHEN NOT (meets_recall AND meets_veto AND meets_caps) THEN round(recall, 9) END DESC NULLS LAST, round(weighted_fp, 9), CASE WHEN NOT (meets_recall AND meets_veto AND meets_caps) THEN coalesce(round(fpr_blazar, 9), 1e9) END NULLS FIRST, tn DESC, round(precision, 9) DESC, {_names})::INTEGER AS place FROM m""", "precision recall balanced_accuracy mcc accuracy cv_balanced_accuracy weighted_fp fpr_blazar fpr_normal_agn fpr_sn fpr_star")
def gate_search(spark, sf):
    """All 324 thresholds of five gates over the catalogue, with folds, caps and the choice."""
    c = table(spark, sf, "customer")
    m = F.col("c_custkey") % 5
    kind = F.lit("normal_agn")
    for k, v in KINDS.items():
        kind = F.when(m == k, v).otherwise(kind)
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("points"), F.count_distinct(F.date_trunc("week", "ts")).alias("bins"))
    rows = c.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7) % 10 < 3).alias("y"), kind.alias("kind"), (F.col("c_acctbal") > -500).alias("base"))
    rows = rows.join(lightcurves.state_change_ratio(spark, sf).withColumnRenamed("source_id", "id"), "id", "left").join(lightcurves.transient_spike(spark, sf).withColumnRenamed("source_id", "id"), "id", "left").join(e, "id", "left")
    features = {"ratio": "state_change_ratio", "points": "points", "seasons": "bins", "nonpeak": "nonpeak", "adjacency": "adjacency", "band_seasons": "seasons"}
    found = tuning.patterns(rows, "id", "y", "kind", F.col("base"), features)
    return tuning.search(found, recall_target=0.5, veto_target=0.3, caps=CAPS, weights=WEIGHTS)


# --- injection campaigns -----------------------------------------------------------------

CADENCE = f"""hosts AS (SELECT user_id AS source_id, median(value) AS level FROM events GROUP BY user_id HAVING median(value) > 0),
vi AS (SELECT source_id, visit, sum(CASE WHEN visit > 0 THEN 180.0::DOUBLE + 5.0::DOUBLE * (2.0::DOUBLE * {U("'0'", "'gap'", "source_id", "visit")} - 1.0::DOUBLE) ELSE 0::DOUBLE END) OVER (PARTITION BY source_id ORDER BY visit) AS t FROM (SELECT source_id, unnest(range(21)) AS visit FROM hosts)),
ex AS (SELECT source_id, visit, t, unnest(range((8 + floor({U("'0'", "'count'", "source_id", "visit")} * 8))::BIGINT)) AS exposure FROM vi WHERE t < 3650),
ti AS (SELECT source_id, visit, exposure, 56800.0::DOUBLE + t + 2.0::DOUBLE * {U("'0'", "'time'", "source_id", "visit", "exposure")} AS mjd FROM ex),
ca AS (SELECT * FROM ti QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY {U("'0'", "'pick'", "source_id", "visit", "exposure")}, visit, exposure) <= 10)"""


@query(f"WITH {CADENCE} SELECT * FROM ca", "mjd")
def visit_cadence(spark, sf):
    """Ten epochs a source on visits about every half year."""
    return campaign.cadence(_hosts(spark, sf), "source_id")


def _hosts(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.median("value").alias("level"))
    return e.filter("level > 0")


_gauss = lambda *p: f"sqrt(-2.0::DOUBLE * ln({U(*p, repr('r'))} + 1.1102230246251565e-16::DOUBLE)) * cos(6.283185307179586::DOUBLE * {U(*p, repr('a'))})"
# Amplitudes as Spark writes doubles.
_amps = ", ".join(f"({a}::DOUBLE, '{a}')" for a in campaign.AMPLITUDES)
_by = "source_id, amplitude, shape, trial"
_keys = "source_id", "label", "shape", "trial"
CAMPAIGN = f"""{CADENCE}, grid AS (SELECT * FROM (VALUES {_amps}) a(amplitude, label), (SELECT unnest(['step', 'ramp', 'gaussian', 'sinusoidal']) AS shape), (SELECT unnest(range(2)) AS trial)),
tr AS (SELECT ca.source_id, mjd, level, grid.*, row_number() OVER (PARTITION BY ca.source_id, amplitude, shape, trial ORDER BY mjd) AS i, min(mjd) OVER (PARTITION BY ca.source_id) AS a, max(mjd) OVER (PARTITION BY ca.source_id) AS b FROM ca JOIN hosts USING (source_id), grid),
wa AS (SELECT *, (mjd - a) / 300 AS s FROM tr), wb AS (SELECT *, exp(s) * coalesce(sqrt(1 - exp(-2 * (s - lag(s) OVER (PARTITION BY {_by} ORDER BY mjd)))), 1) * {_gauss("'12345'", "'walk'", *_keys, 'i')} AS e FROM wa),
wc AS (SELECT *, 0.05 * exp(-s) * sum(e) OVER (PARTITION BY {_by} ORDER BY mjd) AS walk, greatest(b - a, 1) AS span FROM wb),
cu AS (SELECT {_by}, mjd, level * (1 + walk + 0.02 * {_gauss("'12345'", "'noise'", *_keys, 'i')} + 0.4 * ln(10) * amplitude * CASE shape WHEN 'ramp' THEN least(greatest((mjd - (a + 0.35 * span)) / greatest(0.3 * span, 1), 0), 1) WHEN 'gaussian' THEN exp(-0.5 * power((mjd - 0.5 * (a + b)) / (0.15 * span), 2))
  WHEN 'sinusoidal' THEN 0.5 * (1 + sin(6.283185307179586 * (mjd - a) / (0.3 * span))) ELSE (mjd > 0.5 * (a + b) + 0.2 * ({U("'12345'", "'start'", *_keys)} - 0.5) * span)::INT::DOUBLE END) AS flux FROM wc),
nu AS (SELECT *, row_number() OVER (PARTITION BY {_by} ORDER BY mjd) AS i, count(*) OVER (PARTITION BY {_by}) AS n FROM cu),
q AS (SELECT {_by}, max(n) AS n, median(flux) AS mid, median(flux) FILTER (i <= greatest(1, n // 5)) AS early, median(flux) FILTER (i > n - greatest(1, n // 5)) AS late, avg(flux) FILTER (i <= n // 2) AS m1, avg(flux) FILTER (i > n // 2) AS m2,
  stddev_pop(flux) FILTER (i <= n // 2) / greatest(sqrt(count(*) FILTER (i <= n // 2)), 1) AS e1, stddev_pop(flux) FILTER (i > n // 2) / greatest(sqrt(count(*) FILTER (i > n // 2)), 1) AS e2 FROM nu GROUP BY {_by}),
sc AS (SELECT *, least(1, abs(late - early) / greatest(mid, 1e-6)) AS x, tanh(abs(m2 - m1) / greatest(sqrt(e1 * e1 + e2 * e2), 1e-8) / 3) AS y FROM q),
tq AS (SELECT {_by}, CASE WHEN n >= 5 AND mid > 0 THEN 0.35 * x + 0.35 * y + 0.30 * (0.5 * (x + y)) ELSE 0 END AS score, CASE WHEN early > 0 AND late > 0 THEN 2.5 * log10(late / early) END AS measured FROM sc),
cm AS (SELECT amplitude, shape, count(*) AS n_trials, count(*) FILTER (score > 0.5) AS n_recovered, avg(score) AS mean_score, avg(measured - amplitude) AS bias, count(*) FILTER (score > 0.5) / count(*) AS completeness FROM tq GROUP BY amplitude, shape)"""


@query(f"WITH {CAMPAIGN} SELECT * FROM cm", "mean_score bias completeness", 5)
def injection_campaign(spark, sf):
    """Seven amplitudes, four shapes, two trials a source on its own cadence and level."""
    return campaign.completeness(campaign.trials(_hosts(spark, sf), "source_id", "level"))


@query(f"WITH {CAMPAIGN}, av AS (SELECT amplitude, avg(completeness) AS c FROM cm GROUP BY amplitude) SELECT min(amplitude) FILTER (round(c, 9) >= 0.5) AS half, min(amplitude) FILTER (round(c, 9) >= 0.9) AS nine_tenths FROM av")
def campaign_thresholds(spark, sf):
    return campaign.thresholds(campaign.completeness(campaign.trials(_hosts(spark, sf), "source_id", "level")))


_scales = {0.5: 0, 1.0: 1, 2.0: 2, 5.0: 3}
_ok = " UNION ALL ".join(f"SELECT source_id, mjd AS start, {x}::DOUBLE AS timescale, {k} AS tag, rank() OVER (PARTITION BY source_id ORDER BY mjd) - 1 AS pre, count(*) OVER (PARTITION BY source_id ORDER BY mjd RANGE BETWEEN {x}::DOUBLE FOLLOWING AND UNBOUNDED FOLLOWING) AS post FROM mg" for x, k in _scales.items())


@query(f"""WITH {LC}, mg AS (SELECT source_id, mjd, -2.5 * log10(flux) AS m FROM lc WHERE flux > 0), ev AS ({_ok}),
ok AS (SELECT *, row_number() OVER (PARTITION BY source_id, timescale ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY source_id, timescale) AS m FROM ev WHERE pre >= 3 AND post >= 3),
pk AS (SELECT source_id, timescale, floor({U("'42'", "source_id", "tag", "r")} * m)::BIGINT AS i FROM (SELECT *, unnest(range(20)) AS r FROM ok WHERE i = 0)),
st AS (SELECT pk.source_id, pk.timescale, start FROM pk JOIN ok USING (source_id, timescale, i)),
md AS (SELECT d.source_id, timescale, start, median(m) FILTER (mjd < start) AS pre, median(m) FILTER (mjd >= start + timescale) AS post FROM (SELECT DISTINCT * FROM st) d JOIN mg USING (source_id) GROUP BY ALL),
fd AS (SELECT amplitude, timescale, pre - post + amplitude AS measured FROM st JOIN md USING (source_id, timescale, start), (SELECT unnest([0.2, 0.5, 1.0, 1.5]::DOUBLE[]) AS amplitude))
SELECT amplitude, timescale, count(*) AS n_trials, count(*) FILTER (abs(measured) >= 0.5) AS n_recovered, avg(measured - amplitude) AS bias, count(*) FILTER (abs(measured) >= 0.5) / count(*) AS completeness FROM fd GROUP BY ALL""", "bias completeness", 5)
def host_recovery(spark, sf):
    """Brightenings put into every source's own curve at twenty drawn epochs a timescale (days
    stand for years)."""
    m = light_curve(spark, sf).filter("flux > 0").select("source_id", "mjd", (-2.5 * F.log10("flux")).alias("m"))
    return campaign.host_recovery(m, "source_id", "m")


# --- cascade -----------------------------------------------------------------------------


def _cascade(spark, sf):
    v, names = _vectors(spark, sf)
    train, dev = v.filter("vec_id % 5 <> 0"), v.filter("vec_id % 5 = 0")
    return cascade.fit(train, dev, "vec_id", names, "y"), v, names


@query()
def cascade_trials(spark, sf):
    """Fifty trials of the trees behind the gate, with the value that chose among them."""
    (_, done), _, _ = _cascade(spark, sf)
    return cascade.trial_table(spark, done)


@query()
def cascade_predictions(spark, sf):
    """The cascade fitted, stored, read back and applied to all vectors."""
    (model, _), v, _ = _cascade(spark, sf)
    path = shared_path(spark)
    cascade.save(spark, model, path, "v1")
    return cascade.predict(v, cascade.load(spark, path, "v1"), "vec_id", ("y",))


@query()
def feature_ablation(spark, sf):
    """Eight groups of features added one by one and left out one by one."""
    v, names = _vectors(spark, sf)
    groups = {f"g{k}": names[8 * k : 8 * k + 8] for k in range(8)}
    params = {"leaves": 31, "depth": 6, "rate": 0.1, "least": 20, "rows": 0.8, "columns": 0.8, "l1": 1e-3, "l2": 1.0, "weight": 1.0, "split": 0.0}
    return cascade.ablation(v.filter("vec_id % 5 <> 0"), v.filter("vec_id % 5 = 0"), "vec_id", groups, "y", params)
