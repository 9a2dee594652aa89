"""The run over the whole catalogue, on the fitted models; population, sensitivity, policies
and older benchmark forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import astrometry
from ..functions.stats import NORMALISERS, sigma_excess
from ..operators import kernels, population, resampling, scoring, sensitivity, stochastic
from ..sources import legacy
from ..sources.store import materialise
from . import lightcurves
from . import scoring as plain
from .lightcurves import SEASONS, light_curve, season_table
from .registry import query, table


def fits(spark, sf) -> DataFrame:
    """(source_id, sigma, tau, mean_flux, broken_bic, step_log_bayes): the walk, the broken walk
    and the stepped walk of every source that has epochs enough for each."""
    curves = light_curve(spark, sf).filter("flux > 0")
    one = curves.filter("band = 'W1'")
    # Written one after the other: no two models' groups are in memory together.
    w = materialise(stochastic.fit_walk(one).select("source_id", "sigma", "tau"))
    m = one.groupBy("source_id").agg(F.avg("flux").alias("mean_flux"))
    b = materialise(stochastic.fit_broken_walk(curves).select("source_id", F.col("delta_bic").alias("broken_bic")))
    s = materialise(kernels.fit_stepped_walk(one).select("source_id", F.col("log_bayes").alias("step_log_bayes")))
    return m.join(w.hint("merge"), "source_id", "left").join(b.hint("merge"), "source_id", "full_outer").join(s.hint("merge"), "source_id", "left")


def fitted_evidence() -> dict:
    """The components of the scores with the models' own evidence: the broken walk's gain, the
    step's Bayes factor, and the walk's amplitude over what the flux leads to expect."""
    n = NORMALISERS
    excess = F.when(F.col("sigma").isNotNull(), sigma_excess(F.col("sigma"), F.col("mean_flux")))
    return plain.evidence() | {"broken": n["broken"](F.col("broken_bic")), "step_process": n["step_process"](F.col("step_log_bayes")), "sigma_excess": n["sigma_excess"](excess)}


@query()
def source_run(spark, sf):
    """One row for every source of the catalogue: status, number of epochs, both scores on the
    fitted models with the uncertainty of the amplitude's, the penalised score with its reasons,
    class and label.  Sources without enough epochs have their status and nulls."""
    with lightcurves.written_once(spark, sf):
        status = plain.source_status(spark, sf)
        # As the models, features and uncertainties are written before they meet.
        features = plain.features(spark, sf, materialise)
        spread = materialise(resampling.score_uncertainty(season_table(spark, sf), "source_id").select("source_id", "score_err", "score_lo", "score_hi"))
        rows = features.join(fits(spark, sf).hint("merge"), "source_id", "left").join(spread.hint("merge"), "source_id", "left")
    c = fitted_evidence()
    rows = rows.withColumns({"v3": scoring.composite_v3(c), "v2": scoring.composite_v2(c)})
    flags = {name: F.expr(on) for name, on, _ in plain.PENALTIES}
    score, reasons = scoring.penalised(F.col("v3"), flags)
    rows = rows.withColumns({"score": score, "reasons": reasons})
    gates = {"stage_a": F.col("score") >= 0.3493918746, "blazar_veto": F.col("class") != "blazar", "qc": F.col("n_points") >= 50, "data": F.col("baseline") >= 28, "state_change": F.abs("delta_mag") > 0.2, "transient": F.col("width") > 1}
    kept = rows.select("source_id", "v3", "v2", "score_err", "score_lo", "score_hi", "score", "reasons", "class", "sigma", "tau", "broken_bic", "step_log_bayes", scoring.final_label(gates, F.col("class")).alias("label"), scoring.gate_trace(gates).alias("trace"))
    ok = F.col("status") == "OK"
    out = status.join(kept.hint("merge"), "source_id", "left")
    return out.select("source_id", "status", "n_points", *[F.when(ok, F.col(x)).alias(x) for x in kept.columns[1:]])


# --- population --------------------------------------------------------------------------

PARENT = "pa AS (SELECT c_custkey AS id, ((c_custkey * 37) % 500) / 100.0::DOUBLE AS z, c_acctbal > 8000 AS chosen, c_mktsegment AS segment, c_acctbal AS lum FROM customer)"


def _parent(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), (F.pmod(k * 37, F.lit(500)) / 100.0).alias("z"), (F.col("c_acctbal") > 8000).alias("chosen"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("lum"))


@query(f"""WITH {PARENT}, b AS (SELECT * FROM (VALUES (0.0::DOUBLE, 0.1::DOUBLE), (0.1, 0.3), (0.3, 0.5), (0.5, 1.0), (1.0, 2.0), (2.0, 5.0)) t(low, high))
SELECT low, high, count(id) AS n_all, count(id) FILTER (chosen) AS n_chosen, count(id) FILTER (chosen) / greatest(count(id), 1) AS fraction FROM b LEFT JOIN pa ON z >= low AND z < high GROUP BY low, high""", "fraction")
def candidate_fraction(spark, sf):
    return population.fraction_by(_parent(spark, sf), "z", "chosen")


@query(f"""WITH {PARENT}, d AS (SELECT z, count(*) AS a, count(*) FILTER (chosen) AS c FROM pa GROUP BY z), u AS (SELECT sum(a) OVER (ORDER BY z DESC) AS ca, sum(c) OVER (ORDER BY z DESC) AS cc, sum(a) OVER () AS na, sum(c) OVER () AS nc FROM d),
k AS (SELECT max(abs(cc / nc - ca / na)) AS ks, max(na)::BIGINT AS n_all, max(nc)::BIGINT AS n_chosen FROM u), l AS (SELECT *, sqrt(n_all * n_chosen / (n_all + n_chosen)) * ks AS lam FROM k)
SELECT ks, n_all, n_chosen, CASE WHEN lam < 0.04 THEN 1 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda j: pow(-1, j - 1) * exp(-2 * j * j * lam * lam))), 0), 1) END::DOUBLE AS p FROM l""", "ks p")
def candidate_ks(spark, sf):
    return population.ks_against(_parent(spark, sf), "z", "chosen")


@query()
def population_summary(spark, sf):
    """Occurrence rate with its exact interval, medians and the test, in one row."""
    return population.summary(_parent(spark, sf), "z", "chosen")


_U = lambda *parts: "(('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


@query(f"""WITH {PARENT}, d AS (SELECT segment, id, lum, row_number() OVER (PARTITION BY segment ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY segment) AS n FROM pa WHERE chosen),
dr AS (SELECT segment, r, floor({_U("'42'", "r", "segment", "k")} * n)::BIGINT AS i FROM (SELECT segment, n, i AS k, unnest(range(1000)) AS r FROM d)),
b AS (SELECT segment, r, median(lum) AS b FROM dr JOIN d USING (segment, i) GROUP BY segment, r), s AS (SELECT segment, quantile_cont(b, 0.16) AS lo, quantile_cont(b, 0.84) AS hi FROM b GROUP BY segment)
SELECT d.segment, count(*) AS n, median(lum) AS median, any_value(lo) AS lo, any_value(hi) AS hi FROM d JOIN s USING (segment) GROUP BY d.segment""", "median lo hi", 4)
def candidate_bootstrap(spark, sf):
    """A thousand replicates of the median luminosity of each segment's candidates."""
    return population.bootstrap_median(_parent(spark, sf).filter("chosen"), "lum", ["segment"], "id")


# --- sensitivity -------------------------------------------------------------------------

# A month-long series stands for a decade: days for years.
SWEEPS = sensitivity.SWEEPS | {"min_baseline": (26.0, 28.0, 29.0)}
USUAL = sensitivity.USUAL | {"min_baseline": 28.0}
_settings = ", ".join(f"('{p}', {v}::DOUBLE, {', '.join(str(v if n == p else USUAL[n]) + '::DOUBLE' for n in USUAL)})" for p, vs in SWEEPS.items() for v in vs)


@query(f"""WITH {SEASONS}, st(param, value, {', '.join(USUAL)}) AS (VALUES {_settings}), bl AS (SELECT source_id, max(mjd) - min(mjd) AS baseline FROM lc GROUP BY source_id),
o AS (SELECT st.*, source_id, baseline, med, 1 / (err * err) AS w, row_number() OVER (PARTITION BY param, value, source_id ORDER BY season) AS u, row_number() OVER (PARTITION BY param, value, source_id ORDER BY season DESC) AS d FROM sf JOIN bl USING (source_id), st WHERE n >= epochs_per_season),
g AS (SELECT param, value, source_id, any_value(min_seasons) AS ms, any_value(min_baseline) AS mb, any_value(min_delta_mag) AS md, any_value(operating_threshold) AS th, count(*) AS s, max(baseline) AS baseline, sum(w * med) FILTER (u <= 2) / sum(w) FILTER (u <= 2) AS early, sum(w * med) FILTER (d <= 2) / sum(w) FILTER (d <= 2) AS late FROM o GROUP BY param, value, source_id),
a AS (SELECT *, CASE WHEN s >= ms AND baseline >= mb AND early > 0 AND late > 0 THEN late / early END AS ratio, (source_id * 7) % 10 < 3 AS y FROM g),
p AS (SELECT *, least(abs(ratio - 1) / 2, 1) AS score, coalesce(least(abs(ratio - 1) / 2, 1) >= th AND abs(2.5 * log10(ratio)) >= md, false) AS pred FROM a),
f AS (SELECT param, value, count(*) FILTER (pred) AS n_candidates, count(*) FILTER (y AND pred) AS tp, count(*) FILTER (NOT y AND pred) AS fp, count(*) FILTER (y AND NOT pred) AS fn, count(*) FILTER (NOT y AND NOT pred) AS tn FROM p GROUP BY param, value),
di AS (SELECT param, value, score, count(*) FILTER (y) AS p1, count(*) FILTER (NOT y) AS n1 FROM p WHERE score IS NOT NULL GROUP BY param, value, score),
cu AS (SELECT *, sum(p1) OVER w AS tp, sum(n1) OVER w AS fp, sum(p1) OVER (PARTITION BY param, value) AS pos FROM di WINDOW w AS (PARTITION BY param, value ORDER BY score DESC)),
ap AS (SELECT param, value, CASE WHEN max(pos) > 0 THEN sum(p1 * tp / (tp + fp)) / max(pos) END AS auc_pr FROM cu GROUP BY param, value)
SELECT f.*, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2 AS balanced_accuracy,
CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc, (tp + tn) / (tp + fp + fn + tn) AS accuracy, auc_pr, max(auc_pr) OVER (PARTITION BY param) - min(auc_pr) OVER (PARTITION BY param) AS auc_range FROM f LEFT JOIN ap USING (param, value)""", "precision recall balanced_accuracy mcc accuracy auc_pr auc_range", 5)
def sensitivity_sweep(spark, sf):
    s = season_table(spark, sf)
    base = light_curve(spark, sf).groupBy("source_id").agg((F.max("mjd") - F.min("mjd")).alias("baseline"))
    truth = base.select("source_id", ((F.col("source_id") * 7) % 10 < 3).cast("long").alias("y"))
    return sensitivity.sweep(s.join(base, "source_id"), truth, "source_id", "y", sensitivity.settings(spark, SWEEPS, USUAL))


# --- astrometric and colour variability ----------------------------------------------------


@query("""WITH x AS (SELECT c_custkey AS id, (c_custkey % 13) / 10.0::DOUBLE AS noise, (c_custkey % 7)::DOUBLE AS sig, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 20) / 10.0::DOUBLE END AS ruwe, ((c_custkey % 9) - 4)::DOUBLE AS pa, (c_custkey % 4) / 2.0::DOUBLE AS pae, ((c_custkey % 11) - 5)::DOUBLE AS pd, 2.0::DOUBLE AS pde, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 8)::DOUBLE END AS plx, 1.5::DOUBLE AS plxe, CASE WHEN c_custkey % 6 > 0 THEN (c_custkey % 10) / 10.0::DOUBLE END AS q FROM customer),
y AS (SELECT *, greatest(abs(pa) / greatest(coalesce(nullif(pae, 0), 1), 1e-6), abs(pd) / pde) AS pm_sig, CASE WHEN plx IS NOT NULL THEN abs(plx) / plxe ELSE 0 END AS parallax_sig, noise > 0.5 AND sig > 2 AS is_variable FROM x),
z AS (SELECT *, concat_ws('; ', CASE WHEN parallax_sig > 3 THEN 'parallax' END, CASE WHEN pm_sig > 3 THEN 'proper_motion' END, CASE WHEN coalesce(nullif(ruwe, 0), 1) > 1.4 THEN 'ruwe' END, CASE WHEN q < 0.1 THEN 'quasar_probability' END) AS star_reasons FROM y)
SELECT id, pm_sig, parallax_sig, is_variable, star_reasons <> '' AS is_star, star_reasons, CASE WHEN is_variable AND star_reasons = '' THEN least(1, sig / 10) ELSE 0 END::DOUBLE AS score FROM z""", "pm_sig parallax_sig score")
def astrometric_variability(spark, sf):
    k = F.col("c_custkey")
    d = lambda c: c.cast("double")
    v = astrometry.astrometric_variability(k % 13 / 10.0, d(k % 7), F.when(k % 5 > 0, k % 20 / 10.0), d(k % 9 - 4), k % 4 / 2.0, d(k % 11 - 5), F.lit(2.0), F.when(k % 3 > 0, d(k % 8)), F.lit(1.5), F.when(k % 6 > 0, k % 10 / 10.0))
    return table(spark, sf, "customer").select(k.alias("id"), *[c.alias(n) for n, c in v.items()])


@query("""WITH x AS (SELECT p_partkey AS id, 17 + (p_partkey % 30) / 10.0::DOUBLE AS bp, CASE WHEN p_partkey % 7 > 0 THEN 16.5 + (p_partkey % 20) / 10.0::DOUBLE END AS rp, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 25) / 10.0::DOUBLE END AS c, CASE p_partkey % 4 WHEN 0 THEN 'VARIABLE' WHEN 1 THEN 'not_variable' WHEN 2 THEN 'CONSTANT' END AS f, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 10) / 10.0::DOUBLE END AS q FROM part),
y AS (SELECT *, coalesce(nullif(c, 0), bp - rp) AS bp_rp FROM x)
SELECT id, bp_rp, CASE WHEN bp_rp < 0.5 THEN 'blue' WHEN bp_rp > 1.5 THEN 'red' WHEN bp_rp IS NOT NULL THEN 'intermediate' ELSE 'unknown' END AS color_class, coalesce(upper(f) LIKE '%VARIABLE%', false) AS is_variable, coalesce(q, 0) AS quasar_prob, coalesce(q > 0.5, false) AS is_quasar FROM y""", "bp_rp quasar_prob")
def color_variability(spark, sf):
    k = F.col("p_partkey")
    flag = F.when(k % 4 == 0, "VARIABLE").when(k % 4 == 1, "not_variable").when(k % 4 == 2, "CONSTANT")
    v = astrometry.colour_variability(17 + k % 30 / 10.0, F.when(k % 7 > 0, 16.5 + k % 20 / 10.0), F.when(k % 3 > 0, k % 25 / 10.0), flag, F.when(k % 5 > 0, k % 10 / 10.0))
    return table(spark, sf, "part").select(k.alias("id"), *[c.alias(n) for n, c in v.items()])


# --- older benchmark forms -----------------------------------------------------------------


@query("""SELECT c_name AS source_id, ((c_custkey * 13) % 360)::DOUBLE AS ra, ((c_custkey * 7) % 180 - 90)::DOUBLE AS dec, 'positive' AS label, c_name AS label_source, CASE WHEN c_nationkey % 3 = 1 THEN 'spectroscopic' ELSE 'photometric' END AS label_method, true AS independent_of_pipeline, c_mktsegment AS notes FROM customer
UNION ALL SELECT s_name, ((s_suppkey * 13) % 360)::DOUBLE, ((s_suppkey * 7) % 180 - 90)::DOUBLE, CASE s_suppkey % 2 WHEN 0 THEN 'star' ELSE 'blazar' END, s_name, 'catalog', true, '' FROM supplier
UNION ALL SELECT n_name, n_nationkey::DOUBLE, -n_nationkey::DOUBLE, 'control', '', 'catalog', true, '' FROM nation""")
def legacy_sources(spark, sf):
    """Three tables in their older columns become one table of labelled sources."""
    place = lambda k: [(k * 13 % 360).cast("double").alias("ra"), (k * 7 % 180 - 90).cast("double").alias("dec")]
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    known = c.select(F.col("c_name").alias("name"), *place(F.col("c_custkey")), F.col("c_name").alias("reference"), (F.col("c_nationkey") % 3).alias("tier"), F.col("c_mktsegment").alias("transition_type"))
    others = s.select(F.col("s_name").alias("name"), *place(F.col("s_suppkey")), F.when(F.col("s_suppkey") % 2 == 0, "star").otherwise("blazar").alias("contaminant_type"), F.col("s_name").alias("reference"))
    control = n.select(F.col("n_name").alias("source_id"), F.col("n_nationkey").cast("double").alias("ra"), (-F.col("n_nationkey")).cast("double").alias("dec"))
    return legacy.from_tables(known, others, control)


@query("""WITH x AS (SELECT *, CASE WHEN c_custkey % 17 > 0 THEN c_name END AS sid, CASE WHEN c_custkey % 5 > 0 THEN 'star' END AS kind, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS cite FROM customer)
SELECT sid AS source_id, c_custkey::DOUBLE AS ra, c_acctbal AS dec, kind AS class, cite AS label_source, 'survey' AS label_method, CASE WHEN sid IS NULL THEN 'no id or position' WHEN kind IS NULL THEN 'no type' WHEN cite IS NULL THEN 'no citation' WHEN c_custkey % 11 = 0 THEN 'not independent' END AS error FROM x""")
def json_contaminants(spark, sf):
    """Rows written as JSON objects and read back with the rule that each breaks."""
    k = F.col("c_custkey")
    obj = F.to_json(F.struct(F.when(k % 17 > 0, F.col("c_name")).alias("source_id"), k.alias("ra"), F.col("c_acctbal").alias("dec"), F.when(k % 5 > 0, "star").alias("contaminant_type"), F.when(k % 7 > 0, F.col("c_mktsegment")).alias("citation"), F.lit(" survey ").alias("classification_method"), (k % 11 > 0).alias("independent_of_pipeline")))
    return legacy.contaminants_from_json(table(spark, sf, "customer").select(obj.alias("o")), "o").select("source_id", "ra", "dec", "class", "label_source", "label_method", "error")


@query("""WITH x AS (SELECT p_name AS n, CASE p_partkey % 4 WHEN 0 THEN '10.1000/x' WHEN 1 THEN '2019MNRAS.1' WHEN 2 THEN 'a bibcode' ELSE 'private' END AS ref, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Spectroscopic' ELSE 'photometric' END AS m, CASE WHEN p_partkey % 10 > 0 THEN 'type 1' END AS s1, (p_partkey % 300) / 100.0::DOUBLE AS z FROM part)
SELECT n AS source_id, z AS redshift, ref AS label_source, CASE WHEN ref = 'private' THEN 'no reference' WHEN m = 'photometric' THEN 'method is not spectroscopic' WHEN s1 IS NULL THEN 'no spectral_state_1' END AS error FROM x""", "redshift")
def json_positives(spark, sf):
    k = F.col("p_partkey")
    ref = F.when(k % 4 == 0, "10.1000/x").when(k % 4 == 1, "2019MNRAS.1").when(k % 4 == 2, "a bibcode").otherwise("private")
    method = F.when(k % 3 == 0, "").when(k % 3 == 1, "Spectroscopic").otherwise("photometric")
    obj = F.to_json(F.struct(F.col("p_name").alias("source_id"), F.lit(1.5).alias("ra"), F.lit(2.5).alias("dec"), (k % 300 / 100.0).alias("redshift"), ref.alias("doi"), method.alias("label_method"), F.when(k % 10 > 0, "type 1").alias("spectral_state_1"), F.lit("2").alias("spectral_state_2"), F.lit("2001").alias("epoch_1"), F.lit("2015").alias("epoch_2")))
    return legacy.positives_from_json(table(spark, sf, "part").select(obj.alias("o")), "o").select("source_id", "redshift", "label_source", "error")


@query("""SELECT c_custkey AS id, CASE WHEN lower(trim(t)) IN ('normal_agn', 'agn') THEN 'normal_agn' WHEN lower(trim(t)) IN ('sn_in_host', 'supernova', 'sn') THEN 'sn' WHEN lower(trim(t)) IN ('variable_star', 'star') THEN 'star' ELSE lower(trim(t)) END AS kind,
CASE WHEN trim(t) = 'positive' THEN 'clagn' ELSE trim(t) END AS class, (lower(CASE WHEN trim(t) = 'positive' THEN 'clagn' ELSE trim(t) END) IN ('clagn', 'positive'))::INTEGER AS y_true FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN ' AGN' WHEN 1 THEN 'Supernova' WHEN 2 THEN 'variable_star ' WHEN 3 THEN 'positive' WHEN 4 THEN 'CLAGN' WHEN 5 THEN 'Blazar' ELSE 'sn' END AS t FROM customer)""")
def class_names(spark, sf):
    k = F.col("c_custkey")
    t = F.when(k % 7 == 0, " AGN").when(k % 7 == 1, "Supernova").when(k % 7 == 2, "variable_star ").when(k % 7 == 3, "positive").when(k % 7 == 4, "CLAGN").when(k % 7 == 5, "Blazar").otherwise("sn")
    return legacy.with_truth(table(spark, sf, "customer").select(k.alias("id"), legacy.class_name(t).alias("kind"), t.alias("label")))
