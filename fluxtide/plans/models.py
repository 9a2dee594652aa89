"""Queries over models of light curves, features and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classifier, features, stochastic
from .lightcurves import GAP, LC, SOURCE, light_curve, season_table
from .registry import query, table


def _w1(spark, sf):
    return light_curve(spark, sf).filter("flux > 0 AND band = 'W1'")


@query()
def ou_map_fit(spark, sf):
    return stochastic.fit_walk(_w1(spark, sf)).withColumns({c: F.round(c, 6) for c in ("sigma", "tau", "nll", "residual")})


@query()
def broken_ou(spark, sf):
    return stochastic.fit_broken_walk(light_curve(spark, sf).filter("flux > 0"))


@query()
def step_gp(spark, sf):
    return stochastic.fit_step(_w1(spark, sf), least=10)


@query()
def mcmc_topk(spark, sf):
    """Sampling only for the ten sources with the largest amplitude."""
    from ..operators.sampling import top_n
    from ..operators.variability import delta_standard

    top = top_n(delta_standard(season_table(spark, sf), SOURCE).withColumn("a", F.abs("delta_mag")), "a", SOURCE, 10)
    return stochastic.sample_walk(light_curve(spark, sf).filter("flux > 0").join(F.broadcast(top.select("source_id")), "source_id"))


@query()
def ou_simulate(spark, sf):
    return stochastic.simulate_walk(light_curve(spark, sf), "source_id", 20.0, 5.0, 100.0)


@query(f"""WITH {LC}, h AS (SELECT source_id, mjd, flux, median(mjd) OVER (PARTITION BY source_id) AS start FROM lc WHERE flux > 0),
g AS (SELECT a AS amplitude, s AS shape FROM (SELECT unnest([0.2, 0.5, 1.0, 1.5]::DOUBLE[]) AS a), (SELECT unnest(['step', 'ramp', 'gaussian', 'two_step']) AS s)),
x AS (SELECT amplitude, shape, source_id, mjd < start AS pre, flux * (1 + (pow(10, amplitude / 2.5) - 1) * CASE shape WHEN 'step' THEN CASE WHEN mjd >= start THEN 1 ELSE 0 END WHEN 'ramp' THEN least(greatest((mjd - start) / 3, 0), 1) WHEN 'gaussian' THEN exp(-0.5 * power((mjd - start) / 3, 2)) ELSE CASE WHEN (mjd - start) / 3 >= 1 THEN 1 WHEN mjd >= start THEN 0.5 ELSE 0 END END) AS f FROM h, g),
r AS (SELECT amplitude, shape, source_id, count(*) FILTER (pre) >= 3 AND count(*) FILTER (NOT pre) >= 3 AND abs(2.5 * log10(median(f) FILTER (NOT pre) / median(f) FILTER (pre))) >= 0.3 AS hit FROM x GROUP BY ALL)
SELECT amplitude, shape, count(*) AS n_trials, count(*) FILTER (hit) AS n_detected, count(*) FILTER (hit) / count(*) AS completeness FROM r GROUP BY ALL""", "completeness")
def injection_grid(spark, sf):
    return stochastic.recovery_grid(light_curve(spark, sf).filter("flux > 0"), [0.2, 0.5, 1.0, 1.5], ["step", "ramp", "gaussian", "two_step"])


@query()
def injection_threshold(spark, sf):
    g = stochastic.recovery_grid(light_curve(spark, sf).filter("flux > 0"), [0.2, 0.5, 1.0, 1.5], ["step"])
    return stochastic.completeness_threshold(g, 0.6)


@query()
def far_sim(spark, sf):
    return stochastic.false_alarm(light_curve(spark, sf), "source_id", 20.0, 5.0, [0.5, 1.0, 1.5])


JACK = "(('0x' || substr(md5('42:' || r || ':' || event_id), 1, 13))::BIGINT::DOUBLE) / 4503599627370496.0 < 0.8"


@query(f"""WITH {LC}, j AS (SELECT source_id, r, median(flux) AS s FROM lc, (SELECT unnest(range(100)) AS r) WHERE {JACK} GROUP BY ALL)
SELECT source_id, count(s) AS n, avg(s) AS mean, stddev_samp(s) AS sd, quantile_cont(s, 0.16) AS p16, quantile_cont(s, 0.84) AS p84 FROM j GROUP BY source_id""", "mean sd p16 p84", 5)
def jackknife(spark, sf):
    return stochastic.jackknife(light_curve(spark, sf), "source_id", "event_id", F.median("flux"), 100)


@query()
def bootstrap_block(spark, sf):
    return stochastic.block_bootstrap(season_table(spark, sf), "source_id", replicates=100)


DAYS = f"{LC}, dd AS (SELECT source_id, floor(mjd)::DOUBLE AS mjd, avg(flux) FILTER (band = 'W1') AS a, avg(flux) FILTER (band = 'W2') AS b FROM lc GROUP BY source_id, floor(mjd)), dp AS (SELECT * FROM dd WHERE a IS NOT NULL AND b IS NOT NULL)"


def _days(spark, sf):
    lc = light_curve(spark, sf)
    d = lc.groupBy("source_id", F.floor("mjd").cast("double").alias("mjd")).agg(F.avg(F.when(F.col("band") == "W1", F.col("flux"))).alias("a"), F.avg(F.when(F.col("band") == "W2", F.col("flux"))).alias("b"))
    return d.filter("a IS NOT NULL AND b IS NOT NULL")


@query(f"""WITH {LC}, x AS (SELECT source_id, mjd, flux / (err + 1e-12) AS r, count(*) OVER (PARTITION BY source_id) AS n, row_number() OVER (PARTITION BY source_id ORDER BY mjd) AS i FROM lc),
m AS (SELECT source_id, avg(r) AS mu FROM x GROUP BY source_id)
SELECT source_id, max(n) AS n, avg(r) AS mean, stddev_pop(r) AS sd, regr_slope(r, mjd) AS trend, avg(power(r - mu, 3)) / power(avg(power(r - mu, 2)), 1.5) AS skew, max(r) - min(r) AS range, quantile_cont(r, 0.9) - quantile_cont(r, 0.1) AS p90_p10,
avg(r) FILTER (i <= floor(n / 2)) AS first_half, avg(r) FILTER (i > floor(n / 2)) AS second_half FROM x JOIN m USING (source_id) WHERE n >= 10 GROUP BY source_id""", "mean sd trend skew range p90_p10 first_half second_half", 4)
def flux_ratio_stats(spark, sf):
    return features.flux_ratio_stats(light_curve(spark, sf), SOURCE, "flux", "err")


@query(f"""WITH {DAYS}, s AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY mjd RANGE UNBOUNDED PRECEDING) AS season FROM (SELECT *, a - b AS c, CASE WHEN mjd - lag(mjd) OVER (PARTITION BY source_id ORDER BY mjd) > 3 THEN 1 ELSE 0 END AS fresh FROM dp)),
k AS (SELECT *, max(season) OVER (PARTITION BY source_id) AS last FROM s), e AS (SELECT *, season < least(3, floor((last + 1) / 2)) AS early, season > last - least(3, floor((last + 1) / 2)) AS late FROM k),
g AS (SELECT source_id, count(*) FILTER (early) AS n_early, count(*) FILTER (late) AS n_late, regr_slope(c, mjd) FILTER (early) * 365.25 AS slope_early, regr_slope(c, mjd) FILTER (late) * 365.25 AS slope_late, max(c) - min(c) AS range FROM e GROUP BY source_id)
SELECT *, CASE WHEN abs(slope_late) < 1e-6 THEN 10 * sign(slope_early) ELSE least(greatest(slope_early / slope_late, -10), 10) END AS slope_ratio FROM g WHERE n_early >= 3 AND n_late >= 3""", "slope_early slope_late range slope_ratio", 3)
def color_slopes(spark, sf):
    return features.colour_slopes(_days(spark, sf).withColumn("c", F.col("a") - F.col("b")), SOURCE, "c", 3.0, least=3)


@query("SELECT c_custkey AS id, CASE WHEN z > 0 AND z <= 5 THEN ln(1 + z) END AS log1z, CASE WHEN z > 0 AND z <= 5 THEN c_acctbal / (1 + z) END AS size_rest, CASE WHEN z > 0 AND z <= 5 THEN c_acctbal / sqrt(1 + z) END AS sigma_rest FROM (SELECT *, ((c_custkey * 31) % 500)::DOUBLE / 100 AS z FROM customer)", "log1z size_rest sigma_rest", 5)
def redshift_scalings(spark, sf):
    b = F.col("c_acctbal")
    s = features.redshift_scalings(F.col("z"), b, b, b, b)
    c = table(spark, sf, "customer").withColumn("z", F.pmod(F.col("c_custkey") * 31, F.lit(500)) / 100.0)
    return c.select(F.col("c_custkey").alias("id"), *[s[k].alias(k) for k in ("log1z", "size_rest", "sigma_rest")])


@query()
def season_coherence(spark, sf):
    return features.season_coherence(light_curve(spark, sf), "source_id", GAP)


@query()
def wavelet_bands(spark, sf):
    return features.wavelet_bands(light_curve(spark, sf), "source_id")


@query()
def pelt_breaks(spark, sf):
    return features.structural_breaks(light_curve(spark, sf), "source_id")


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    names = [f"f{i}" for i in range(64)]
    return e.select("vec_id", (F.col("label") < 3).cast("double").alias("y"), *[F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate(names)]), names


@query()
def isolation_gate(spark, sf):
    v, names = _vectors(spark, sf)
    return classifier.isolation_scores(v, "vec_id", names)


@query()
def boosted_trees(spark, sf):
    v, names = _vectors(spark, sf)
    model = classifier.fit_trees(v.filter("vec_id % 5 <> 0"), names, "y", rounds=5)
    return classifier.predict(model, v.filter("vec_id % 5 = 0")).select("vec_id", "y", "p")


@query()
def null_calibration(spark, sf):
    return stochastic.null_threshold(light_curve(spark, sf), "source_id", 20.0, 5.0)


@query("""WITH p AS (SELECT vec_id, unnest(range(64))::DOUBLE AS w, unnest(embedding)::DOUBLE AS f FROM embeddings),
c AS (SELECT vec_id, regr_slope(f, w) FILTER (w BETWEEN 5 AND 14 OR w BETWEEN 40 AND 49) AS m, regr_intercept(f, w) FILTER (w BETWEEN 5 AND 14 OR w BETWEEN 40 AND 49) AS k FROM p GROUP BY vec_id),
d AS (SELECT p.vec_id, w, f - (k + m * w) AS a FROM p JOIN c USING (vec_id) WHERE w BETWEEN 20 AND 30), s AS (SELECT vec_id, (a + lead(a) OVER (PARTITION BY vec_id ORDER BY w)) / 2 AS x FROM d)
SELECT vec_id, 20::BIGINT AS n_continuum, 11::BIGINT AS n_line, sum(x) AS flux FROM s GROUP BY vec_id""", "flux", 5)
def line_flux(spark, sf):
    """Vectors read as spectra over wavelengths 0 to 63."""
    from ..operators.spectra import line_flux as measure

    e = table(spark, sf, "embeddings").withColumn("wave", F.sequence(F.lit(0), F.size("embedding") - 1))
    return measure(e, "vec_id", "wave", "embedding", [(5, 14), (40, 49)], (20, 30)).drop("width")
