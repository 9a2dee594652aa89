"""Operators that SQL does not express, and rules on single values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxtide.functions import ids, photometry, sky
from fluxtide.functions.params import P
from fluxtide.operators import classifier, dedup, features, quality, sampling, spatial, stochastic
from fluxtide.sources import catalogue, readers, sinks
from fluxtide.streaming import sessions


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_photometry(spark):
    m = F.lit(13.0)
    r = one(spark, a=photometry.mag_to_flux(m), e=photometry.mag_error_to_flux_error(m, F.lit(0.02)), b=photometry.mag_to_flux(m, "W2"), back=photometry.flux_to_mag(photometry.mag_to_flux(F.lit(14.5))), out=photometry.mag_to_flux(F.lit(31.0)), none=photometry.flux_to_mag(F.lit(0.0)))
    assert 1.90 < r["a"] < 2.00 and 0.034 < r["e"] < 0.040 and 1.05 < r["b"] < 1.12
    assert abs(r["back"] - 14.5) < 1e-6 and r["out"] is None and r["none"] is None


def test_identifiers(spark):
    r = one(spark, a=ids.canonical(F.lit("SDSSJJ0001+01")), b=ids.canonical(F.lit(" ngc  1068")), c=ids.canonical(F.lit("123")), d=ids.is_ambiguous(F.lit("PKS")), e=ids.rejection_bucket(F.lit("NO_DATA"), F.lit("missing allwise coverage")), f=ids.rejection_bucket(F.lit("TOO_FEW_POINTS"), F.lit("Baseline 3.1 yr < 7 yr")), g=ids.number(F.lit(" NaN ")), h=ids.number(F.lit("1e3")))
    assert tuple(r) == ("SDSSJ0001+01", "NGC 1068", "123", True, "missing_allwise", "short_baseline", None, 1000.0)


def test_scores_table(spark):
    rows = [("a", "a", "0.5", "ok", "50", str(7.0 * 365.25), "W1,W2"), ("b", "b", "", " ", "49.6", "100", ""), ("c", "c", "x", "NO_DATA", None, None, "W1_only")]
    d = readers.derived(readers.coerce_results(spark.createDataFrame(rows, list(readers.RESULT_COLUMNS)))).orderBy("source_id").collect()
    assert [r["strict_quality"] for r in d] == [True, False, False]
    assert [r["status"] for r in d] == ["OK", "UNKNOWN", "NO_DATA"] and [r["score"] for r in d] == [0.5, None, None]
    assert d[1]["n_points"] == 50 and d[1]["band_coverage"] == "none" and (d[2]["has_w1"], d[2]["has_w2"]) == (True, False)
    with pytest.raises(ValueError):
        readers.coerce_results(spark.range(1))


def separation(a, b):
    r1, d1, r2, d2 = map(math.radians, (*a, *b))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h))))


@pytest.mark.parametrize("radius", [0.5, 3.0, 11.0])
def test_positions_against_all_pairs(spark, radius):
    rng = random.Random(4)
    pts = [(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(150)]
    pts += [(rng.uniform(0, 360), rng.choice([-1, 1]) * rng.uniform(85, 90)) for _ in range(60)] + [(0.01, 10.0), (359.99, 10.0), (0.0, 90.0), (180.0, 90.0), (10.0, -90.0)]
    rows = [(i, *p) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows + [(999, None, None)], "id int, ra double, dec double")
    want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if separation(pts[i], pts[j]) <= radius}
    got = [(r["a"], r["b"]) for r in spatial.pairs_within(df, radius, "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    near = {j for _, j in want}
    assert {r["id"] for r in dedup.drop_later_neighbours(df, radius, "id").collect()} == set(range(len(pts))) - near | {999}
    kept = []
    for i in range(len(pts)):
        if all((k, i) not in want for k in kept):
            kept.append(i)
    assert sorted(r["id"] for r in dedup.greedy_keep_first(df, radius, "id").collect()) == [*kept, 999]


@pytest.mark.parametrize("radius", [0.5, 4.0, 20.0])
def test_linked_positions_against_all_pairs(spark, radius):
    """Components without their pairs: thin and dense parts, poles, the seam at 360 degrees; and
    no more edges are kept than patches have neighbours."""
    rng = random.Random(int(radius * 10))
    dense = [((rng.gauss(359.9, 2.0)) % 360, rng.gauss(dec, 2.0)) for dec in (-40.0, -30.0) for _ in range(60)]
    thin = [(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(120)]
    poles = [(rng.uniform(0, 360), s * rng.uniform(88, 90)) for s in (-1, 1) for _ in range(20)]
    rows = [(k, *p) for k, p in enumerate(dense + thin + poles)]
    rng.shuffle(rows)
    root = {k: k for k, _, _ in rows}

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a, ra, da in rows:
        for b, rb, db in rows:
            h = math.sin(math.radians(db - da) / 2) ** 2 + math.cos(math.radians(da)) * math.cos(math.radians(db)) * math.sin(math.radians(rb - ra) / 2) ** 2
            if a < b and math.degrees(2 * math.asin(min(1.0, math.sqrt(h)))) <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    found = dedup.linked(spark.createDataFrame(rows, "id long, ra double, dec double"), radius, "id")
    assert {r["id"]: r["root"] for r in found.collect()} == {k: top(k) for k in root}


def test_healpix(spark):
    n = 20000
    r = np.random.default_rng(0)
    pts = [(float(a), float(d)) for a, d in zip(r.uniform(0, 360, n), np.degrees(np.arcsin(r.uniform(-1, 1, n))))]
    df = spark.createDataFrame(pts, "ra double, dec double").withColumn("c", spatial.healpix_ring(F.col("ra"), F.col("dec"), 4))
    counts = {x["c"]: x["count"] for x in df.groupBy("c").count().collect()}
    assert set(counts) == set(range(192)) and max(counts.values()) < 2 * n / 192  # equal areas
    rings = df.groupBy("c").agg(F.min("dec").alias("lo"), F.max("dec").alias("hi")).orderBy("c").collect()
    assert rings[0]["hi"] > rings[100]["hi"] > rings[191]["hi"]  # from north to south


def test_walk_is_recovered(spark):
    t = spark.range(40).select((F.col("id") % 4).alias("source_id"), (55000 + F.floor(F.col("id") / 4) * 500).cast("double").alias("mjd"))
    grid = spark.range(400).select((F.col("id") % 4).alias("source_id"), (55000 + F.floor(F.col("id") / 4) * 50).cast("double").alias("mjd"))
    sim = stochastic.simulate_walk(grid, "source_id", 0.5, 300.0, seed=3).withColumn("err", F.lit(0.05))
    fit = stochastic.fit_walk(sim).toPandas()
    assert len(fit) == 4 and 0.5 < np.median(fit.tau) / 300 < 2 and 0.5 < np.median(fit.sigma) / 0.5 < 2
    again = stochastic.simulate_walk(grid.repartition(3), "source_id", 0.5, 300.0, seed=3).orderBy("source_id", "mjd").toPandas()
    assert again.flux.equals(sim.orderBy("source_id", "mjd").toPandas().flux)
    assert t.count() == 40


def test_kalman_equals_full_covariance():
    r = np.random.default_rng(1)
    t, e = np.sort(r.uniform(0, 100, 25)), np.full(25, 0.2)
    y = r.standard_normal(25)
    c = 0.7**2 * np.exp(-abs(t[:, None] - t[None]) / 12.0) + np.diag(e**2)
    full = 0.5 * (y @ np.linalg.solve(c, y) + np.linalg.slogdet(c)[1] + 25 * math.log(2 * math.pi))
    assert math.isclose(stochastic.ou_likelihood(np.array([0.7]), np.array([12.0]), t, y, e)[0], full, rel_tol=1e-6)


def test_walks_of_many_sources_equal_each_alone():
    """Stacked curves of unlike length take the steps that each takes by itself."""
    rng = np.random.default_rng(3)
    curves = [(np.sort(rng.uniform(0, 400, n)), rng.normal(20, 3, n), rng.uniform(0.1, 1, n)) for n in (12, 3, 31, 1, 12, 20)]
    found = stochastic.fit_ous(curves, 4)
    assert [tuple(float(x[i]) for x in found) for i in range(6)] == [stochastic.fit_ou(*c) for c in curves]
    sigma, tau = np.exp(np.array([-1.0, 0.5, 2.0])), np.exp(np.array([2.0, 4.0, 7.0]))
    for which, t, y, e, alive in stochastic.stacked(curves, 4):
        least = stochastic.least_running_costs(t, y, e, alive, sigma, tau)
        for k, w in enumerate(which):
            assert np.array_equal(least[: len(curves[w][0]), k], stochastic.running_costs(*curves[w], sigma, tau).min(1))


def test_pelt_is_exact():
    r = np.random.default_rng(2)
    y = np.concatenate((r.normal(0, 0.3, 12), r.normal(3, 0.3, 10), r.normal(1, 0.3, 9)))
    best = [-5.0] + [math.inf] * len(y)
    last = [0] * (len(y) + 1)
    for j in range(1, len(y) + 1):
        for i in range(0, j - 2):
            v = best[i] + ((y[i:j] - y[i:j].mean()) ** 2).sum() + 5.0
            if v < best[j]:
                best[j], last[j] = v, i
    cuts, at = [], len(y)
    while last[at]:
        at = last[at]
        cuts.append(at)
    assert features.pelt(y, 5.0) == cuts[::-1] == [12, 22]


def test_wavelet_filter():
    assert math.isclose(features.DB4.sum(), math.sqrt(2), rel_tol=1e-9) and math.isclose((features.DB4**2).sum(), 1.0, rel_tol=1e-9)


def test_isolation(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.standard_normal((300, 2)))] + [(999, 9.0, -9.0), (1000, None, None)]
    s = classifier.isolation_scores(spark.createDataFrame(rows, "k long, a double, b double"), "k", ["a", "b"]).toPandas().set_index("k").anomaly
    assert s.idxmax() == 999 and len(s) == 302


def test_cascade_and_flags(spark):
    df = spark.createDataFrame([(1, None, "0000"), (2, 5.0, "0100"), (3, 5.0, None), (4, -1.0, "0000")], "id int, mag double, cc string")
    steps = [("mag", F.col("mag").isNull()), ("range", F.col("mag") < 0), ("cc", quality.flag_bad(F.col("cc"), "W2"))]
    kept, gone = quality.cascade(df, steps)
    assert [r["id"] for r in kept.collect()] == [3] and {r["id"]: r["reject_step"] for r in gone.collect()} == {1: "mag", 2: "cc", 4: "range"}


def test_thin_keeps_at_most(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("s"), F.col("id").cast("double").alias("mjd"), F.col("id").alias("k"))
    n = sampling.thin(df, ["s"], 40, "k").groupBy("s").count().collect()
    assert {r["count"] for r in n} == {40} and sampling.thin(df, ["s"], 400, "k").count() == 1000


def test_largest_remainder(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double")
    assert [r["allocated"] for r in sampling.largest_remainder(w, "k", "w", 10).orderBy("k").collect()] == [4, 3, 3]
    zero = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "k string, w double")
    assert [r["allocated"] for r in sampling.largest_remainder(zero, "k", "w", 5).orderBy("k").collect()] == [3, 2]


def test_visits_with_faint_exposures(spark):
    """An exposure of flux 0 weighs by its error where faint ones count, and else not at all."""
    from fluxtide.operators import seasons

    rows = [(1, 10.0, 0.0, 0.01), (1, 10.1, 50.0, 2.0), (1, 20.0, 0.0, 0.01), (1, 30.0, -0.2, 0.0)]
    df = spark.createDataFrame(rows, "k long, mjd double, flux double, err double")
    got = {r["visit"]: r for r in seasons.visits(df, ["k"], 0.5, faint=True).collect()}
    w = 1 / 0.01**2, 1 / 2.0**2
    assert (got[0]["n_exp"], got[0]["sd"]) == (2, 25.0) and got[0]["flux"] == pytest.approx(50.0 * w[1] / sum(w)) and got[0]["err"] == pytest.approx(sum(w) ** -0.5)
    assert (got[1]["n_exp"], got[1]["flux"], got[1]["err"]) == (1, 0.0, 0.01) and got[2]["err"] == 0.0 and np.isnan(got[2]["flux"])
    got = {r["visit"]: r for r in seasons.visits(df, ["k"], 0.5).collect()}
    assert (got[0]["n_exp"], got[0]["flux"], got[1]["n_exp"], got[1]["flux"]) == (1, 50.0, 0, None)


@pytest.mark.parametrize("name", ["cell_partition_join", "known_recovery"])
def test_positional_joins_broadcast_no_cells(spark, name):
    """Nine cells a row are many more bytes than the planner takes them for."""
    from fluxtide.plans import registry

    registry.load()
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_common_tokens_meet_once(spark):
    """A token of many catalogue rows gives each left row its smallest one, not all of them."""
    from fluxtide.operators import resolve

    left = spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "hot").otherwise("none").alias("a"), F.lit("HOT ").alias("b"))
    tokens = spark.range(7, 407).select(F.col("id").alias("idx"), F.lit("HOT").alias("token"), F.lit("name").alias("field"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = resolve.token_match(left, "k", ["a", "b"], tokens, "idx")
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(rows) == 300 and {(r["idx"], r["token"], r["field"]) for r in rows} == {(7, "HOT", "name")}

    def joined(node) -> int:
        at = node.children()
        own = node.metrics().get("numOutputRows").get().value() if "Join" in node.nodeName() else 0
        return max([own, *(joined(at.apply(i)) for i in range(at.size()))])

    assert joined(found._jdf.queryExecution().executedPlan()) <= 600


def test_aliases_and_validity(spark):
    c = spark.createDataFrame([("n1", "10", "5", "0.5"), ("n2", "400", "5", "0.5"), ("n3", "10", "5", "0.001"), ("n4", "10", "5", "NaN")], "Name string, RAJ2000 string, DEJ2000 string, z string")
    assert [r["source_id"] for r in catalogue.validate(catalogue.rename_aliases(c)).collect()] == ["n1"]


def test_digest_ignores_order(spark):
    d = spark.range(100).withColumn("x", F.col("id") * 2)
    assert sinks.table_hash(d).first() == sinks.table_hash(d.orderBy(F.col("id").desc()).repartition(7)).first()
    assert sinks.table_hash(d).first() != sinks.table_hash(d.filter("id < 99")).first()


def test_sexagesimal(spark):
    r = one(spark, a=sky.sexagesimal(F.lit("01:30:00"), True), b=sky.sexagesimal(F.lit("-00 30 00")), c=sky.sexagesimal(F.lit("12.5")))
    assert tuple(r) == (22.5, -0.5, 12.5)


def test_constants():
    assert sum(P.weights_v1.values()) == 14 and sum(P.weights_v2.values()) == 21 and sum(P.weights_v3.values()) == 10


def test_stream_sessions(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:05:00", 3.0), ("a", "2024-01-01 02:00:00", 5.0), ("b", "2024-01-01 00:00:00", 7.0), ("z", "2024-01-03 00:00:00", 0.0)]
    spark.createDataFrame(rows, "k string, t string, v double").select("k", F.to_timestamp("t").alias("t"), "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp, v double").parquet(str(tmp_path / "in"))
    q = sessions.session_stats(stream, "k", "t", "v", "30 minutes", "10 minutes").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r["k"], r["n"], r["mean"]) for r in spark.table("closed").collect()}
    assert got == {("a", 2, 2.0), ("a", 1, 5.0), ("b", 1, 7.0)}
