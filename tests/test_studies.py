"""Kernel models, posteriors, lags, score uncertainty, threshold search, campaigns and the
cascade: against brute force, recovery of known parameters, and round trips."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxtide.operators import campaign, cascade, features, kernels, lags, posterior, resampling, stochastic, tuning
from fluxtide.plans import studies

SF = "/root/testdata/sf0.001"
CURVE = "source_id long, mjd double, flux double, err double"


def curve_frame(spark, curves):
    rows = [(k, float(a), float(b), float(c)) for k, (t, y, e) in curves.items() for a, b, c in zip(t, y, e)]
    return spark.createDataFrame(rows, CURVE)


def simulated(rng, t, sigma, tau):
    x = [rng.normal() * sigma]
    for dt in np.diff(t):
        f = math.exp(-dt / tau)
        x.append(x[-1] * f + sigma * math.sqrt(1 - f * f) * rng.normal())
    return np.array(x)


# --- the walk with a step ----------------------------------------------------------------


def dense(y, k):
    return 0.5 * (y @ np.linalg.solve(k, y) + np.linalg.slogdet(k)[1] + len(y) * math.log(2 * math.pi))


def test_step_profile_equals_the_dense_covariance():
    rng = np.random.default_rng(1)
    t = np.sort(np.append(rng.uniform(0, 300, 38), [50.0, 50.0]))
    y, e = rng.normal(size=40) + 2 * (t > 150), rng.uniform(0.1, 0.3, 40)
    sigma, tau = np.array([0.5, 1.3, 0.01]), np.array([20.0, 100.0, 3000.0])
    plain, stepped, delta = kernels.step_profile(sigma, tau, t, y, e)
    for p in range(3):
        noise = np.diag(e**2 + max(kernels.JITTER, kernels.JITTER_SHARE * sigma[p] ** 2))
        of = lambda d, start: dense(y, kernels.step_kernel(t, t, sigma[p], tau[p], d, start) + noise)  # noqa: E731, B023
        assert of(0.0, 1e9) == pytest.approx(plain[p], abs=1e-7)
        for m in range(1, 40):
            if t[m] == t[m - 1]:
                continue
            best = of(delta[m, p], t[m])
            assert best == pytest.approx(stepped[m, p], abs=1e-7)
            for f in (0.7, 1.4):
                assert of(min(max(delta[m, p] * f, math.exp(-5)), math.exp(5)), t[m]) >= best - 1e-9


def test_stepped_walk_recovers_its_break(spark):
    rng = np.random.default_rng(4)
    curves = {}
    for k in range(4):
        t = np.sort(rng.uniform(0, 1000, 120))
        curves[k] = t, simulated(rng, t, 0.3, 20.0) + (3.0 * (t >= 600) if k % 2 else 0.0), np.full(120, 0.1)
    found = {r["source_id"]: r for r in kernels.fit_stepped_walk(curve_frame(spark, curves)).collect()}
    for k, (t, _, _) in curves.items():
        if k % 2:
            assert abs(found[k]["break_mjd"] - t[np.searchsorted(t, 600)]) < 30 and found[k]["log_bayes"] > 5
            # The curve is centred on all its epochs, so the walk also bears the offset before the step.
            assert 1.0 < found[k]["delta"] < 9.0 and 0.1 < found[k]["sigma"] < 1.5
        else:
            assert found[k]["log_bayes"] < 2
        assert found[k]["nll_step"] <= found[k]["nll"] + 0.5 and found[k]["n_tried"] > 100
    few = {9: (np.arange(5.0), np.ones(5), np.ones(5))}
    assert kernels.fit_stepped_walk(curve_frame(spark, few)).collect() == []


def test_broken_walk_costs_and_break(spark):
    """Running costs equal fits of each prefix, and a search that fits at every epoch finds no
    better break."""
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 500, 40))
    y, e = simulated(rng, t, 1.0, 30.0), np.full(40, 0.2)
    y[25:] += 6
    sigma, tau = np.array([0.4, 1.0]), np.array([10.0, 60.0])
    run = stochastic.running_costs(t, y, e, sigma, tau)
    for m in (5, 20, 40):
        assert run[m - 1] == pytest.approx(stochastic.ou_likelihood(sigma, tau, t[:m], stochastic._centred(y[:m], e[:m]), e[:m]), abs=1e-6)
    every = {i: stochastic.fit_ou(t[:i], y[:i], e[:i])[2] + stochastic.fit_ou(t[i:], y[i:], e[i:])[2] for i in range(6, 34)}
    best = min(every, key=every.get)
    found = stochastic.fit_broken_walk(curve_frame(spark, {1: (t, y, e)})).first()
    assert found["break_mjd"] == pytest.approx(t[best]) and found["n_tried"] == len(every)


# --- breaks of the distribution ----------------------------------------------------------


def exhaustive(y, penalty, least, gamma):
    n = len(y)
    gram = np.exp(-np.clip(gamma * (y[:, None] - y[None]) ** 2, 1e-2, 1e2))
    np.fill_diagonal(gram, 1.0)
    best, last = [math.inf] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for end in range(least, n + 1):
        for start in range(end - least + 1):
            v = best[start] + (end - start) - gram[start:end, start:end].sum() / (end - start) + penalty
            if v < best[end] - 1e-12:
                best[end], last[end] = v, start
    cuts, at = [], n
    while last[at] > 0:
        at = last[at]
        cuts.append(at)
    return cuts[::-1]


def test_kernel_breaks_equal_exhaustive_search():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(8, 60))
        y = np.concatenate([rng.normal(rng.normal() * 2, rng.uniform(0.2, 1), n // 2), rng.normal(rng.normal() * 2, 0.5, n - n // 2)])
        penalty = float(rng.uniform(0.05, 3))
        assert kernels.kernel_pelt(y, penalty) == exhaustive(y, penalty, 4, 1 / kernels.median_square_distance(y))


def test_mean_breaks_equal_exhaustive_search():
    rng = np.random.default_rng(13)
    for _ in range(60):
        n = int(rng.integers(8, 50))
        y, penalty = rng.normal(size=n) + np.repeat(rng.normal(size=n // 5 + 1) * 2, 5)[:n], float(rng.uniform(0.05, 4))
        best, last = [math.inf] * (n + 1), [0] * (n + 1)
        best[0] = -penalty
        for end in range(3, n + 1):
            for start in range(end - 2):
                v = best[start] + ((y[start:end] - y[start:end].mean()) ** 2).sum() + penalty
                if v < best[end] - 1e-12:
                    best[end], last[end] = v, start
        cuts, at = [], n
        while last[at] > 0:
            at = last[at]
            cuts.append(at)
        assert features.pelt(y, penalty) == cuts[::-1]


def test_median_square_distance_of_all_pairs():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 10, 11, 60):
        for x in (rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.zeros(n), rng.normal(size=n) * 1e-9 + 1e6):
            pairs = [(a - b) ** 2 for a, b in itertools.combinations(x, 2)]
            assert kernels.median_square_distance(x) == pytest.approx(np.median(pairs) if pairs else 0.0, rel=1e-12)


def test_distribution_breaks_of_a_known_step(spark):
    t = np.arange(0.0, 400.0, 10.0)
    y = np.where(t < 200, 1.0, 4.0) + 0.01 * np.sin(t)
    out = {r["source_id"]: r for r in kernels.distribution_breaks(curve_frame(spark, {1: (t, y, t * 0 + 1), 2: (t[:9], y[:9], t[:9] * 0 + 1), 3: (t, np.ones(40), t * 0 + 1)})).collect()}
    assert set(out) == {1, 3}
    assert out[1]["break_mjd"] == 200.0 and out[1]["n_breaks"] >= 1 and out[1]["magnitude"] == pytest.approx(2.5 * math.log10(4), abs=0.02) and out[1]["place"] == 0.5
    assert out[3]["n_breaks"] >= 0


# --- posterior and lag -------------------------------------------------------------------


def test_posterior_recovers_and_converges(spark):
    rng = np.random.default_rng(6)
    t = np.sort(rng.uniform(0, 8000, 60))
    curves = {1: (t, 50 + simulated(rng, t, 2.0, 250.0), np.full(60, 0.1))}
    r = posterior.walk_posterior(curve_frame(spark, curves), walkers=16, burn=150, most=900, block=150).first()
    assert r["tau16"] < 250 * 1.6 and r["tau84"] > 250 / 1.6 and 1.2 < r["sigma50"] < 3.5
    assert r["converged"] and r["rhat_tau"] < posterior.RHAT and 0.2 < r["accepted"] < 0.95 and r["steps"] <= 750
    assert r["excess"] == pytest.approx(r["sigma50"] / r["mean_flux"] ** -0.5)


def test_prior_alone_is_sampled():
    rng = np.random.default_rng(0)
    cost = lambda p: 0.5 * (((p - [5.7, 1.0]) / [1.0, 0.5]) ** 2).sum(1)
    chain, accepted = posterior.stretch_chain(cost, rng.normal([5.7, 1.0], 0.1, (40, 2)), rng, 300, 3000, 500, 1.02)
    flat = chain.reshape(-1, 2)
    assert flat.mean(0) == pytest.approx([5.7, 1.0], abs=0.08) and flat.std(0) == pytest.approx([1.0, 0.5], abs=0.08)
    same = np.repeat(rng.normal(size=(200, 1, 2)), 4, 1)
    assert (posterior.potential_scale(same) < 1.0).all() and (posterior.potential_scale(np.concatenate([same, same + 9], 1)) > 2).all()


def test_lag_and_correlation(spark):
    t = np.arange(0.0, 600.0, 5.0)
    x = np.exp(-0.5 * ((t - 200) / 30) ** 2)
    y = np.exp(-0.5 * ((t - 260) / 30) ** 2)
    d = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(t, x, y)] + [(2, float(a), 1.0, float(a)) for a in t] + [(3, 0.0, 1.0, 2.0)], "k long, mjd double, f double, c double")
    out = {r["k"]: r for r in lags.colour_lag(d, "k", "f", "c").collect()}
    assert set(out) == {1, 2} and out[1]["lag"] == pytest.approx(60, abs=4) and out[1]["peak"] > 0.9
    assert out[2]["r"] is None and out[2]["lag"] is None and out[2]["range"] == 595.0
    even = np.linspace(t[0], t[-1], 200)
    a, b = np.interp(even, t, x), np.interp(even, t, y)
    a, b = a - a.mean(), b - b.mean()
    brute = max(range(-199, 200), key=lambda s: sum(b[i] * a[i - s] for i in range(200) if 0 <= i - s < 200))
    assert lags.peak_lag(t, x, y)[0] == pytest.approx(brute * (t[-1] - t[0]) / 200)
    # Two-sided p-values of Student's t: 8, 3 and 98 degrees of freedom.
    for (r, n), p in {(0.5, 10): 0.14111328125, (0.9, 5): 0.03738607346849864, (-0.3, 100): 0.002425733462583, (0.0, 20): 1.0}.items():
        assert lags.correlation_p(r, n) == pytest.approx(p, rel=1e-9)


# --- score uncertainty, search -----------------------------------------------------------


def test_replicates_draw_whole_seasons(spark):
    s = spark.createDataFrame([(k, i, float(i), 1.0 + i, 0.1, 5) for k in (1, 2) for i in range(6)] + [(3, 0, 0.0, 1.0, 0.1, 50)], "source_id long, season int, t double, med double, mad double, n long")
    r = resampling.season_replicates(s, "source_id", 40).toPandas()
    assert set(r["source_id"]) == {1, 2} and (r.groupby(["source_id", "replicate"])["n"].sum() == 30).all()
    assert 0.5 < r.groupby(["source_id", "replicate"]).size().mean() / 6 < 0.8
    one = r[r["n"] == 10].iloc[0]
    assert one["stat_err"] == pytest.approx(1.4826 * 0.1 / math.sqrt(10))
    b = resampling.season_break(s.filter("source_id = 1").withColumn("med", F.when(F.col("season") >= 4, 9.0).otherwise(1.0)).withColumn("err", F.lit(0.1)), ["source_id"]).first()
    assert b["break_mjd"] == 4.0 and b["delta_bic"] == pytest.approx(100 * (4 * 2 / 6 * 64) - 2 * math.log(6))
    flat = resampling.score_uncertainty(s.withColumn("med", F.lit(2.0)), "source_id").collect()
    assert all(x["score_err"] == 0 and x["score_hi"] == 0 for x in flat)


def test_search_equals_direct_evaluation(spark):
    rng = np.random.default_rng(8)
    grid = {"ratio": (1.5, 2.5), "peak": (0.5, 0.7), "near": (0.3, 0.5), "points": (10, 14), "seasons": (4, 6)}
    n = 400
    pdf = pd.DataFrame({"id": range(n), "y": rng.random(n) < 0.4, "kind": rng.choice(["Blazar", "star", "x"], n), "base": rng.random(n) < 0.9, "r": rng.uniform(1, 4, n), "pk": rng.uniform(0, 1, n), "nr": rng.uniform(0, 1, n), "pt": rng.integers(5, 20, n).astype(float), "se": rng.integers(2, 9, n).astype(float), "bs": rng.integers(2, 9, n).astype(float)})
    for c in ("r", "pk", "nr", "pt", "se", "bs"):
        pdf.loc[rng.random(n) < 0.1, c] = np.nan
    df = spark.createDataFrame(pdf).select("id", "y", "kind", "base", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("r", "pk", "nr", "pt", "se", "bs")])
    found = tuning.patterns(df, "id", "y", "kind", F.col("base"), {"ratio": "r", "points": "pt", "seasons": "se", "nonpeak": "pk", "adjacency": "nr", "band_seasons": "bs"}, grid)
    out = tuning.search(found, grid, 0.3, veto_target=0.5, caps={"star": 0.5}, weights={"star": 1.0}).toPandas()
    fold = {r["id"]: r["f"] for r in df.select("id", F.floor(resampling.uniform(42, F.col("id")) * 5).alias("f")).collect()}
    assert len(out) == 32 and sorted(out["place"]) == list(range(1, 33))
    pdf["fold"] = pdf["id"].map(fold)
    acc = lambda d: 0.5 * ((d["p"] & d["y"]).sum() / max(d["y"].sum(), 1) + (~d["p"] & ~d["y"]).sum() / max((~d["y"]).sum(), 1))
    for row in out.itertuples():
        spike = (pdf["pk"] < row.peak) & (pdf["nr"] < row.near) & (pdf["bs"].fillna(0) >= row.seasons)
        pdf["p"] = pdf["base"] & (pdf["pt"].fillna(-1) >= row.points) & (pdf["se"].fillna(-1) >= row.seasons) & (pdf["r"] >= row.ratio) & ~spike
        assert row.tp == (pdf["p"] & pdf["y"]).sum() and row.fp == (pdf["p"] & ~pdf["y"]).sum()
        assert row.cv_balanced_accuracy == pytest.approx(np.mean([acc(d) for _, d in pdf.groupby("fold")]))
        stars = pdf[(pdf["kind"] == "star") & ~pdf["y"]]
        assert row.fpr_star == pytest.approx(stars["p"].mean()) and row.weighted_fp == pytest.approx(stars["p"].mean())
    first = out.sort_values("place").iloc[0]
    ok = out[out["meets_recall"] & out["meets_veto"] & out["meets_caps"]]
    assert first["cv_balanced_accuracy"] == pytest.approx((ok if len(ok) else out)["cv_balanced_accuracy"].max())


# --- campaigns ---------------------------------------------------------------------------


def test_cadence_and_walk(spark):
    hosts = spark.range(400).select(F.col("id").alias("k"))
    full = campaign.cadence(hosts, "k", 0).toPandas()
    per = full.groupby(["k", "visit"])["mjd"].agg(["min", "max", "size"])
    assert per["size"].between(8, 15).all() and (per["max"] - per["min"]).max() <= 2.0
    gaps = per["min"].groupby("k").diff().dropna()
    assert gaps.between(172, 188).all() and full["mjd"].max() < campaign.START + campaign.BASELINE + 2
    assert (campaign.cadence(hosts, "k").groupBy("k").count().toPandas()["count"] == 10).all()
    grid = hosts.select("k", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).withColumn("mjd", F.col("i") * 100.0)
    w = campaign.walk(grid, ["k"], campaign.normal(1, F.col("k"), F.col("i")), F.lit(2.0), 300.0).toPandas().pivot(index="k", columns="i", values="walk")
    assert w.std().mean() == pytest.approx(2.0, abs=0.15) and w.mean().abs().max() < 0.45
    assert np.mean([np.corrcoef(w[i], w[i + 1])[0, 1] for i in range(19)]) == pytest.approx(math.exp(-1 / 3), abs=0.05)


def test_quick_scores_and_recovery(spark):
    t = np.arange(10.0) * 180
    flat, step = np.full(10, 5.0), np.where(np.arange(10) < 5, 5.0, 15.0)
    d = spark.createDataFrame([(k, float(a), float(b)) for k, y in ((1, flat), (2, step), (3, -flat)) for a, b in zip(t, y)] + [(4, 0.0, 1.0)], "k long, mjd double, flux double")
    out = {r["k"]: r for r in campaign.quick_scores(d, ["k"]).collect()}
    assert out[1]["score"] == 0 and out[3]["score"] == 0 and out[4]["score"] == 0
    assert out[2]["score"] == pytest.approx(1.0) and out[2]["measured"] == pytest.approx(2.5 * math.log10(3))
    hosts = spark.range(40).select(F.col("id").alias("k"), F.lit(3.0).alias("level"))
    table = campaign.completeness(campaign.trials(hosts, "k", "level", repeats=1)).toPandas()
    assert len(table) == 28 and (table["n_trials"] == 40).all()
    step = table[table["shape"] == "step"].sort_values("amplitude")["completeness"].tolist()
    assert step[0] < 0.9 and step[-1] > 0.95


def test_drawn_epochs_leave_both_sides(spark):
    rng = np.random.default_rng(9)
    rows = [(k, float(x), float(rng.normal())) for k in range(5) for x in np.sort(rng.uniform(0, 30, 25))] + [(9, 0.0, 1.0), (9, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "k long, mjd double, m double")
    pdf = d.toPandas()
    c = campaign.chosen_epochs(d, "k", (0.5, 5.0), 8).toPandas()
    assert set(c["k"]) == set(range(5)) and (c.groupby(["k", "timescale"]).size() == 8).all()
    for r in c.itertuples():
        own = pdf[pdf["k"] == r.k]["mjd"]
        assert (own < r.start).sum() >= 3 and (own >= r.start + r.timescale).sum() >= 3
    c = campaign.chosen_epochs(d, "k", (5.0,), 8).toPandas()
    got = campaign.host_recovery(d, "k", "m", (1.0,), (5.0,), 8, 0.5).first()
    hits, n = 0, 0
    for r in c.itertuples():
        own = pdf[pdf["k"] == r.k]
        m = own["m"] - 1.0 * ((own["mjd"] - r.start) / 5.0).clip(0, 1)
        hits += abs(m[own["mjd"] < r.start].median() - m[own["mjd"] >= r.start + 5.0].median()) >= 0.5
        n += 1
    assert (got["n_trials"], got["n_recovered"]) == (n, hits)


# --- cascade -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.4).astype(int)
    x[rng.random(x.shape) < 0.03] = np.nan
    rows = [(k, int(y[k]), *[None if math.isnan(v) else float(v) for v in x[k]]) for k in range(500)]
    return spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"f{i} double" for i in range(6))).repartition(3).cache()


NAMES = [f"f{i}" for i in range(6)]


def test_cascade_round_trip_and_search(spark, labelled, tmp_path):
    train, dev = labelled.filter("id % 5 <> 0"), labelled.filter("id % 5 = 0")
    model, done = cascade.fit(train, dev, "id", NAMES, "y", trials=6, rounds=40, gate_trees=30)
    assert [d["trial"] for d in done] == list(range(6)) and all(0.4 < d["value"] <= 1 for d in done)
    # A trial run here, in one process, has the value that its Spark task gave.
    data, raw = cascade.binned(train, "id", NAMES, "y")
    rows = np.flatnonzero(cascade.gate_scores(model, raw) < model.gate_limit)
    assert cascade.objective(data, rows, {n: done[2][n] for n in cascade.RANGES}, 40, 40, 5, 42) == pytest.approx(done[2]["value"], abs=1e-12)
    best = max(done, key=lambda d: (d["value"], -d["trial"]))
    assert model.params == {n: best[n] for n in cascade.RANGES}
    cascade.save(spark, model, str(tmp_path), "v1")
    again = cascade.load(spark, str(tmp_path), "v1")
    a = cascade.predict(labelled, model, "id", ("y",)).toPandas().sort_values("id").reset_index(drop=True)
    b = cascade.predict(labelled, again, "id", ("y",)).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_exact=True)
    assert len(a) == 500 and (a.loc[a["anomaly"] >= model.gate_limit, "p"] == 0).all()
    with pytest.raises(Exception, match="(?i)exists"):
        cascade.save(spark, model, str(tmp_path), "v1")
    r = cascade.report(cascade.predict(dev, again, "id", ("y",)), "y").first()
    assert r["n"] == 100 and r["balanced_accuracy"] > 0.65 and r["passed"] > 0.8
    assert cascade.predict(labelled.filter("id < 0"), again, "id").collect() == []


def test_trees_part_where_the_gain_is_largest():
    x = np.array([[k, k % 2] for k in range(40)], np.uint8)
    y = (x[:, 0] >= 24).astype(int)
    p = {"leaves": 2, "depth": 3, "rate": 1.0, "least": 1, "rows": 1.0, "columns": 1.0, "l1": 0.0, "l2": 1.0, "weight": 1.0, "split": 0.0}
    trees, base = cascade.boost(x, y, p, 1)
    assert trees[0][0][:2] == (0, 23) and len(trees[0]) == 3
    assert (cascade.probabilities(trees, base, x)[24:] > 0.5).all() and (cascade.probabilities(trees, base, x)[:24] < 0.5).all()
    # Held-out rows that contradict the others stop it at its first tree.
    assert len(cascade.boost(x, y, p, 300, (x[::2], 1 - y[::2]), 5)[0]) == 1


def test_ablation_has_a_row_a_set(spark, labelled):
    p = {"leaves": 15, "depth": 4, "rate": 0.2, "least": 5, "rows": 1.0, "columns": 1.0, "l1": 0.0, "l2": 1.0, "weight": 1.0, "split": 0.0}
    out = cascade.ablation(labelled.filter("id % 5 <> 0"), labelled.filter("id % 5 = 0"), "id", {"a": ["f0"], "b": ["f1", "f2"], "c": ["f3", "f4"]}, "y", p, ["f5"], rounds=40).toPandas().sort_values("place")
    assert out["features"].tolist() == ["always", "+a", "+b", "+c", "-a", "-b", "-c", "all"] and out["n_features"].tolist() == [1, 2, 4, 6, 5, 4, 4, 6]
    of = out.set_index("features")
    assert of.loc["all", "auc_change"] == 0 and of.loc["+c", "auc"] == of.loc["all", "auc"]
    assert of.loc["-a", "auc_change"] < -0.05 and of.loc["always", "auc"] < of.loc["all", "auc"] - 0.1


@pytest.mark.parametrize("name", ["stepped_walk", "distribution_breaks", "color_lag"])
def test_study_has_a_row_a_long_source(spark, name):
    rows = getattr(studies, name)(spark, SF).collect()
    assert rows and len({r["source_id"] for r in rows}) == len(rows)


# --- models whose queries have no SQL ------------------------------------------------------


def test_sampler_recovers_the_walk(spark):
    rng = np.random.default_rng(21)
    t = np.sort(rng.uniform(0, 4000, 80))
    r = stochastic.sample_walk(curve_frame(spark, {1: (t, simulated(rng, t, 1.5, 120.0), np.full(80, 0.1))}), walkers=16, steps=500, burn=200).first()
    assert r["sigma16"] < 1.5 * 1.4 and r["sigma84"] > 1.5 / 1.4 and r["tau16"] < 120 * 1.8 and r["tau84"] > 120 / 1.8 and r["rhat"] < 1.2


def test_profiled_step_finds_a_step(spark):
    rng = np.random.default_rng(22)
    t = np.sort(rng.uniform(0, 1000, 100))
    flat = simulated(rng, t, 0.3, 20.0)
    found = {r["source_id"]: r for r in stochastic.fit_step(curve_frame(spark, {1: (t, flat + 4.0 * (t > 500), np.full(100, 0.1)), 2: (t, flat, np.full(100, 0.1))})).collect()}
    assert abs(found[1]["step_mjd"] - 500) < 80 and found[1]["height"] > 2 and found[1]["delta_bic"] > 10 > found[2]["delta_bic"]


def test_false_alarms_and_null_threshold_agree(spark):
    """Of the same simulated curves the share above the calibrated shift is the asked rate."""
    t = np.arange(0.0, 30.0, 0.5)
    d = curve_frame(spark, {k: (t, t * 0 + 1, t * 0 + 1) for k in range(150)})
    far = {r["threshold"]: r["rate"] for r in stochastic.false_alarm(d, "source_id", 20.0, 5.0, [0.0, 0.5, 1.0, 9.0]).collect()}
    assert far[0.0] == 1.0 and far[9.0] == 0.0 and far[0.5] > far[1.0]
    limit = stochastic.null_threshold(d, "source_id", 20.0, 5.0, 0.05, 4).first()
    assert limit["n"] == 600
    rate = stochastic.false_alarm(d, "source_id", 20.0, 5.0, [limit["threshold"]]).first()["rate"]
    assert rate == pytest.approx(0.05, abs=0.05)
    # A memory much shorter than a half leaves their medians closer together.
    assert stochastic.null_threshold(d, "source_id", 20.0, 0.5).first()["threshold"] < limit["threshold"]


def test_block_bootstrap_of_equal_and_unequal_seasons(spark):
    rows = [(1, s, 5.0) for s in range(8)] + [(2, s, 5.0 + s) for s in range(8)] + [(3, 0, 5.0)]
    out = {r["source_id"]: r for r in stochastic.block_bootstrap(spark.createDataFrame(rows, "source_id long, season int, med double"), "source_id", replicates=60).collect()}
    assert out[1]["sd"] == pytest.approx(0) and 0.05 < out[2]["sd"] < 0.6 and 3 not in out


def test_season_coherence_of_copies_and_mirrors(spark):
    t = np.concatenate([k * 100.0 + np.arange(10) for k in range(4)])
    wave = np.sin(np.arange(10) / 2)
    same, mirror = np.tile(wave, 4), np.concatenate([wave, -wave, wave, -wave])
    out = {r["source_id"]: r for r in features.season_coherence(curve_frame(spark, {1: (t, same, t * 0 + 1), 2: (t, mirror, t * 0 + 1)}), "source_id", 50.0).collect()}
    assert out[1]["n"] == 3 and out[1]["low"] == pytest.approx(1.0) and out[2]["high"] == pytest.approx(-1.0)


def test_injection_threshold_is_the_first_that_reaches(spark):
    g = spark.createDataFrame([(0.2, "step", 0.3), (0.5, "step", 0.95), (1.0, "step", 1.0), (0.2, "ramp", 1.0)], "amplitude double, shape string, completeness double")
    assert stochastic.completeness_threshold(g, 0.9).first()["amplitude"] == 0.5 and stochastic.completeness_threshold(g, 1.1).first()["amplitude"] is None


def test_boosted_trees_beat_the_base_rate(spark, labelled):
    from fluxtide.operators import classifier

    model = classifier.fit_trees(labelled.filter("id % 5 <> 0"), NAMES, "y", rounds=10)
    p = classifier.predict(model, labelled.filter("id % 5 = 0")).select("id", "y", "p").toPandas()
    assert len(p) == 100 and cascade.measures(p["y"].to_numpy(), p["p"].to_numpy())["auc"] > 0.75


@pytest.mark.parametrize("stack", [0, 500])
def test_positional_dedup_equals_brute_force(spark, stack):
    """Greedy, earlier-neighbour and component dedup over points, some of them at one place."""
    from fluxtide.operators import dedup

    rng = np.random.default_rng(23)
    pts = [(float(a), float(b)) for a, b in zip(rng.uniform(10, 20, 120), rng.uniform(-5, 5, 120))] + [(15.0, 0.0)] * stack
    order = rng.permutation(len(pts)).tolist()
    rows = [(k, *pts[i]) for k, i in enumerate(order)] + [(9999, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, ra double, dec double")
    ra, dec = np.radians([r[1] for r in rows[:-1]]), np.radians([r[2] for r in rows[:-1]])
    h = np.sin((dec[:, None] - dec) / 2) ** 2 + np.cos(dec[:, None]) * np.cos(dec) * np.sin((ra[:, None] - ra) / 2) ** 2
    near = np.degrees(2 * np.arcsin(np.sqrt(np.minimum(h, 1)))) <= 0.8
    kept = []
    for i in range(len(near)):
        if not any(near[i, j] for j in kept):
            kept.append(i)
    assert sorted(r["id"] for r in dedup.greedy_keep_first(df, 0.8, "id").collect()) == [*kept, 9999]
    assert sorted(r["id"] for r in dedup.drop_later_neighbours(df, 0.8, "id").collect()) == [i for i in range(len(near)) if not near[i, :i].any()] + [9999]
    root = np.arange(len(near))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(near))])
        if (new == root).all():
            break
        root = new
    got = {r["id"]: (r["root"], r["survivor"]) for r in dedup.component_groups(df, 0.8, "id", [F.col("id").desc()]).collect()}
    last = {r: max(np.flatnonzero(root == r).tolist()) for r in set(root.tolist())}
    assert got == {i: (int(r), last[int(r)]) for i, r in enumerate(root.tolist())} | {9999: (9999, 9999)}


def test_a_fold_is_a_task_of_its_own(spark):
    """Two trials of three folds are six tasks, whose means are the trials' values."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, cascade.BINS, (120, 3)).astype(np.uint8)
    data = cascade.Binned(x, (x[:, 0] > 30).astype(int), np.arange(120), ["a", "b", "c"], np.zeros((3, 63)), np.zeros(3))
    spark.sparkContext.setJobGroup("folds", "two trials")
    try:
        done = cascade.search(spark, data, np.arange(120), 2, rounds=20, folds=3)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("folds")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    assert [tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds] == [6]
    for d in done:
        assert d["value"] == cascade.objective(data, np.arange(120), {n: d[n] for n in cascade.RANGES}, 20, 40, 3, 42)
