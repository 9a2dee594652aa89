"""The run over the catalogue, policies, older benchmark forms, population statistics."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxtide.functions.params import P
from fluxtide.operators import population, sensitivity
from fluxtide.plans import lightcurves, registry, runs
from fluxtide.sources import catalogue, legacy, policy

registry.load()
SF = "/root/testdata/sf0.001"


def test_run_joins_its_parts(spark):
    """Every source once; scores, uncertainty and labels are those of the parts."""
    rows = {r["source_id"]: r for r in runs.source_run(spark, SF).collect()}
    status = {r["source_id"]: r for r in registry.QUERIES["source_status"](spark, SF).collect()}
    assert set(rows) == set(status) and not lightcurves._held
    error = {r["source_id"]: r for r in registry.QUERIES["score_uncertainty"](spark, SF).collect()}
    step = {r["source_id"]: r["log_bayes"] for r in registry.QUERIES["stepped_walk"](spark, SF).collect()}
    broken = {r["source_id"]: r["delta_bic"] for r in registry.QUERIES["broken_ou"](spark, SF).collect()}
    some = False
    for k, r in rows.items():
        assert (r["status"], r["n_points"]) == (status[k]["status"], status[k]["n_points"])
        if r["status"] != "OK":
            assert r["v2"] is None and r["label"] is None
            continue
        some = True
        assert r["step_log_bayes"] == pytest.approx(step[k]) if k in step else r["step_log_bayes"] is None
        assert r["broken_bic"] == pytest.approx(broken[k]) if k in broken else r["broken_bic"] is None
        if k in error:
            assert r["score_err"] == pytest.approx(error[k]["score_err"], abs=1e-4)
        assert 0 <= r["v2"] <= 1 and 0 <= r["v3"] <= 1 and r["score"] <= r["v3"] + 1e-12
        penalty = math.prod(P.penalties[x] for x in r["reasons"].split("; ") if x)
        assert r["score"] == pytest.approx(r["v3"] * penalty)
        assert ("stage_a=pass" in r["trace"]) == (r["score"] >= 0.3493918746)
    assert some


def test_run_meets_written_parts(spark):
    """The last plan only joins tables that were written part by part, and broadcasts none of them
    (the catalogue's status may be): parts of one plan would be in memory together."""
    plan = runs.source_run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 1 and "InArrow" not in plan and "InPandas" not in plan and "Window" not in plan


def test_fitted_scores_weigh_the_models(spark):
    """Stronger evidence of a model never lowers a score, and moves the second one by its weight."""
    from fluxtide.operators import scoring

    names = ("delta_mag", "delta_bic", "shift", "sf_bic", "colour", "sf_excess", "spread", "bimodality", "contrast", "contrast_err", "ratio", "rms_ratio")
    base = spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names], F.lit(2.0).alias("sigma"), F.lit(4.0).alias("mean_flux"))
    row = lambda b, s: base.withColumns({"broken_bic": F.lit(b).cast("double"), "step_log_bayes": F.lit(s).cast("double")}).select(scoring.composite_v2(runs.fitted_evidence()).alias("v2"), scoring.composite_v3(runs.fitted_evidence()).alias("v3")).first()
    total = sum(P.weights_v2.values())
    # sigma 2 at mean flux 4 is 4 times what is expected, which fills its component.
    assert row(None, None)["v2"] == pytest.approx(P.weights_v2["sigma_excess"] / total)
    assert row(20.0, None)["v2"] - row(None, None)["v2"] == pytest.approx(P.weights_v2["broken"] / total)
    assert row(None, 2.5)["v2"] - row(None, None)["v2"] == pytest.approx(0.5 * P.weights_v2["step_process"] / total)
    assert row(10.0, -3.0)["v3"] == pytest.approx((3.0 * 0.5 + 1.5) / 10.0)


# --- policies ----------------------------------------------------------------------------


def test_policy_files(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"t_recall": 0.5, "tuning": {"r_min_grid": [3.0, 2.0], "class_fp_objective": {"enabled": True, "weights": {"star": 1}}, "class_fp_caps": {"star": 0.2, "sn": None}}}))
    got = policy.read_policy(spark, str(p))
    assert got["t_recall"] == 0.5 and got["tuning"]["peak_frac_grid"] == [0.5, 0.6, 0.7] and policy.USUAL["tuning"]["r_min_grid"] == [1.5, 2.0, 2.5, 3.0]
    grid, args = policy.search_settings(got)
    assert grid["ratio"] == (2.0, 3.0) and args == {"recall_target": 0.8, "veto_target": 0.1, "caps": {"star": 0.2}, "weights": {"star": 1.0}}
    p.write_text("[1, 2]")
    with pytest.raises(ValueError, match="mapping"):
        policy.read_policy(spark, str(p))
    with pytest.raises(Exception, match="(?i)path"):
        policy.read_policy(spark, str(tmp_path / "none.json"))
    assert policy.accepted(got, {"recall_clagn": 0.9, "blazar_fpr": 0.2}) == {"recall_clagn_min": True, "blazar_fpr_max": False, "balanced_accuracy_min": False}


# --- older forms -------------------------------------------------------------------------


def test_legacy_tables(spark):
    known = spark.createDataFrame([("A", "1.0", 2.0, 1, "r"), ("B", "x", 2.0, 2, None)], "name string, ra string, dec double, tier int, reference string")
    control = spark.createDataFrame([("C", 3.0, 4.0)], "source_id string, ra double, dec double")
    out = {r["source_id"]: r for r in legacy.from_tables(known, None, control).collect()}
    assert out["A"]["label_method"] == "spectroscopic" and out["B"]["label_method"] == "photometric" and out["A"]["notes"] == "clagn"
    assert out["B"]["ra"] is None and out["C"]["label"] == "control" and out["C"]["label_source"] == ""
    assert legacy.from_tables(known.filter("false")).collect() == []
    with pytest.raises(ValueError):
        legacy.from_tables()
    twice = spark.createDataFrame([("A", 1.00000001, 2.0), ("A", 1.0, 2.0), ("A", 1.1, 2.0), ("B", None, None), ("B", None, None)], "source_id string, ra double, dec double")
    assert legacy.distinct_sources(twice).count() == 3


def test_json_lists_are_checked(spark):
    good = {"source_id": "A", "ra": 1, "dec": 2, "contaminant_type": "star", "citation": "x", "classification_method": "m"}
    rows = [good, good | {"ra": None}, good | {"contaminant_type": " "}, good | {"independent_of_pipeline": False}]
    got = [r["error"] for r in legacy.contaminants_from_json(spark.createDataFrame([(json.dumps(r),) for r in rows] + [("not json",), (None,)], "o string"), "o").collect()]
    assert got == [None, "no id or position", "no type", "not independent", "no id or position", "no id or position"]
    ok = legacy.contaminants_from_json(spark.createDataFrame([(json.dumps(good),)], "o string"), "o")
    legacy.refused(ok, 1)
    with pytest.raises(ValueError, match="1 sources, 100 needed"):
        legacy.refused(ok, 100)
    with pytest.raises(ValueError, match="A: no type"):
        legacy.refused(legacy.contaminants_from_json(spark.createDataFrame([(json.dumps(rows[2]),)], "o string"), "o"), 1)
    p = {"source_id": "A", "ra": 1, "dec": 2, "redshift": 0.1, "doi": "10.1/x", "spectral_state_1": "1", "spectral_state_2": "2", "epoch_1": "2001", "epoch_2": "2010"}
    cases = [(p, None), (p | {"doi": "x"}, "no reference"), (p | {"label_basis": "WISE colours"}, "label from photometry"), (p | {"label_basis": "WISE and spectroscopy"}, None), (p | {"epoch_2": ""}, "no epoch_2"), (p | {"redshift": None}, "no redshift"), (p | {"label_method": "WISE"}, "method is not spectroscopic")]
    got = [r["error"] for r in legacy.positives_from_json(spark.createDataFrame([(json.dumps(c),) for c, _ in cases], "o string"), "o").collect()]
    assert got == [e for _, e in cases]


def test_catalogue_aliases_and_classes(spark):
    d = spark.createDataFrame([(1.0, 2.0, 0.1, "S")], "RA double, DE double, Z double, Source_Name string")
    assert catalogue.rename_aliases(d).columns == ["ra", "dec", "redshift", "source_id"]
    t = legacy.with_truth(spark.createDataFrame([("positive",), ("CLAGN",), ("star",), (None,)], "label string")).collect()
    assert [(r["class"], r["y_true"]) for r in t] == [("clagn", 1), ("CLAGN", 1), ("star", 0), (None, 0)]
    with pytest.raises(ValueError):
        legacy.with_truth(spark.range(1))


# --- statistics --------------------------------------------------------------------------


def test_poisson_interval_and_rates():
    # Chi-square quantiles over two, at 0.16 and 0.84.
    for k, (low, high) in {0: (0.0, 1.8325814637483102), 3: (1.3671920, 5.9186200), 25: (20.0055, 31.0666)}.items():
        got = population.poisson_interval(k)
        if k == 0:
            assert got == (0.0, pytest.approx(high, rel=1e-9))
        # The interval's defining equations: the tails beyond it are 0.16 each.
        cdf = lambda m, n: sum(math.exp(-m + j * math.log(m) - math.lgamma(j + 1)) for j in range(n + 1))
        assert cdf(got[1], k) == pytest.approx(0.16, abs=1e-9)
        if k:
            assert 1 - cdf(got[0], k - 1) == pytest.approx(0.16, abs=1e-9)
    assert population.occurrence(0, 0)["rate"] is None and population.occurrence(5, 50)["rate"] == 0.1


def test_ks_and_bootstrap(spark):
    rng = np.random.default_rng(3)
    z, c = rng.integers(0, 60, 500) / 10.0, rng.random(500) < 0.2
    d = spark.createDataFrame([(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(z, c))], "id long, z double, c boolean")
    got = population.ks_against(d, "z", "c").first()
    grid = np.unique(z)
    brute = max(abs((z[c] <= g).mean() - (z <= g).mean()) for g in grid)
    assert got["ks"] == pytest.approx(brute) and (got["n_all"], got["n_chosen"]) == (500, int(c.sum()))
    lam = math.sqrt(500 * c.sum() / (500 + c.sum())) * brute
    assert got["p"] == pytest.approx(min(1, max(0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)))))
    b = population.bootstrap_median(d.filter("c").withColumn("g", F.lit("x")), "z", ["g"], "id", 200)
    r = b.first()
    assert r["n"] == c.sum() and r["median"] == np.median(z[c]) and r["lo"] <= r["median"] <= r["hi"]
    boot = [np.median(rng.choice(z[c], c.sum())) for _ in range(2000)]
    assert r["lo"] == pytest.approx(np.quantile(boot, 0.16), abs=0.3) and r["hi"] == pytest.approx(np.quantile(boot, 0.84), abs=0.3)
    f = population.fraction_by(d, "z", "c").toPandas()
    assert f["n_all"].sum() == (z < 5).sum() and len(f) == 6
    s = population.summary(d, "z", "c").first()
    assert s["n_total"] == 500 and s["rate_lo"] < s["rate"] < s["rate_hi"]


def test_average_precision_of_settings(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(round(rng.random(), 2)), int(rng.random() < 0.3)) for k in (1, 2) for _ in range(200)]
    got = {r["k"]: r["auc_pr"] for r in sensitivity.average_precision(spark.createDataFrame(rows, "k int, s double, y int"), ["k"], "s", "y").collect()}
    for k in (1, 2):
        s, y = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        want, pos = 0.0, y.sum()
        for v in np.unique(s):
            on = s >= v
            want += y[s == v].sum() / pos * y[on].sum() / on.sum()
        assert got[k] == pytest.approx(want)
    v = sensitivity.settings(spark).toPandas()
    assert len(v) == 17 and ((v[list(sensitivity.USUAL)] != sensitivity.USUAL).sum(axis=1) <= 1).all()


def test_ranks_and_places_without_a_whole_sort(spark):
    """Rank correlation and random places equal those of one sorted array, with and without keys,
    with ties, nulls and one value that most rows have."""
    from fluxtide.operators import metrics, sampling

    rng = np.random.default_rng(5)
    rows = [(i, "k" if i % 3 else None, float(round(rng.normal(), 1)) if i % 4 else 2.5, int(rng.integers(0, 3)) if i % 11 else None) for i in range(900)]
    d = spark.createDataFrame(rows, "id long, g string, x double, y int")

    def rho(part):
        a, b = (np.array([r[i] for r in part], float) for i in (2, 3))
        mid = lambda v: (np.searchsorted(np.sort(v), v, "left") + np.searchsorted(np.sort(v), v, "right") + 1) / 2
        return float(np.corrcoef(mid(a), mid(b))[0, 1])

    full = [r for r in rows if r[3] is not None]
    one = metrics.spearman(d, "x", "y").first()
    assert one["n"] == len(full) and one["rho"] == pytest.approx(rho(full))
    got = {r["g"]: (r["n"], r["rho"]) for r in metrics.spearman(d, "x", "y", ["g"]).collect()}
    for g in ("k", None):
        part = [r for r in full if r[1] == g]
        assert got[g] == (len(part), pytest.approx(rho(part)))
    assert metrics.spearman(d.withColumn("x", F.lit(1.0)), "x", "y").first()["rho"] is None
    assert metrics.spearman(d.filter("id < 0"), "x", "y").collect() == []
    import hashlib

    p = {r["id"]: (r["_place"], r["_n"]) for r in sampling.placed(d, "id", "g", 7).collect()}
    for g in ("k", None):
        order = sorted((r[0] for r in rows if r[1] == g), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
        assert [p[i] for i in order] == [(n, len(order)) for n in range(1, len(order) + 1)]


def test_drawn_medians_draw_as_sql_does():
    """Digests of rows of equal length, over one block and two; medians of replicates whose
    numbers have one to three digits, by hashlib."""
    import hashlib

    from fluxtide.operators import resampling

    start = lambda text: int(hashlib.md5(text).hexdigest()[:13], 16)
    rng = np.random.default_rng(1)
    for size in (0, 1, 54, 55, 56, 63, 64, 119, 120, 200):
        rows = rng.integers(0, 256, (7, size), np.uint8)
        assert resampling.md5_start(rows).tolist() == [start(r.tobytes()) for r in rows]
    for n, name in ((1, "a"), (12, "\u00e9" * 40), (1234, "x:y")):
        values = np.round(rng.normal(size=n), 1)
        got = resampling.drawn_medians(values, name, 8, 103, 5)
        want = [np.median([values[math.floor(start(f"5:{r}:{name}:{k}".encode()) / 2**52 * n)] for k in range(n)]) for r in range(8, 103)]
        assert got == pytest.approx(want, abs=1e-12)
