"""Queries that join features of light curves into scores, labels and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lightcurves, models  # noqa: F401  whose queries are joined here
from ..operators import breaks, sampling, scoring, variability
from .lightcurves import BREAK, DELTA, LC, SOURCE, light_curve, season_table
from .registry import ORACLE_SQL, QUERIES, query, table

# The evidence beside amplitudes and breaks: registered queries, one row a source each, joined as
# they are, here and in the SQL.  (query, its column, the feature)
EVIDENCE = (
    ("nonstationarity", "sigma_shift", "shift"),
    ("flux_ratio_rolling", "flux_ratio", "ratio"),
    ("structure_slope", "excess", "sf_excess"),
    ("structure_break", "delta_bic", "sf_bic"),
    ("paired_color", "colour", "colour"),
    ("bimodality", "bimodality", "bimodality"),
    ("delta_mag_max_contrast", "delta_mag", "contrast"),
    ("delta_mag_max_contrast", "delta_err", "contrast_err"),
    ("flux_ratio_stats", "sd", "spread"),
    ("optical_ir_ratio", "ratio", "rms_ratio"),
)
FLAGS = (("artifact_leave_one_out", "artifact", "artifact"), ("sn_morphology", "sn_like", "supernova_shape"), ("color_reversal", "reversal", "reversal"), ("dust_corr", "dusty", "dust"))

_taken = "".join(f", e{i} AS (SELECT source_id, {c} AS {name} FROM ({ORACLE_SQL[q]}))" for i, (q, c, name) in enumerate(EVIDENCE + FLAGS))
_met = "".join(f" LEFT JOIN e{i} USING (source_id)" for i in range(len(EVIDENCE + FLAGS)))
FEATURES = f"""{BREAK}, {DELTA.replace(LC + ', ', '')}, k AS (SELECT source_id, count(*) AS n_points, (max(mjd) - min(mjd)) AS baseline, max(flux) / greatest(min(flux), 1e-3) AS contrast, median(flux) AS med FROM lc GROUP BY source_id){_taken},
ft AS (SELECT k.source_id, n_points, baseline, med, standard.delta_mag, delta_err, cp.delta_bic, pre, post, width, {', '.join(f'e{i}.{name}' for i, (_, _, name) in enumerate(EVIDENCE + FLAGS))}, CASE source_id % 5 WHEN 0 THEN 'normal_agn' WHEN 1 THEN 'star' WHEN 2 THEN 'blazar' ELSE 'unknown' END AS class FROM k LEFT JOIN standard USING (source_id) LEFT JOIN cp USING (source_id){_met})"""
CLIP = "coalesce(least(greatest(({0}), 0), 1), 0)"
ND, NC, NS = CLIP.format("abs(delta_mag) / 2"), CLIP.format("delta_bic / 20"), CLIP.format("shift / 10")
NR, NB, NK = CLIP.format("CASE WHEN ratio > 0 THEN abs(2.5 * log10(ratio)) / 2 END"), CLIP.format("sf_bic / 20"), CLIP.format("abs(colour) / 0.3")
NX, NE, NV = CLIP.format("(sf_excess - 1) / 4"), CLIP.format("(spread - 1) / 3"), CLIP.format("rms_ratio")
NP, NM = CLIP.format("abs(contrast) / contrast_err / 5"), "CASE WHEN bimodality > 0.555 THEN " + CLIP.format("(bimodality - 0.555) / 0.3") + " ELSE 0 END"
SC = f"{FEATURES}, scd AS (SELECT *, (3.0 * greatest({ND}, {NR}) + 3.0 * greatest({NC}, {NS}, {NB}) + 2.0 * {NK} + 1.5 * greatest({NX}, {NE}) + 0.5 * {NV}) / 10.0 AS score FROM ft)"


def features(spark, sf, step=lambda df: df) -> DataFrame:
    """One row per source: amplitudes, breaks, counts and the registered evidence, joined on the
    source.  ``step`` is applied after each join: a run over many sources writes the table there,
    as a task of one plan for all would hold the sorts and groups of every part together."""
    with lightcurves.written_once(spark, sf):
        lc = light_curve(spark, sf)
        k = lc.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_points"), (F.max("mjd") - F.min("mjd")).alias("baseline"), F.median("flux").alias("med"))
        d = variability.delta_standard(season_table(spark, sf), SOURCE).select("source_id", "delta_mag", "delta_err")
        c = breaks.changepoint(lc, SOURCE).select("source_id", "delta_bic", "pre", "post", "width")
        by_query: dict[str, list] = {}
        for q, column, name in EVIDENCE + FLAGS:
            by_query.setdefault(q, []).append(F.col(column).alias(name))
        out = k
        for part in (d, c, *(QUERIES[q](spark, sf).select("source_id", *columns) for q, columns in by_query.items())):
            # Merged: each part has a row for every source, and many broadcasts would fill the driver.
            out = step(out.join(part.hint("merge"), "source_id", "left"))
        m = F.col("source_id") % 5
        return out.withColumn("class", F.when(m == 0, "normal_agn").when(m == 1, "star").when(m == 2, "blazar").otherwise("unknown"))


def evidence() -> dict:
    """The normalised components of the scores."""
    raw = {
        "flux_change": F.abs("delta_mag"), "changepoint": F.col("delta_bic"), "nonstationarity": F.col("shift"), "broken": F.col("sf_bic"), "colour": F.col("colour"),
        "sf_break": F.col("sf_excess"), "sigma_excess": F.col("spread"), "bimodality": F.col("bimodality"), "step_process": F.try_divide(F.abs("contrast"), F.col("contrast_err")),
    }
    c = scoring.components(raw)
    c["ratio"] = scoring.components({"flux_change": F.when(F.col("ratio") > 0, F.abs(2.5 * F.log10("ratio")))})["flux_change"]
    clipped = F.least(F.greatest(F.col("rms_ratio"), F.lit(0.0)), F.lit(1.0))
    return c | {"delta_mag": c["flux_change"], "sf": c["sf_break"], "sf_excess": c["sf_break"], "variability_flag": F.coalesce(clipped, F.lit(0.0))}


def scored(spark, sf) -> DataFrame:
    return features(spark, sf).withColumn("score", scoring.composite_v3(evidence()))


@query(f"WITH {SC} SELECT source_id, score FROM scd", "score", 6)
def composite_v3(spark, sf):
    return scored(spark, sf).select("source_id", "score")


@query(f"""WITH {FEATURES} SELECT source_id, (3.0 * {NS} + 3.0 * {NB} + 2.5 * {NP} + 2.5 * {ND} + 2.5 * {NC} + 2.0 * {NX} + 1.5 * {NK} + 1.5 * {NM} + 1.5 * {NV} + 1.0 * {NE}) / 21.0 AS v2,
(3.0 * {NS} + 2.5 * {ND} + 2.5 * {NC} + 2.0 * {NX} + 1.5 * {NK} + 1.5 * {NE} + 1.0 * {NV}) / 14.0 AS v1 FROM ft""", "v1 v2", 6)
def composite_v2(spark, sf):
    c = evidence()
    return features(spark, sf).select("source_id", scoring.composite_v2(c).alias("v2"), scoring.composite_v1(c).alias("v1"))


PENALTIES = (("supernova", "width < 3", 0.7), ("stellar", "class = 'star'", 0.5), ("blazar", "class = 'blazar'", 0.3), ("artifact", "artifact", 0.3), ("supernova_shape", "supernova_shape", 0.5), ("dust", "dust", 0.7), ("reversal", "reversal", 0.5))


@query(f"WITH {SC} SELECT source_id, score{''.join(f' * CASE WHEN {on} THEN {by} ELSE 1.0 END' for _, on, by in PENALTIES)} AS score, concat_ws('; ', {', '.join(f'CASE WHEN {on} THEN {chr(39)}{name}{chr(39)} END' for name, on, _ in PENALTIES)}) AS reasons FROM scd", "score", 6)
def penalty_chain(spark, sf):
    s, r = scoring.penalised(F.col("score"), {name: F.expr(on) for name, on, _ in PENALTIES})
    return scored(spark, sf).select("source_id", s.alias("score"), r.alias("reasons"))


@query(f"""WITH {LC}, n AS (SELECT source_id, count(*) AS n, count(flux) FILTER (flux > 0) AS good FROM lc GROUP BY source_id)
SELECT c_custkey AS source_id, coalesce(n, 0)::BIGINT AS n_points, CASE WHEN n IS NULL THEN 'NO_DATA' WHEN good = 0 THEN 'ERROR' WHEN good < 6 THEN 'TOO_FEW_POINTS' ELSE 'OK' END AS status FROM customer LEFT JOIN n ON c_custkey = source_id""")
def source_status(spark, sf):
    """What a run over the whole catalogue says of each of its sources."""
    n = light_curve(spark, sf).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flux") > 0).alias("good"))
    return scoring.statuses(table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id")), n, "source_id")


@query(f"""WITH {FEATURES}, d AS (SELECT source_id, delta_mag AS d, abs(delta_mag) AS a, width, pre, post FROM ft)
SELECT source_id, CASE WHEN a > 0.75 AND width < 5 THEN 'rapid' WHEN d < -0.5 AND pre > 0 AND post < pre THEN 'off_moderate' WHEN d > 0.5 AND post > pre THEN 'on_moderate' WHEN a BETWEEN 0.3 AND 0.5 THEN 'marginal' ELSE 'ambiguous' END AS label FROM d""")
def class_label(spark, sf):
    """Widths are in days of a month-long series: 5 days stand for two years."""
    f = features(spark, sf)
    return f.select("source_id", scoring.variability_class(F.col("delta_mag"), F.col("width") * (730.5 / 5.0), F.col("pre"), F.col("post"), F.lit(0.0), F.lit(1e9)).alias("label"))


@query(f"""WITH {SC}, g AS (SELECT *, coalesce(score >= 0.3493918746, false) AS a, class <> 'blazar' AS b, n_points >= 50 AS q, baseline >= 28 AS dt, coalesce(abs(delta_mag) > 0.2, false) AS s, coalesce(width > 1, false) AS t FROM scd)
SELECT source_id, CASE WHEN NOT a THEN 'Rejected' WHEN NOT b THEN 'Known blazar' WHEN NOT q OR NOT dt OR NOT s OR NOT t THEN 'Needs more data' WHEN class = 'normal_agn' THEN 'Known AGN' WHEN class = 'star' THEN 'Rejected' ELSE 'Candidate' END AS label,
concat_ws(';', 'stage_a=' || CASE WHEN a THEN 'pass' ELSE 'fail' END, 'blazar_veto=' || CASE WHEN b THEN 'pass' ELSE 'fail' END, 'qc=' || CASE WHEN q THEN 'pass' ELSE 'fail' END, 'data=' || CASE WHEN dt THEN 'pass' ELSE 'fail' END, 'state_change=' || CASE WHEN s THEN 'pass' ELSE 'fail' END, 'transient=' || CASE WHEN t THEN 'pass' ELSE 'fail' END) AS trace FROM g""")
def final_label(spark, sf):
    gates = {"stage_a": F.col("score") >= 0.3493918746, "blazar_veto": F.col("class") != "blazar", "qc": F.col("n_points") >= 50, "data": F.col("baseline") >= 28, "state_change": F.abs("delta_mag") > 0.2, "transient": F.col("width") > 1}
    return scored(spark, sf).select("source_id", scoring.final_label(gates, F.col("class")).alias("label"), scoring.gate_trace(gates).alias("trace"))


@query(f"WITH {SC}, t AS (SELECT source_id, score FROM scd WHERE class <> 'star' AND n_points >= 50 ORDER BY score DESC, source_id LIMIT 20) SELECT source_id, score, row_number() OVER (ORDER BY score DESC, source_id)::INTEGER AS rank FROM t", "score", 5)
def topn_candidates(spark, sf):
    s = scored(spark, sf).select("source_id", "score", "class", "n_points")
    return scoring.select_candidates(s, "score", ["source_id"], 20, (F.col("class") != "star") & (F.col("n_points") >= 50)).select("source_id", "score", "rank")


@query(f"WITH {LC} SELECT source_id, count(*) AS n_epochs, string_agg(event_id::VARCHAR, ',' ORDER BY mjd, event_id) AS epochs, min(mjd) AS first FROM lc GROUP BY source_id", "first")
def nested_cards(spark, sf):
    """Light curves as nested documents and back."""
    from ..sources.cards import build_cards, flatten_cards

    cards = build_cards(light_curve(spark, sf), "source_id", ["mjd", "event_id", "flux", "band"])
    flat = flatten_cards(cards, "source_id")
    g = flat.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_epochs"), F.array_sort(F.collect_list(F.struct("mjd", "event_id"))).alias("e"))
    return g.select("source_id", "n_epochs", F.concat_ws(",", F.transform("e", lambda x: x["event_id"].cast("string"))).alias("epochs"), F.element_at("e", 1)["mjd"].alias("first"))


@query("""SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def nested_turns(spark, sf):
    from ..sources.cards import build_cards, flatten_cards

    c = flatten_cards(build_cards(table(spark, sf, "conversations"), "conv_id", ["turn", "role", "text"]), "conv_id")
    g = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.sum(F.length("text")).alias("chars"))
    return g.select("conv_id", "n", F.concat_ws(">", F.transform("r", lambda x: x["role"])).alias("roles"), "chars")


# --- sampling ----------------------------------------------------------------------------

ALLOC = """w AS (SELECT c_mktsegment AS segment, count(*)::DOUBLE AS weight FROM customer GROUP BY 1), x AS (SELECT *, 100 * weight / sum(weight) OVER () AS e FROM w), f AS (SELECT *, floor(e + 1e-9) AS fl FROM x),
al AS (SELECT segment, weight, (fl + (row_number() OVER (ORDER BY round(e - fl, 9) DESC, segment) <= 100 - sum(fl) OVER ())::INT)::BIGINT AS allocated FROM f)"""


def _allocation(spark, sf) -> DataFrame:
    w = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return sampling.largest_remainder(w, "segment", "weight", 100)


@query(f"WITH {ALLOC} SELECT segment, weight, allocated FROM al")
def largest_remainder(spark, sf):
    return _allocation(spark, sf)


@query(f"WITH {ALLOC}, r AS (SELECT c_custkey AS id, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) AS p FROM customer) SELECT r.id, r.segment FROM r JOIN al USING (segment) WHERE p <= allocated")
def stratified_sample(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return sampling.stratified(c, "id", "segment", _allocation(spark, sf)).select("id", "segment")


@query("WITH r AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1) / count(*) OVER (PARTITION BY lang) AS p FROM documents) SELECT doc_id, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'dev' ELSE 'test' END AS split FROM r")
def hash_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.split(d, "doc_id", "lang", {"train": 0.7, "dev": 0.15, "test": 0.15}).select("doc_id", "split")


@query("SELECT c_custkey AS id FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 50")
def seeded_sample(spark, sf):
    return sampling.sample(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id", 50, 7)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders QUALIFY rank <= 3")
def per_group_top_n(spark, sf):
    o = table(spark, sf, "orders")
    return sampling.per_group_top_n(o, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query()
def thinned_curves(spark, sf):
    """At most 40 epochs per source; the number is checked in the tests."""
    return sampling.thin(light_curve(spark, sf), SOURCE, 40, "event_id").select("source_id", "event_id", "mjd")


