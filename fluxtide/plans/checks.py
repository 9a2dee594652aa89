"""Queries over readers, writers, catalogue rules and row-wise expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import astrometry, ids, stats
from ..functions import photometry as ph
from ..operators import quality, scoring
from ..sources import catalogue, readers, sinks
from ..sources.store import materialise, shared_path
from .registry import query, table


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 9 > 0 THEN round(c_acctbal, 6) END AS balance, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment FROM customer", "balance")
def text_roundtrip(spark, sf):
    """A table written as text with quoted commas and missing-value words, and read back."""
    k, path = F.col("c_custkey"), shared_path(spark)
    word = F.when(k % 8 == 0, "NaN").otherwise(" ")
    c = table(spark, sf, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 9 > 0, F.col("c_acctbal")).alias("balance"), F.when(k % 4 > 0, F.concat(F.col("c_mktsegment"), F.lit(", x"))).otherwise(word).alias("segment"))
    sinks.write_csv(c, path)
    back = readers.read_text_table(spark, path)
    return back.select("id", "name", ids.number(F.col("balance")).alias("balance"), F.regexp_replace("segment", ", x$", "").alias("segment"))


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS name FROM supplier")
def loose_table(spark, sf):
    """A table with bars between columns and notes beside it, as old catalogues come."""
    path = shared_path(spark)
    s = table(spark, sf, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(" ")).alias("id "), F.concat(F.lit(" "), "s_name").alias(" name"))
    s.write.option("header", True).option("sep", "|").csv(path)
    spark.createDataFrame([("# a note",)], "value string").write.mode("append").text(path)
    return readers.read_loose(spark, path)


@query("SELECT c_name AS source_id, c_custkey::DOUBLE AS ra, NULL::VARCHAR AS label FROM customer UNION ALL SELECT s_name, s_suppkey::DOUBLE, 'unlabelled' FROM supplier")
def conformed_union(spark, sf):
    """Tables with other columns brought to one schema, and joined end to end."""
    wanted = {"source_id": "string", "ra": "double", "label": "string"}
    c = table(spark, sf, "customer").select(F.col("c_name").alias("source_id"), F.col("c_custkey").cast("string").alias("ra"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("source_id"), F.col("s_suppkey").alias("ra"), F.col("s_nationkey").alias("extra"))
    full, _ = readers.available(c, ["source_id", "ra", "label"], ["source_id"])
    return readers.conform(full, wanted).unionByName(readers.conform(s, wanted, {"label": "unlabelled"}))


CATALOGUE = "ca AS (SELECT p_partkey AS k, (p_partkey * 7) % 400 - 10 AS ra, (p_partkey * 3) % 200 - 100 AS dec, CASE WHEN p_partkey % 13 > 0 THEN (p_partkey % 700) / 100.0::DOUBLE END AS z, p_name AS n FROM part)"


def _catalogue(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select((k * 7 % 400 - 10).alias("RA"), (k * 3 % 200 - 100).alias("DE"), F.when(k % 13 > 0, (k % 700 / 100.0).cast("string")).otherwise("NaN").alias("Z"), F.col("p_name").alias("SDSS_NAME"))


@query(f"WITH {CATALOGUE} SELECT n AS source_id, ra::DOUBLE AS ra, dec::DOUBLE AS dec, z AS redshift FROM ca WHERE z > 0.002 AND z < 5 AND ra BETWEEN 0 AND 360 AND dec BETWEEN -90 AND 90", "redshift")
def aliased_catalogue(spark, sf):
    """A catalogue under other column names, with numbers as text, validated."""
    return catalogue.validate(catalogue.rename_aliases(_catalogue(spark, sf))).select("source_id", "ra", "dec", "redshift")


@query(f"WITH {CATALOGUE} SELECT count(*) FILTER (z IS NULL) AS no_redshift, count(*) FILTER (z <= 0.002) AS too_near, count(*) FILTER (z >= 5) AS too_far, count(*) FILTER (z > 0.002 AND z < 5 AND NOT (ra BETWEEN 0 AND 360 AND dec BETWEEN -90 AND 90)) AS bad_position FROM ca")
def catalogue_removals(spark, sf):
    named = catalogue.rename_aliases(_catalogue(spark, sf))
    return catalogue.removals(named.withColumns({c: ids.number(F.col(c)) for c in ("ra", "dec", "redshift")}))


@query("SELECT p_partkey AS id, coalesce(c > 0.8, true) AS colour_pass, c IS NULL AS colour_unknown FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 > 0 THEN (p_partkey % 20) / 10.0::DOUBLE END AS c FROM part)")
def colour_selection(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("id"), F.when(k % 6 > 0, k % 20 / 10.0).alias("w1_minus_w2"))
    return catalogue.colour_selected(p).select("id", "colour_pass", "colour_unknown")


@query("""WITH x AS (SELECT p_partkey AS id, 55000 + (p_partkey * 11) % 3000 AS mjd, 6 + (p_partkey % 100) / 10.0::DOUBLE AS a, 5 + (p_partkey % 97) / 10.0::DOUBLE AS b FROM part)
SELECT id, mjd > 55593 AND mjd < 56987 AS hibernation, 8 < a AND a < 14.5 AS w1_reliable, 6.7 < b AND b < 13.7 AS w2_reliable,
nullif(concat_ws('; ', CASE WHEN a <= 8 THEN printf('W1=%.1f saturated (limit: 8.0 mag)', a) WHEN a >= 14.5 THEN printf('W1=%.1f too faint (limit: 14.5 mag)', a) END, CASE WHEN b <= 6.7 THEN printf('W2=%.1f saturated (limit: 6.7 mag)', b) WHEN b >= 13.7 THEN printf('W2=%.1f too faint (limit: 13.7 mag)', b) END), '') AS flag FROM x""")
def epoch_flags(spark, sf):
    """Epochs in the gap of the survey, and magnitudes outside a band's reliable range."""
    k = F.col("p_partkey")
    a, b = 6 + k % 100 / 10.0, 5 + k % 97 / 10.0
    return table(spark, sf, "part").select(k.alias("id"), ph.in_hibernation(55000 + k * 11 % 3000).alias("hibernation"), ph.reliable(a, "W1").alias("w1_reliable"), ph.reliable(b, "W2").alias("w2_reliable"), ph.saturation_flag(a, b).alias("flag"))


@query("""SELECT id, CASE WHEN id % 5 IN (0, 1) THEN NULL WHEN id % 5 = 2 THEN -1.5 ELSE id / 4.0::DOUBLE END AS value, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN NULL ELSE b END AS finite FROM (SELECT c_custkey AS id, c_acctbal AS b FROM customer)""", "value finite")
def written_numbers(spark, sf):
    """Numbers as text with missing-value words, and doubles that may be infinite or NaN."""
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, "null").when(k % 5 == 1, " NaN ").when(k % 5 == 2, " -1.5").otherwise((k / 4.0).cast("string"))
    odd = F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 3 == 1, F.lit(float("-inf"))).otherwise(F.col("c_acctbal"))
    return table(spark, sf, "customer").select(k.alias("id"), ids.number(text).alias("value"), ph.finite(odd).alias("finite"))


@query(r"SELECT p_partkey AS id, substr(regexp_replace(trim(t), '[^A-Za-z0-9._+-]+', '_', 'g'), 1, 120) AS name FROM (SELECT p_partkey, p_name || '/ SDSS J12:3+0.5 é*' || p_brand AS t FROM part)")
def file_names(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), ids.file_name(F.concat("p_name", F.lit("/ SDSS J12:3+0.5 é*"), "p_brand")).alias("name"))


@query("SELECT count(*) FILTER (NOT coalesce(CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END > 0, false)) AS balance, count(*) FILTER (c_nationkey > 20) AS nation, count(*) FILTER (length(c_name) = 0) AS name FROM customer")
def rule_violations(spark, sf):
    c = table(spark, sf, "customer")
    quality.required(c, ["c_custkey", "c_name"])
    return quality.violations(c, {"balance": F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")) > 0, "nation": F.col("c_nationkey") <= 20, "name": F.length("c_name") > 0})


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'confirmed' WHEN c_custkey % 3 > 0 AND coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 2 = 0 END, false) THEN 'supporting' ELSE 'none' END AS tier FROM customer")
def spectral_evidence(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), scoring.evidence_tier(k % 3, k % 4 == 0, F.when(k % 5 > 0, k % 2 == 0)).alias("tier"))


@query("""WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 30) / 20.0 - 0.2::DOUBLE END AS p, CASE p_partkey % 3 WHEN 0 THEN 'VARIABLE' WHEN 1 THEN 'CONSTANT' END AS f, (p_partkey % 50) / 10.0 - 1::DOUBLE AS s, (p_partkey % 40) / 10.0 - 0.5::DOUBLE AS m FROM part),
y AS (SELECT *, CASE WHEN s > 0 AND m > 0 THEN s / pow(m, -0.5) ELSE 1 END AS e FROM x)
SELECT id, least(greatest(CASE WHEN p > 0 THEN p ELSE 0 END, CASE WHEN f = 'VARIABLE' THEN 0.3 ELSE 0 END, 0), 1) AS optical, e AS excess, least(greatest((e - 1) / 3, 0), 1) AS excess_score FROM y""", "optical excess excess_score")
def variability_norms(spark, sf):
    k = F.col("p_partkey")
    p, f = F.when(k % 5 > 0, k % 30 / 20.0 - 0.2), F.when(k % 3 == 0, "VARIABLE").when(k % 3 == 1, "CONSTANT")
    e = stats.sigma_excess(k % 50 / 10.0 - 1, k % 40 / 10.0 - 0.5)
    return table(spark, sf, "part").select(k.alias("id"), astrometry.variability_score(p, f).alias("optical"), e.alias("excess"), stats.NORMALISERS["sigma_excess"](e).alias("excess_score"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders", "o_totalprice")
def written_table(spark, sf):
    """An intermediate table in the shared folder, as iterations and stages keep them."""
    return materialise(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
