"""Queries over customer, supplier, part and orders read as source catalogues."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import astrometry, ids, physics, sky
from ..functions import photometry as ph
from ..operators import dedup, resolve, spatial
from ..sources import catalogue as cat
from .registry import query, table


def _ra(key: Column) -> Column:
    return F.pmod(key * 7919, F.lit(36000)) / 100.0


def _dec(key: Column) -> Column:
    return F.pmod(key * 104729, F.lit(17900)) / 100.0 - 89.5


def _z(key: Column) -> Column:
    return F.pmod(key * 31, F.lit(500)) / 100.0


def _pos(name: str, key: str) -> str:
    return f"SELECT {key} AS id, (({key} * 7919) % 36000)::DOUBLE / 100.0 AS ra, (({key} * 104729) % 17900)::DOUBLE / 100.0 - 89.5 AS dec, (({key} * 31) % 500)::DOUBLE / 100.0 AS z FROM {name}"


SEP = "degrees(2 * asin(least(1, sqrt(power(sin((radians({d2}) - radians({d1})) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * power(sin(radians({r2} - {r1}) / 2), 2)))))"
SEP_AB = SEP.format(r1="a.ra", d1="a.dec", r2="b.ra", d2="b.dec")
CATS = f"c AS ({_pos('customer', 'c_custkey')}), s AS ({_pos('supplier', 's_suppkey')}), p AS ({_pos('part', 'p_partkey')})"
RADIUS = 2.0


def positions(spark: SparkSession, sf: str, name: str, key: str, out: str) -> DataFrame:
    t = table(spark, sf, name)
    return t.select(F.col(key).alias(out), _ra(F.col(key)).alias("ra"), _dec(F.col(key)).alias("dec"), _z(F.col(key)).alias("z"))


@query(f"WITH {CATS} SELECT id, ra, dec, z FROM c WHERE z > 0.002 AND z < 5.0 AND ra BETWEEN 0 AND 360 AND dec BETWEEN -90 AND 90", "ra dec z")
def catalogue_valid(spark, sf):
    c = positions(spark, sf, "customer", "c_custkey", "objid").withColumnsRenamed({"ra": "RA_J2000", "dec": "DEJ2000", "z": "redshift"})
    return cat.validate(cat.rename_aliases(c)).select(F.col("source_id").alias("id"), "ra", "dec", F.col("redshift").alias("z"))


@query(f"WITH {CATS} SELECT count(*) FILTER (z > 0.002) AS above, count(*) FILTER (z > 0.002 AND z < 5.0) AS below, count(*) AS n FROM c")
def catalogue_removals(spark, sf):
    return positions(spark, sf, "customer", "c_custkey", "id").agg(F.count_if(F.expr("z > 0.002")).alias("above"), F.count_if(F.expr("z > 0.002 AND z < 5.0")).alias("below"), F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN ' NGC' || c_custkey WHEN 1 THEN 'SDSSJJJ' || c_custkey || '+1' WHEN 2 THEN 'mrk  ' || c_custkey WHEN 3 THEN c_custkey::VARCHAR ELSE c_name END AS raw FROM customer),
t AS (SELECT id, raw, trim(raw) AS s FROM x),
y AS (SELECT id, raw, CASE WHEN regexp_full_match(s, '\\d+') THEN s ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^SDSSJ{2,}', 'SDSSJ'), '^NGC\\s*(\\d+)$', 'NGC \\1', 'i'), '^MRK\\s*(\\d+)$', 'Mrk \\1', 'i'), '^IC\\s*(\\d+)$', 'IC \\1', 'i') END AS canonical_id FROM t)
SELECT id, canonical_id, CASE WHEN regexp_matches(trim(raw), '^SDSSJ{2,}') THEN 'sdss_double_j' WHEN trim(raw) <> canonical_id THEN 'spacing_normalized' END AS mismatch FROM y""")
def id_canonical(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit(" NGC"), k)).when(k % 5 == 1, F.concat(F.lit("SDSSJJJ"), k, F.lit("+1"))).when(k % 5 == 2, F.concat(F.lit("mrk  "), k)).when(k % 5 == 3, k.cast("string")).otherwise(F.col("c_name"))
    c = ids.canonical(raw)
    return table(spark, sf, "customer").select(k.alias("id"), c.alias("canonical_id"), ids.mismatch(raw, c).alias("mismatch"))


@query("""SELECT substr(p_brand, 1, 1 + (p_partkey % 6)::INTEGER) AS name, count(*) AS n FROM part WHERE regexp_full_match(substr(p_brand, 1, 1 + (p_partkey % 6)::INTEGER), '[A-Za-z]{1,3}') OR substr(p_brand, 1, 1 + (p_partkey % 6)::INTEGER) IN ('PKS', 'PG', 'HS', 'B2') GROUP BY 1""")
def ambiguous_ids(spark, sf):
    name = F.substring(F.col("p_brand"), F.lit(1), (1 + F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf, "part").select(ids.canonical(name).alias("name")).filter(ids.is_ambiguous(F.col("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN true ELSE o_orderpriority LIKE '%1%' END AS has_w1, o_orderkey % 3 <> 0 AND NOT (o_orderstatus = 'O' AND o_orderkey % 3 = 0) AS has_w2 FROM orders")
def band_tokens(spark, sf):
    o = table(spark, sf, "orders")
    one = F.when((F.col("o_orderstatus") == "O") | F.col("o_orderpriority").contains("1"), F.lit("W1"))
    two = F.when(F.col("o_orderkey") % 3 != 0, F.lit(" w2"))
    a, b = ids.bands(F.concat_ws(",", one, two))
    return o.select(F.col("o_orderkey").alias("id"), a.alias("has_w1"), b.alias("has_w2"))


@query("""WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'OK' WHEN 1 THEN ' no_data' WHEN 2 THEN 'TOO_FEW_POINTS' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'NAME_RESOLVE_FAIL' ELSE 'odd' END AS st,
CASE o_orderkey % 4 WHEN 0 THEN 'Missing AllWISE coverage' WHEN 1 THEN 'Baseline 3.1 yr < 7 yr' WHEN 2 THEN 'insufficient epochs' ELSE NULL END AS rr FROM orders)
SELECT id, CASE WHEN st = 'OK' THEN 'ok' WHEN st = ' no_data' THEN CASE WHEN rr LIKE '%AllWISE%' THEN 'missing_allwise' ELSE 'no_data_other' END WHEN st = 'TOO_FEW_POINTS' THEN CASE WHEN rr LIKE '%epoch%' THEN 'few_epochs' WHEN rr LIKE '%Baseline%' THEN 'short_baseline' ELSE 'too_few_points_other' END
WHEN st = 'ERROR' THEN 'error' WHEN st = 'NAME_RESOLVE_FAIL' THEN 'name_resolve_fail' ELSE 'unknown' END AS bucket FROM x""")
def rejection_bucket(spark, sf):
    k = F.col("o_orderkey")
    st = F.when(k % 6 == 0, "OK").when(k % 6 == 1, " no_data").when(k % 6 == 2, "TOO_FEW_POINTS").when(k % 6 == 3, "ERROR").when(k % 6 == 4, "NAME_RESOLVE_FAIL").otherwise("odd")
    rr = F.when(k % 4 == 0, "Missing AllWISE coverage").when(k % 4 == 1, "Baseline 3.1 yr < 7 yr").when(k % 4 == 2, "insufficient epochs")
    return table(spark, sf, "orders").select(k.alias("id"), ids.rejection_bucket(st, rr).alias("bucket"))


@query("""WITH x AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 > 0 THEN (c_custkey % 50) / 10.0 END::DOUBLE AS pm, CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 40) / 10.0 END::DOUBLE AS plx, CASE WHEN c_custkey % 13 > 0 THEN (c_custkey % 30) / 10.0 END::DOUBLE AS ruwe FROM customer),
y AS (SELECT id, pm IS NULL AND plx IS NULL AS unknown, coalesce(plx > 3, false) AS a, coalesce(pm > 3, false) AS b, coalesce(ruwe > 2.5, false) AS h, coalesce(ruwe > 1.4, false) AND NOT coalesce(ruwe > 2.5, false) AND (coalesce(plx > 3, false) OR coalesce(pm > 3, false)) AS s FROM x)
SELECT id, (a OR b OR h OR s) AND NOT unknown AS reject, CASE WHEN a OR b OR h OR s THEN concat_ws('; ', CASE WHEN a THEN 'parallax' END, CASE WHEN b THEN 'proper_motion' END, CASE WHEN h THEN 'ruwe_hard' END, CASE WHEN s THEN 'ruwe_corroborated' END) ELSE 'passes_all' END AS reason,
CASE WHEN unknown THEN 'unknown' WHEN a::INT + b::INT + h::INT >= 2 THEN 'high' WHEN a::INT + b::INT + h::INT = 1 THEN 'medium' ELSE 'low' END AS confidence FROM y""")
def star_rules(spark, sf):
    k = F.col("c_custkey")
    v = astrometry.star_verdict(F.when(k % 11 > 0, (k % 50) / 10.0), F.when(k % 7 > 0, (k % 40) / 10.0), F.when(k % 13 > 0, (k % 30) / 10.0))
    return table(spark, sf, "customer").select(k.alias("id"), v["reject"].alias("reject"), v["reason"].alias("reason"), v["confidence"].alias("confidence"))


@query("""WITH x AS (SELECT c_custkey AS id, ((c_custkey % 21) - 10)::DOUBLE AS a, ((c_custkey % 5) + 1) / 10.0::DOUBLE AS ea, ((c_custkey % 17) - 8)::DOUBLE AS d, ((c_custkey % 3) + 1) / 10.0::DOUBLE AS ed FROM customer)
SELECT id, CASE WHEN sqrt(a * a + d * d) < 1e-10 THEN 0 ELSE (a * a + d * d) / sqrt(power(a * ea, 2) + power(d * ed, 2)) END AS pm_sig FROM x""", "pm_sig", 5)
def pm_significance(spark, sf):
    k = F.col("c_custkey")
    s = astrometry.pm_significance((k % 21 - 10).cast("double"), (k % 5 + 1) / 10.0, (k % 17 - 8).cast("double"), (k % 3 + 1) / 10.0)
    return table(spark, sf, "customer").select(k.alias("id"), s.alias("pm_sig"))


@query(f"WITH {CATS} SELECT id, degrees(asin(sin(radians(dec)) * sin(radians(27.12825)) + cos(radians(dec)) * cos(radians(27.12825)) * cos(radians(ra - 192.85948)))) AS b FROM c", "b")
def galactic_lat(spark, sf):
    return positions(spark, sf, "customer", "c_custkey", "id").select("id", sky.galactic_latitude(F.col("ra"), F.col("dec")).alias("b"))


@query(f"""WITH {CATS}, m AS (SELECT id, z, least(greatest(0.5 * exp(-z / 0.15), 0), 0.95) AS f FROM c)
SELECT id, f, CASE WHEN f > 0.5 THEN 'severe_contamination' WHEN f > 0.3 THEN 'moderate_contamination' WHEN f > 0.1 THEN 'low_contamination' ELSE 'negligible' END AS flag,
CASE WHEN 1 - f >= 0.2 THEN 2.5 * log10(least(greatest(1 + (pow(10, 0.4 / 2.5) - 1) / (1 - f), 0.01), 100)) ELSE 0.4 END AS corrected FROM m""", "f corrected")
def host_correction(spark, sf):
    f = ph.host_fraction(F.col("z"))
    return positions(spark, sf, "customer", "c_custkey", "id").select("id", f.alias("f"), ph.host_flag(f).alias("flag"), ph.host_corrected(F.lit(0.4), 1.0 - f).alias("corrected"))


@query("""WITH x AS (SELECT p_partkey AS id, 8 + (p_partkey % 80) / 10.0::DOUBLE AS mag FROM part), y AS (SELECT id, mag, 309540.0 * pow(10, -0.4 * mag) AS flux FROM x)
SELECT id, mag, flux, flux * ln(10) / 2.5 * 0.02 AS flux_err, -2.5 * log10(flux / 309540.0) AS back, 8 < mag AND mag < 14.5 AS reliable FROM y""", "mag flux flux_err back", 5)
def mag_flux_roundtrip(spark, sf):
    mag = 8 + (F.col("p_partkey") % 80) / 10.0
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), mag.alias("mag"))
    m = F.col("mag")
    return t.select("id", "mag", ph.mag_to_flux(m).alias("flux"), ph.mag_error_to_flux_error(m, F.lit(0.02)).alias("flux_err"), ph.flux_to_mag(ph.mag_to_flux(m)).alias("back"), ph.reliable(m, "W1").alias("reliable"))


@query("""SELECT l_orderkey, l_linenumber, 0.5 * (l_quantity + l_tax) * least(greatest((l_discount * 1000 - 10) / 90, 0.1), 1) AS w_snr, 1 / (l_tax * l_tax + 0.005 * 0.005) AS w_noise FROM lineitem""", "w_snr w_noise", 4)
def epoch_weights(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", ph.snr_weight(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount") * 1000).alias("w_snr"), ph.noise_weight(F.col("l_tax")).alias("w_noise"))


@query(f"""WITH x AS (SELECT p_partkey AS id, 11 + (p_partkey % 40) / 10.0::DOUBLE AS w1, 10 + (p_partkey % 35) / 10.0::DOUBLE AS w2, 0.05 + (p_partkey % 30) / 100.0::DOUBLE AS z, 50 + (p_partkey % 900)::DOUBLE AS tau FROM part),
d AS (SELECT *, (1 + z) * (2.997924e10 / 1e5 / 67.4) * (z / 1000.0) * (list_sum(list_transform(range(1, 1000), lambda i: 1 / sqrt(0.315 * pow(1 + z * i / 1000.0, 3) + 0.685))) + 0.5 * (1 + 1 / sqrt(0.315 * pow(1 + z, 3) + 0.685))) AS dl FROM x),
l AS (SELECT *, 8.0 * 4 * pi() * pow(dl * 1e6 * 3.085678e18, 2) * (3.0e14 / 3.4) * 309.540 * pow(10, -0.4 * w1) * 1e-23 * pow(1 + z, -0.4 * (w2 - w1) / log10(3.4 / 4.6) - 1) AS lbol FROM d)
SELECT id, dl, log10(lbol) AS log_l, 0.5 * sqrt(lbol / 1e46) AS r_graphite, 7.2e-3 * pow(lbol / 20 / 1e43, 0.532) AS r_blr, 2000 * pow(309.540 * pow(10, -0.4 * w1) / (171.787 * pow(10, -0.4 * w2)), 0.42) AS t_dust,
(log10(greatest(tau, 1)) - 2.4 - 0.17 * log10(lbol / 1e44)) / 0.038 AS log_m8 FROM l""", "dl log_l r_graphite r_blr t_dust log_m8", 4)
def physics_chain(spark, sf):
    k = F.col("p_partkey")
    x = table(spark, sf, "part").select(k.alias("id"), (11 + (k % 40) / 10.0).alias("w1"), (10 + (k % 35) / 10.0).alias("w2"), (0.05 + (k % 30) / 100.0).alias("z"), (50 + k % 900).cast("double").alias("tau"))
    x = x.withColumn("dl", physics.luminosity_distance(F.col("z"))).withColumn("lbol", physics.bolometric_luminosity(F.col("w1"), F.col("w2"), F.col("z")))
    lb = F.col("lbol")
    return x.select("id", "dl", F.log10(lb).alias("log_l"), physics.sublimation_radius(lb).alias("r_graphite"), physics.broad_line_radius(lb).alias("r_blr"), physics.dust_temperature(F.col("w1"), F.col("w2")).alias("t_dust"), (F.log10(physics.black_hole_mass(F.col("tau"), lb)) - 8.0).alias("log_m8"))


@query(f"""WITH x AS (SELECT p_partkey AS id, pow(10, 6 + (p_partkey % 40) / 10.0::DOUBLE) AS m, (p_partkey % 3000)::DOUBLE AS days FROM part),
y AS (SELECT *, 150 * 6.6743e-8 * m * 1.989e33 / pow(2.997924e10, 2) AS r, 6.6743e-8 * m * 1.989e33 AS gm FROM x),
t AS (SELECT *, r / 2.997924e10 / 86400 AS t_light, sqrt(pow(r, 3) / gm) / 86400 AS t_dyn FROM y)
SELECT id, log10(t_light) AS light, log10(t_dyn) AS dynamical, CASE WHEN days < 2 * t_light OR days < 5 * t_dyn / 0.1 THEN 'disk_instability' WHEN days < 2 * t_dyn / 0.1 * 400 THEN 'accretion_rate_change' WHEN days < 5 * t_dyn / 0.1 * 400 THEN 'viscous_transition' ELSE 'external_trigger' END AS mechanism FROM t""", "light dynamical")
def disk_timescales(spark, sf):
    k = F.col("p_partkey")
    x = table(spark, sf, "part").select(k.alias("id"), F.pow(F.lit(10.0), 6 + (k % 40) / 10.0).alias("m"), (k % 3000).cast("double").alias("days"))
    t = physics.disk_timescales(F.col("m"))
    return x.select("id", F.log10(t["light"]).alias("light"), F.log10(t["dynamical"]).alias("dynamical"), physics.mechanism(F.col("days"), t).alias("mechanism"))


# --- joins -------------------------------------------------------------------------------

@query(f"WITH {CATS} SELECT a.id AS source, b.id AS match, {SEP_AB} AS sep FROM c a JOIN s b ON {SEP_AB} <= {RADIUS}", "sep")
def cone_join(spark, sf):
    c, s = positions(spark, sf, "customer", "c_custkey", "source").drop("z"), positions(spark, sf, "supplier", "s_suppkey", "match").drop("z")
    return spatial.within(c, s, RADIUS).select("source", "match", "sep")


@query(f"WITH {CATS}, n AS (SELECT a.id AS source, b.id AS match, {SEP_AB} AS sep FROM c a LEFT JOIN s b ON {SEP_AB} <= {RADIUS}) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY sep NULLS LAST, match) = 1", "sep")
def nearest_match(spark, sf):
    c, s = positions(spark, sf, "customer", "c_custkey", "source").drop("z"), positions(spark, sf, "supplier", "s_suppkey", "match").drop("z")
    return spatial.nearest(c, s, RADIUS, "source", "match").select("source", "match", "sep")


@query(f"WITH {CATS} SELECT id AS source FROM c a WHERE EXISTS (SELECT 1 FROM s b WHERE {SEP_AB} <= {RADIUS})")
def spatial_semi(spark, sf):
    c, s = positions(spark, sf, "customer", "c_custkey", "source"), positions(spark, sf, "supplier", "s_suppkey", "match")
    return spatial.within(c, s.drop("z"), RADIUS, how="left_semi").select("source")


@query(f"WITH {CATS} SELECT id AS source FROM c a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE {SEP_AB} <= {RADIUS})")
def spatial_anti(spark, sf):
    c, s = positions(spark, sf, "customer", "c_custkey", "source"), positions(spark, sf, "supplier", "s_suppkey", "match")
    return spatial.within(c, s.drop("z"), RADIUS, how="left_anti").select("source")


@query(f"WITH {CATS} SELECT a.id AS source, b.id AS match FROM c a JOIN s b ON {SEP_AB} <= {RADIUS} AND abs(a.z * 100 - b.z * 100) <= 90")
def space_time_join(spark, sf):
    c = positions(spark, sf, "customer", "c_custkey", "source").withColumn("t1", F.col("z") * 100).drop("z")
    s = positions(spark, sf, "supplier", "s_suppkey", "match").withColumn("t2", F.col("z") * 100).drop("z")
    return spatial.within_time(c, s, RADIUS, 90.0, "t1", "t2").select("source", "match")


@query(f"WITH {CATS}, n AS (SELECT a.id, count(b.id) AS n_near, string_agg(b.id::VARCHAR, '|' ORDER BY b.id) AS near FROM s a LEFT JOIN c b ON {SEP_AB} <= {RADIUS} GROUP BY a.id) SELECT id, n_near, coalesce(near, '') AS near FROM n")
def cell_partition_join(spark, sf):
    """Sources with all epochs near them as one nested list, by cells."""
    s, c = positions(spark, sf, "supplier", "s_suppkey", "id").drop("z"), positions(spark, sf, "customer", "c_custkey", "near").drop("z")
    g = spatial.within(s, c, RADIUS, how="left").groupBy("id").agg(F.array_sort(F.collect_list("near")).alias("near"))
    return g.select("id", F.size("near").cast("long").alias("n_near"), F.concat_ws("|", F.transform("near", lambda x: x.cast("string"))).alias("near"))


@query("""WITH side AS (SELECT s_suppkey AS k1, s_name AS k2, s_acctbal AS bal FROM supplier), l AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 200 END AS k1, 'Supplier#' || lpad((o_custkey % 150)::VARCHAR, 9, '0') AS k2 FROM orders)
SELECT l.id, coalesce(a.bal, b.bal) AS bal, CASE WHEN a.k1 IS NOT NULL THEN 'k1' WHEN b.k2 IS NOT NULL THEN 'k2' END AS side_key FROM l LEFT JOIN side a ON l.k1 = a.k1 LEFT JOIN side b ON l.k2 = b.k2""", "bal")
def two_key_enrich(spark, sf):
    side = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k1"), F.col("s_name").alias("k2"), F.col("s_acctbal").alias("bal"))
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 200).alias("k1"), F.concat(F.lit("Supplier#"), F.lpad((F.col("o_custkey") % 150).cast("string"), 9, "0")).alias("k2"))
    return resolve.enrich(left, side, ["k1", "k2"], ["bal"], "side").select("id", "bal", "side_key")


@query("""WITH tok AS (SELECT DISTINCT p_partkey AS idx, upper(trim(t)) AS token FROM (SELECT p_partkey, unnest(list_concat([p_brand || '-' || (p_partkey % 50)], string_split(p_name || ';' || p_type, ';'))) AS t FROM part)),
l AS (SELECT c_custkey AS id, unnest([0, 1]) AS pr, unnest(['brand#' || (11 + c_custkey % 40) || '-' || (c_custkey % 50), 'Brand#' || (c_custkey % 25) || '-7']) AS t FROM customer),
h AS (SELECT id, pr, idx, token FROM l JOIN tok ON upper(l.t) = tok.token)
SELECT c_custkey AS id, idx, token FROM customer LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY pr, idx) = 1) ON c_custkey = id""")
def token_match(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey") % 50).alias("name"), F.concat_ws(";", "p_name", "p_type").alias("aliases"))
    t = resolve.tokens(part, "idx", ["name"], ["aliases"])
    k = F.col("c_custkey")
    left = table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("brand#"), 11 + k % 40, F.lit("-"), k % 50).alias("canonical_id"), F.concat(F.lit("Brand#"), k % 25, F.lit("-7")).alias("source_id"))
    return resolve.token_match(left, "id", ["canonical_id", "source_id"], t, "idx").select("id", "idx", "token")


@query(f"""WITH {CATS}, sc AS (SELECT id, ra, dec, (id * 37 % 1000)::DOUBLE / 1000 AS score FROM c), m AS (SELECT b.id AS known, a.score, {SEP_AB} AS sep FROM s b LEFT JOIN sc a ON {SEP_AB} <= {RADIUS}), best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY known ORDER BY sep NULLS LAST) = 1)
SELECT t AS threshold, count(*) AS n_known, count(score) AS n_matched, count(*) FILTER (score >= t) AS n_recovered FROM best, (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS t) GROUP BY t""")
def known_recovery(spark, sf):
    sc = positions(spark, sf, "customer", "c_custkey", "src").withColumn("score", F.pmod(F.col("src") * 37, F.lit(1000)) / 1000.0).drop("z")
    known = positions(spark, sf, "supplier", "s_suppkey", "known").drop("z")
    best = spatial.nearest(known, sc, RADIUS, "known", "src")
    levels = spark.sql("SELECT * FROM VALUES (0.25D), (0.5D), (0.75D) AS t(threshold)")
    return best.crossJoin(F.broadcast(levels)).groupBy("threshold").agg(F.count(F.lit(1)).alias("n_known"), F.count("score").alias("n_matched"), F.count_if(F.col("score") >= F.col("threshold")).alias("n_recovered"))


# --- sets and dedup ----------------------------------------------------------------------

REG = """reg AS (SELECT 'customer' AS catalogue, 'N' || c_nationkey AS canonical_id, 2 AS tier, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', 'N' || s_nationkey, 1, s_suppkey FROM supplier UNION ALL SELECT 'part', 'N' || (p_size + 10), 3, p_partkey FROM part)"""


def _registry(spark, sf) -> DataFrame:
    def one(name: str, key: str, canon: Column, tier: int) -> DataFrame:
        return table(spark, sf, name).select(F.lit(name).alias("catalogue"), F.concat(F.lit("N"), canon).alias("canonical_id"), F.lit(tier).alias("tier"), F.col(key).alias("id"))

    return one("customer", "c_custkey", F.col("c_nationkey"), 2).unionByName(one("supplier", "s_suppkey", F.col("s_nationkey"), 1)).unionByName(one("part", "p_partkey", F.col("p_size") + 10, 3))


@query(f"WITH {REG} SELECT catalogue, count(*) AS n, count(DISTINCT canonical_id) AS ids FROM reg GROUP BY catalogue")
def registry_union(spark, sf):
    return _registry(spark, sf).groupBy("catalogue").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("canonical_id").alias("ids"))


@query(f"WITH {REG} SELECT canonical_id, catalogue, tier, id FROM reg QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY tier, id) = 1")
def ranked_keep_first(spark, sf):
    return dedup.ranked_first(_registry(spark, sf), ["canonical_id"], ["tier", "id"]).select("canonical_id", "catalogue", "tier", "id")


@query(f"WITH {REG}, p AS (SELECT canonical_id, count(*) FILTER (catalogue = 'customer') AS customer, count(*) FILTER (catalogue = 'part') AS part, count(*) FILTER (catalogue = 'supplier') AS supplier FROM reg GROUP BY canonical_id) SELECT * FROM p")
def crosstab_pivot(spark, sf):
    return _registry(spark, sf).groupBy("canonical_id").pivot("catalogue", ["customer", "part", "supplier"]).count().fillna(0)


@query("WITH x AS (SELECT c_custkey AS id, 'S' || (c_custkey % 100) AS name, round((c_custkey % 7) / 3.0::DOUBLE, 2) AS ra, round((c_custkey % 5) / 3.0::DOUBLE, 2) AS dec FROM customer) SELECT name, ra, dec, min(id) AS id FROM x GROUP BY ALL")
def rounded_coord_distinct(spark, sf):
    k = F.col("c_custkey")
    x = table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("S"), k % 100).alias("name"), ((k % 7) / 3.0).alias("ra"), ((k % 5) / 3.0).alias("dec"))
    return dedup.rounded_distinct(x, "name", digits=2).select("name", F.round("ra", 2).alias("ra"), F.round("dec", 2).alias("dec"), "id")


NEAR = f"{CATS}, e AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND {SEP_AB} <= 8)"


@query(f"WITH {NEAR} SELECT a, b FROM e")
def close_pairs(spark, sf):
    return spatial.pairs_within(positions(spark, sf, "supplier", "s_suppkey", "id"), 8.0, "id").select("a", "b")


@query(f"WITH {NEAR} SELECT id FROM s WHERE id NOT IN (SELECT b FROM e)")
def earlier_neighbour_dedup(spark, sf):
    return dedup.drop_later_neighbours(positions(spark, sf, "supplier", "s_suppkey", "id"), 8.0, "id").select("id")


@query(f"""WITH RECURSIVE {NEAR}, u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT id AS node, id AS spot FROM s UNION SELECT r.node, u.y FROM r JOIN u ON r.spot = u.x), g AS (SELECT node AS id, min(spot) AS root FROM r GROUP BY node)
SELECT g.id, g.root, (SELECT string_agg(h.id::VARCHAR, '|' ORDER BY h.id) FROM g h WHERE h.root = g.root) AS members FROM g""")
def components_dedup(spark, sf):
    s = positions(spark, sf, "supplier", "s_suppkey", "id")
    return dedup.member_lists(dedup.component_groups(s, 8.0, "id", ["id"]), "id").select("id", "root", "members")


@query()
def greedy_dedup(spark, sf):
    """Order-dependent: checked against brute force in the tests."""
    return dedup.greedy_keep_first(positions(spark, sf, "supplier", "s_suppkey", "id"), 8.0, "id").select("id")


@query(f"WITH {CATS} SELECT id, dec > 0 AS north, z FROM c", "z")
def healpix_cells(spark, sf):
    """Cells exist for all positions; their own check is in the tests."""
    c = positions(spark, sf, "customer", "c_custkey", "id").withColumn("cell", spatial.healpix_ring(F.col("ra"), F.col("dec")))
    return c.filter((F.col("cell") >= 0) & (F.col("cell") < 12 * 32 * 32)).select("id", (F.col("dec") > 0).alias("north"), "z")


@query("""WITH a AS (SELECT c_nationkey AS k, CASE WHEN c_custkey % 10 < 7 THEN 'train' WHEN c_custkey % 10 < 9 THEN 'dev' ELSE 'test' END AS part FROM customer), d AS (SELECT DISTINCT part, k FROM a)
SELECT x.part AS "left", y.part AS "right", count(*) AS n FROM d x JOIN d y ON x.k = y.k AND x.part < y.part GROUP BY ALL""")
def split_disjointness(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 10
    parts = {"train": c.filter(k < 7), "dev": c.filter((k >= 7) & (k < 9)), "test": c.filter(k >= 9)}
    return dedup.overlap(parts, "c_nationkey")


@query("""WITH x AS (SELECT c_custkey AS id, printf('%02d:%02d:%02d.5', c_custkey % 24, c_custkey % 60, c_custkey % 59) AS ra, printf('-%02d:%02d:%02d', c_custkey % 90, c_custkey % 60, c_custkey % 59) AS dec FROM customer)
SELECT id, (id % 24 + (id % 60) / 60.0::DOUBLE + (id % 59 + 0.5) / 3600.0::DOUBLE) * 15 AS ra, -(id % 90 + (id % 60) / 60.0::DOUBLE + (id % 59) / 3600.0::DOUBLE) + 0.0 AS dec FROM x""", "ra dec")
def sexagesimal_parse(spark, sf):
    k = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    ra = F.concat(two(k % 24), F.lit(":"), two(k % 60), F.lit(":"), two(k % 59), F.lit(".5"))
    dec = F.concat(F.lit("-"), two(k % 90), F.lit(" "), two(k % 60), F.lit(" "), two(k % 59))
    return table(spark, sf, "customer").select(k.alias("id"), sky.sexagesimal(ra, True).alias("ra"), sky.sexagesimal(dec).alias("dec"))


