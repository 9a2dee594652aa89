"""Queries over sources, sinks and benchmark assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import benchmark as bench
from ..sources import readers, sinks
from ..sources.store import shared_path
from .registry import query, table


def _results(spark, sf) -> DataFrame:
    """orders as a scores table, all text."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, " no_data").when(k % 11 == 0, "").otherwise("ok")
    return o.select(k.cast("string").alias("source_id"), F.concat(F.lit(" "), k.cast("string")).alias("canonical_id"), F.when(k % 5 == 0, "NaN").otherwise((k % 100 / 100.0).cast("string")).alias("score"), status.alias("status"), (k % 90).cast("string").alias("n_points"), (k % 4000).cast("string").alias("baseline_days"), F.when(k % 3 == 0, "W1,W2").when(k % 3 == 1, "W1_only").otherwise("").alias("band_coverage"))


RESULTS = """res AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 100 / 100.0::DOUBLE END AS score, CASE WHEN o_orderkey % 7 = 0 THEN 'NO_DATA' WHEN o_orderkey % 11 = 0 THEN 'UNKNOWN' ELSE 'OK' END AS status, (o_orderkey % 90)::INTEGER AS n_points, (o_orderkey % 4000)::DOUBLE / 365.25 AS years, o_orderkey % 3 AS c FROM orders)"""


@query(f"WITH {RESULTS} SELECT k::VARCHAR AS source_id, score, status, n_points, years AS baseline_years, CASE c WHEN 0 THEN 'W1,W2' WHEN 1 THEN 'W1_only' ELSE 'none' END AS band_coverage FROM res", "score baseline_years")
def results_coerced(spark, sf):
    """Written as text and read back through the reader."""
    path = shared_path(spark)
    _results(spark, sf).write.option("header", True).csv(path)
    return readers.read_results(spark, path).select("source_id", "score", "status", "n_points", "baseline_years", "band_coverage")


@query(f"WITH {RESULTS} SELECT k::VARCHAR AS source_id, status = 'OK' AS is_ok, c < 2 AS has_w1, c = 0 AS has_w2, coalesce(years >= 7 AND n_points >= 50 AND c = 0 AND status = 'OK', false) AS strict_quality, CASE status WHEN 'OK' THEN 'ok' WHEN 'NO_DATA' THEN 'no_data_other' ELSE 'unknown' END AS rejection_bucket FROM res")
def results_derived(spark, sf):
    d = readers.derived(readers.coerce_results(_results(spark, sf)))
    return d.select("source_id", "is_ok", "has_w1", "has_w2", "strict_quality", "rejection_bucket")


@query("SELECT n_name AS name, (n_nationkey * 1.5)::DOUBLE AS ra, (n_regionkey * 2.0)::DOUBLE AS dec FROM nation", "ra dec")
def object_json_decode(spark, sf):
    """Nations as one JSON object per region, keyed by name, decoded again."""
    n = table(spark, sf, "nation")
    cell = lambda c: F.array(F.struct(c.cast("string").alias("value")))
    docs = n.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(cell(F.col("n_nationkey") * 1.5).alias("ra"), cell(F.col("n_regionkey") * 2.0).alias("dec")))))).alias("doc"))
    e = docs.select(F.explode(readers.object_entries(F.col("doc"), ["ra", "dec"])).alias("e"))
    return e.select("e.name", F.col("e.ra").cast("double").alias("ra"), F.col("e.dec").cast("double").alias("dec"))


@query("SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier")
def service_json_decode(spark, sf):
    """Suppliers as table answers of a service, one per nation, decoded again."""
    s = table(spark, sf, "supplier")
    head = F.array(F.struct(F.lit("id").alias("name")), F.struct(F.lit("nation").alias("name")))
    docs = s.groupBy("s_nationkey").agg(F.to_json(F.struct(head.alias("metadata"), F.collect_list(F.array(F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"))).alias("data"))).alias("doc"))
    r = docs.select(F.explode(readers.service_rows(F.col("doc"))).alias("r"))
    return r.select(F.col("r")["id"].cast("long").alias("id"), F.col("r")["nation"].cast("int").alias("nation"))


@query("SELECT count(*) AS n, count(*) FILTER (c_custkey % 4 <> 0) AS todo FROM customer")
def resume_todo(spark, sf):
    c = table(spark, sf, "customer")
    done = c.filter("c_custkey % 4 = 0")
    return readers.unfinished(c, done, "c_custkey").agg(F.count(F.lit(1)).alias("todo")).crossJoin(c.agg(F.count(F.lit(1)).alias("n"))).select("n", "todo")


@query("""WITH r AS (SELECT sha256(c_custkey || chr(31) || c_mktsegment) AS h FROM customer)
SELECT count(*) AS n, concat_ws('-', sum(('0x' || substr(h, 1, 8))::BIGINT), sum(('0x' || substr(h, 9, 8))::BIGINT), sum(('0x' || substr(h, 17, 8))::BIGINT), sum(('0x' || substr(h, 25, 8))::BIGINT)) AS digest FROM r""")
def table_digest(spark, sf):
    return sinks.table_hash(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))


REG = """reg AS (SELECT c_custkey AS source_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'K' || (c_custkey % 400) END AS canonical_id, (c_custkey % 50)::DOUBLE AS ra, (c_custkey % 9)::DOUBLE AS dec,
c_custkey % 4 AS pv, c_custkey % 2 AS tier, c_custkey % 5 AS cf, ((c_custkey * 31) % 300)::DOUBLE / 100 AS z, c_mktsegment AS class FROM customer)"""


def _registry(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    return c.select(k.alias("source_id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("K"), k % 400)).alias("canonical_id"), (k % 50).cast("double").alias("ra"), (k % 9).cast("double").alias("dec"), pick(["LIT_STRONG", "LIT_WEAK", "CATALOG_STRONG", "CATALOG_WEAK"], k % 4).alias("provenance"), (k % 2).alias("tier"), pick(["gold", "silver", "bronze", "weak", "odd"], k % 5).alias("confidence"), (F.pmod(k * 31, F.lit(300)) / 100.0).alias("z"), F.col("c_mktsegment").alias("class"))


@query(f"WITH {REG} SELECT source_id FROM reg QUALIFY row_number() OVER (PARTITION BY CASE WHEN canonical_id = '' THEN 'COORD_' || ra || '_' || dec ELSE canonical_id END ORDER BY pv, tier, CASE WHEN cf = 4 THEN 9 ELSE cf END, source_id) = 1")
def registry_first(spark, sf):
    return bench.registry(_registry(spark, sf)).select("source_id")


@query(f"WITH {REG} SELECT CASE WHEN z >= 2 THEN 5 WHEN z >= 1 THEN 4 WHEN z >= 0.6 THEN 3 WHEN z >= 0.3 THEN 2 WHEN z >= 0.1 THEN 1 ELSE 0 END AS bin, class, count(*) AS n FROM reg GROUP BY ALL")
def stratified_counts(spark, sf):
    return _registry(spark, sf).groupBy(bench.z_bin(F.col("z")).alias("bin"), "class").agg(F.count(F.lit(1)).alias("n"))


CORE = f"""{REG}, el AS (SELECT * FROM reg WHERE z > 0.3), big AS (SELECT class FROM el GROUP BY class HAVING count(*) >= 20), pk AS (SELECT el.* FROM el JOIN big USING (class) QUALIFY row_number() OVER (PARTITION BY class ORDER BY md5('42:' || source_id), source_id) <= 40),
pp AS (SELECT source_id, class, (row_number() OVER (PARTITION BY class ORDER BY md5('42:' || source_id), source_id) - 1) / count(*) OVER (PARTITION BY class) AS p FROM pk), core AS (SELECT source_id, class, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'dev' ELSE 'test' END AS split FROM pp)"""


def _core(spark, sf) -> DataFrame:
    return bench.eval_core(_registry(spark, sf), "source_id", "class", F.col("z") > 0.3, 20, 40)


@query(f"WITH {CORE} SELECT * FROM core")
def eval_core(spark, sf):
    return _core(spark, sf).select("source_id", "class", "split")


@query(f"WITH {CORE} SELECT source_id FROM reg WHERE source_id NOT IN (SELECT source_id FROM core) ORDER BY md5('9:' || source_id), source_id LIMIT 100")
def discovery_pool(spark, sf):
    return bench.discovery_pool(_registry(spark, sf).select("source_id"), _core(spark, sf), "source_id", 100, 9)


@query("SELECT unnest(['disjoint', 'complete', 'classes_dev', 'classes_test', 'classes_train']) AS \"check\", true AS ok")
def split_checks(spark, sf):
    c = _core(spark, sf)
    return bench.check(c, {s: c.filter(F.col("split") == s) for s in ("train", "dev", "test")}, "source_id", "class")


@query(f"WITH {REG} SELECT 'registry' AS section, 'rows' AS metric, count(*)::DOUBLE AS value FROM reg UNION ALL SELECT 'registry', 'z_mean', avg(z) FROM reg UNION ALL SELECT 'registry', 'classes', count(DISTINCT class)::DOUBLE FROM reg", "value")
def quality_report(spark, sf):
    a = _registry(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.avg("z").alias("z_mean"), F.count_distinct("class").alias("classes"))
    return sinks.long_report(a, "registry")
