"""The registered queries of the subpackage and their SQL, where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, lines, merkle, pareto, periods, pii, pst, repetition, simhash, suffix, tokens, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(table(spark, sf_dir, "documents"))


def op2_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_spans(table(spark, sf_dir, "documents")))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shared = suffix.shared_runs(docs).withColumnRenamed("doc_id", "of")
    kept = suffix.remove_repeats(docs, digest=True)
    return kept.join(shared, kept["doc_id"].eqNullSafe(shared["of"]), "left").drop("of").fillna(0, ["n_shared_runs"])


def op5_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_lines(docs, min_docs=10, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.train(spark)).drop("block_probability")


def op9_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_signals(table(spark, sf_dir, "documents"))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.mix(table(spark, sf_dir, "documents")).drop("copies", "chance")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proved = merkle.manifest(docs, tampered={"text": merkle.lower_ascii(F.col("text"))}, where=third)
    return merkle.verify(proved).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(table(spark, sf_dir, "documents"), change=periods.planted)


def op13_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree_score": op1_suffix_tree_score,
    "op2_crf_pii": op2_crf_pii,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_suffix_repeats": op4_suffix_repeats,
    "op5_viterbi_counts": op5_viterbi_counts,
    "op6_bloom_lines": op6_bloom_lines,
    "op7_latent_leaks": op7_latent_leaks,
    "op8_url_filter": op8_url_filter,
    "op9_repetition_coverage": op9_repetition_coverage,
    "op10_pareto_mix": op10_pareto_mix,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_recompression_runs": op12_recompression_runs,
    "op13_exact_groups": op13_exact_groups,
}

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP6_SQL = f"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS place FROM split
), keyed AS (
    SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), bad AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(bad.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN bad USING (key) GROUP BY doc_id
"""

OP10_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
           row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM sized GROUP BY source
), capped AS (
    SELECT *, (3 * source_size)::DOUBLE AS cap, sum(source_size) OVER () AS everything FROM sources
), levels AS (
    SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM capped
), plan AS (
    SELECT source, source_size, least(cap, (SELECT arg_min(level, (cap / weight, place)) FROM levels WHERE level <= cap / weight) * weight) AS target FROM levels
), rated AS (
    SELECT *, floor(ratio) AS certain, (ratio - floor(ratio)) * source_size AS wanted
    FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM plan)
), stepped AS (
    SELECT *, size - size % (1::BIGINT << greatest(0, length(bin(size)) - 6)) AS step FROM sized
), classes AS (
    SELECT s.source, s.step, sqrt(s.step) AS root, sum(s.size)::BIGINT AS words, any_value(r.wanted) AS wanted
    FROM stepped s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source WHERE s.step > 0 GROUP BY s.source, s.step
), scales AS (
    SELECT *, (wanted - (sum(words) OVER (PARTITION BY source ORDER BY step DESC) - words))
              / sum(words * root) OVER (PARTITION BY source ORDER BY step) AS scale
    FROM classes
), fitting AS (
    SELECT source, arg_max(scale, step) AS scale FROM scales WHERE scale * root <= 1.0 GROUP BY source
), chances AS (
    SELECT c.source, c.step, least(1.0, coalesce(f.scale, 1.0) * c.root) AS p
    FROM classes c LEFT JOIN fitting f ON c.source IS NOT DISTINCT FROM f.source
), joined AS (
    SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.certain, r.wanted, coalesce(c.p, 0.0) AS p,
           CASE WHEN c.p > 0 THEN (s.u * (1.0 - c.p)) / (s.u * (1.0 - c.p) + (1.0 - s.u) * c.p) ELSE 1.0 END AS place
    FROM stepped s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
         LEFT JOIN chances c ON s.source IS NOT DISTINCT FROM c.source AND s.step = c.step
), first AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id::VARCHAR, size) <= wanted AS fits
    FROM joined WHERE size > 0 AND p > 0 AND wanted > 0
), gaps AS (
    SELECT source, any_value(wanted) - coalesce(sum(size) FILTER (WHERE fits), 0) AS gap FROM first GROUP BY source
), second AS (
    SELECT f.doc_id, sum(f.size) OVER (PARTITION BY f.source ORDER BY f.place, f.doc_id::VARCHAR, f.size) - f.size / 2.0 <= g.gap AS fits
    FROM first f JOIN gaps g ON f.source IS NOT DISTINCT FROM g.source WHERE NOT f.fits AND f.size <= g.gap
), extra AS (
    SELECT doc_id FROM first WHERE fits UNION ALL SELECT doc_id FROM second WHERE fits
)
SELECT j.doc_id, j.source, j.size, j.source_size, j.target,
       (CASE WHEN j.size > 0 THEN j.certain + (e.doc_id IS NOT NULL)::INT ELSE 0 END * j.size)::BIGINT AS taken
FROM joined j LEFT JOIN extra e ON j.doc_id = e.doc_id
"""

# Unsigned CRC-32 of a decimal id: the bits fold in a list of bytes and, after each, eight steps.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({x}) + 1),
    lambda i: list_concat([ord(substr({x}, i::INT, 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""


def _merkle_sql(deep: int = 8) -> str:
    """Levels written out, for up to 8^deep documents a language and languages."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    third = f"CASE WHEN doc_id IS NULL THEN false ELSE {_CRC.format(x='doc_id::VARCHAR')} % 3 = 0 END"

    def levels(name: str, start: str) -> str:
        out = [f"{name}0 AS MATERIALIZED ({start})"]
        for k in range(deep):
            out.append(f"{name}{k}r AS MATERIALIZED (SELECT tree, pos // 8 AS pos, count(*) AS here, string_agg(d, '' ORDER BY pos) AS run FROM {name}{k} GROUP BY tree, pos // 8)")
            out.append(f"{name}{k}n AS MATERIALIZED (SELECT tree, count(*) AS n FROM {name}{k} GROUP BY tree)")
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT r.tree, r.pos, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS d FROM {name}{k}r r JOIN {name}{k}n c USING (tree))")
        return ", ".join(out)

    def climb(name: str, of: str, prefix: str) -> str:
        out = []
        for k in range(deep):
            own = f"(p.pos // {8**k}) % 8"
            left, right = f"substr(run, 1, 64 * ({own}))", f"substr(run, 64 * ({own} + 1) + 1)"
            out.append(f"{prefix}{k} AS (SELECT p.* REPLACE (CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, CASE WHEN n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded) FROM {of} p JOIN {name}{k}r r ON r.tree = p.tree AND r.pos = p.pos // {8 ** (k + 1)} JOIN {name}{k}n c ON c.tree = p.tree)")
            of = f"{prefix}{k}"
        return ", ".join(out)

    return f"""WITH base AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {third} THEN {leaf(low)} END AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM base),
{levels('a', 'SELECT tree, pos, leaf AS d FROM placed')},
{levels('b', f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, d FROM a{deep}")},
start AS (SELECT *, '' AS proof, coalesce(tampered, leaf) AS folded FROM placed), {climb('a', 'start', 'up')},
tops AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM a{deep}),
higher AS (SELECT u.doc_id, u.leaf, u.proof, u.folded, t.subroot, t.place AS pos, '' AS tree FROM up{deep - 1} u JOIN tops t USING (tree)), {climb('b', 'higher', 'top')}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified FROM top{deep - 1}, (SELECT d FROM b{deep})"""


OP11_SQL = _merkle_sql()

OP13_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""

ORACLE_SQL: dict[str, str] = {
    "op6_bloom_lines": OP6_SQL,
    "op10_pareto_mix": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_exact_groups": OP13_SQL,
}
