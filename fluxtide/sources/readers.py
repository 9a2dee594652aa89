"""Readers of files as they come: text tables, JSON documents, cached service answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import NA_TOKENS, number

RESULT_COLUMNS = {"source_id": "string", "canonical_id": "string", "score": "double", "status": "string", "n_points": "int", "baseline_days": "double", "band_coverage": "string"}


def read_text_table(spark: SparkSession, path: str, sep: str = ",", comment: str | None = None) -> DataFrame:
    """All columns as trimmed strings, missing-value words as null."""
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("multiLine", False)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    df = df.withColumnsRenamed({c: c.strip() for c in df.columns})
    return df.select(*[F.when(~F.trim(c).isin(*NA_TOKENS), F.trim(c)).alias(c) for c in df.columns])


def sniff_separator(first_line: str) -> str:
    """Tab, bar or comma by what the header holds, else blanks."""
    return next((s for s in ("\t", "|", ",") if s in first_line), " ")


def read_loose(spark: SparkSession, path: str) -> DataFrame:
    """A text table whose separator is told by its first line that is no comment."""
    first = spark.read.text(path).filter(~F.col("value").startswith("#")).first()
    return read_text_table(spark, path, sniff_separator(first["value"] if first else ""), "#")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return coerce_results(read_text_table(spark, path))


def coerce_results(df: DataFrame) -> DataFrame:
    """The scores table typed: status upper-cased or UNKNOWN, blank coverage as none, number
    of points rounded, years from days where missing.  Raises on missing columns."""
    missing = [c for c in RESULT_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    status = F.upper(F.trim("status"))
    out = df.withColumns({"score": number(F.col("score")), "status": F.when(status.isNull() | (status == ""), "UNKNOWN").otherwise(status), "n_points": F.bround(number(F.col("n_points"))).cast("int"), "baseline_days": number(F.col("baseline_days")), "band_coverage": F.coalesce(F.nullif(F.trim("band_coverage"), F.lit("")), F.lit("none"))})
    years = F.col("baseline_days") / 365.25
    return out.withColumn("baseline_years", F.coalesce(number(F.col("baseline_years")), years) if "baseline_years" in df.columns else years)


def derived(df: DataFrame) -> DataFrame:
    """Audit columns of a typed scores table."""
    from ..functions import ids

    w1, w2 = ids.bands(F.col("band_coverage"))
    reason = F.col("rejection_reason") if "rejection_reason" in df.columns else F.lit(None).cast("string")
    years = F.col("baseline_days") / 365.25
    ok = F.col("status") == "OK"
    return df.withColumns({
        "baseline_years_recomputed": years,
        "baseline_years_consistent": F.abs(F.col("baseline_years") - years) <= 0.01,
        "is_ok": ok,
        "source_id_normalized": ids.canonical(F.col("source_id")),
        "source_id_matches_canonical": ids.canonical(F.col("source_id")) == F.trim("canonical_id"),
        "id_mismatch_reason": ids.mismatch(F.col("source_id"), F.col("canonical_id")),
        "is_ambiguous_id": ids.is_ambiguous_in_audit(F.col("source_id")),
        "has_w1": w1,
        "has_w2": w2,
        "strict_quality": F.coalesce((years >= 7.0) & (F.col("n_points") >= 50) & w1 & w2 & ok, F.lit(False)),
        "score_is_finite": F.col("score").isNotNull(),
        "rejection_reason": reason,
        "rejection_bucket": ids.rejection_bucket(F.col("status"), reason),
    })


def read_schema_dir(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """The union of those text tables that have all required columns."""
    parts = [t for t in (read_text_table(spark, p) for p in paths) if set(required) <= set(t.columns)]
    if not parts:
        raise ValueError("no table has the required columns")
    out = parts[0].select(required)
    for part in parts[1:]:
        out = out.unionByName(part.select(required))
    return out


def object_entries(text: Column, fields: list[str]) -> Column:
    """A JSON object keyed by name, whose fields are lists of {value}: array of
    struct(name, fields), each the first value; rows are exploded by the caller."""
    inner = ",".join(f"`{f}`:array<struct<value:string>>" for f in fields)
    entries = F.map_entries(F.from_json(text, f"map<string,struct<{inner}>>"))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), *[F.get(e["value"][f], F.lit(0))["value"].alias(f) for f in fields]))


def service_rows(text: Column) -> Column:
    """A table answer as {"metadata": [{"name"}], "data": [[...]]}: array of name -> value."""
    parsed = F.from_json(text, "struct<metadata:array<struct<name:string>>,data:array<array<string>>>")
    names = F.transform(parsed["metadata"], lambda m: m["name"])
    return F.transform(parsed["data"], lambda row: F.map_from_arrays(names, row))


def conform(df: DataFrame, wanted: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Exactly the wanted columns, cast; missing ones by default or null."""
    given = defaults or {}
    return df.select(*[(F.coalesce(F.col(c).try_cast(t), F.lit(given.get(c)).cast(t)) if c in df.columns else F.lit(given.get(c)).cast(t)).alias(c) for c, t in wanted.items()])


def available(df: DataFrame, wanted: list[str], least: list[str]) -> tuple[DataFrame, str]:
    """The wanted columns if there, else the least set filled with nulls; and which it was."""
    have = set(df.columns)
    if set(wanted) <= have:
        return df.select(wanted), "full"
    missing = [c for c in least if c not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in wanted]), "minimal"


def unfinished(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: what has no result yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
