"""Identifier hygiene as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMBIGUOUS_PREFIXES = ("PKS", "PG", "HS", "B2")
AUDIT_AMBIGUOUS = ("PKS", "PG", "MR", "HS", "B2")
NA_TOKENS = ("", " ", "NA", "NaN", "nan", "NULL", "null", "None")


def _catalogue_names(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)^NGC\s*(\d+)$", "NGC $1")
    c = F.regexp_replace(c, r"(?i)^MRK\s*(\d+)$", "Mrk $1")
    return F.regexp_replace(c, r"(?i)^IC\s*(\d+)$", "IC $1")


def canonical(source_id: Column) -> Column:
    """Trimmed; digits stay; doubled survey letters and spacing of catalogue names mended."""
    c = F.coalesce(F.trim(source_id.cast("string")), F.lit(""))
    return F.when(c.rlike(r"^\d+$"), c).otherwise(_catalogue_names(F.regexp_replace(c, "^SDSSJ{2,}", "SDSSJ")))


def normalised(value: Column) -> Column:
    """As :func:`canonical`, ignoring case, blanks collapsed, NaN as empty."""
    c = F.coalesce(F.trim(value.cast("string")), F.lit(""))
    c = F.when(F.lower(c) == "nan", F.lit("")).otherwise(c)
    return F.when(c.rlike(r"^\d+$"), c).otherwise(F.regexp_replace(_catalogue_names(F.regexp_replace(c, "(?i)^SDSSJ{2,}", "SDSSJ")), r"\s+", " "))


def token(value: Column) -> Column:
    return F.upper(normalised(value))


def is_ambiguous(canonical_id: Column) -> Column:
    return canonical_id.isin(*AMBIGUOUS_PREFIXES) | canonical_id.rlike("^[A-Za-z]{1,3}$")


def is_ambiguous_in_audit(source_id: Column) -> Column:
    return canonical(source_id).isin(*AUDIT_AMBIGUOUS)


def mismatch(source_id: Column, canonical_id: Column) -> Column:
    raw, canon = F.coalesce(F.trim(source_id.cast("string")), F.lit("")), F.coalesce(F.trim(canonical_id.cast("string")), F.lit(""))
    norm = canonical(source_id)
    return F.when((canon == "") | (norm != canon), "other_mismatch").when(raw.rlike("^SDSSJ{2,}"), "sdss_double_j").when(raw != norm, "spacing_normalized")


def file_name(text: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._+-]+", "_"), 1, most)


def number(text: Column) -> Column:
    """Double of a written number; null for anything else, NaN included."""
    c = F.trim(text.cast("string"))
    return F.when(~c.isin(*NA_TOKENS), F.nullif(c.try_cast("double"), F.lit(float("nan"))))


def bands(coverage: Column) -> tuple[Column, Column]:
    parts = F.transform(F.split(F.upper(F.coalesce(coverage, F.lit(""))), ","), lambda x: F.trim(x))
    has = lambda b: F.array_contains(parts, b) | F.array_contains(parts, f"{b}_ONLY")
    return has("W1"), has("W2")


def rejection_bucket(status: Column, reason: Column) -> Column:
    st, rr = F.upper(F.trim(F.coalesce(status, F.lit("")))), F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    none = F.when(rr.contains("allwise"), "missing_allwise").when(rr.contains("neowise"), "missing_neowise").when(rr.contains("no data"), "no_data").otherwise("no_data_other")
    few = F.when(rr.contains("epoch") | rr.contains("insufficient"), "few_epochs").when(rr.contains("baseline") | rr.contains("yr <"), "short_baseline").otherwise("too_few_points_other")
    return F.when(st == "OK", "ok").when(st == "NO_DATA", none).when(st == "TOO_FEW_POINTS", few).when(st == "ERROR", "error").when(st == "NAME_RESOLVE_FAIL", "name_resolve_fail").otherwise("unknown")
