"""Benchmark sources in their older forms: three tables, or JSON lists of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import conform

SCHEMA = {"source_id": "string", "ra": "double", "dec": "double", "label": "string", "label_source": "string", "label_method": "string", "independent_of_pipeline": "boolean", "notes": "string"}
MAGNITUDES = ("w1_mag", "w2_mag", "mag", "g_mag", "r_mag", "i_mag")


def _either(df: DataFrame, *names: str) -> Column:
    have = [n for n in names if n in df.columns]
    return F.col(have[0]).cast("string") if have else F.lit("")


def from_tables(known: DataFrame | None = None, contaminants: DataFrame | None = None, control: DataFrame | None = None) -> DataFrame:
    """Known objects, contaminants and controls as one table of labelled sources; tier 1 is
    spectroscopic.  Raises where no table is given."""
    parts = []
    for df, label, method, notes in (
        (known, F.lit("positive"), lambda d: F.when(_either(d, "tier") == "1", "spectroscopic").otherwise("photometric"), lambda d: _either(d, "transition_type") if "transition_type" in d.columns else F.lit("clagn")),
        (contaminants, None, lambda d: F.lit("catalog"), lambda d: _either(d, "notes")),
        (control, F.lit("control"), lambda d: F.lit("catalog"), lambda d: F.lit("")),
    ):
        if df is None:
            continue
        kind = label if label is not None else (_either(df, "contaminant_type") if "contaminant_type" in df.columns else F.lit("contaminant"))
        made = df.select(_either(df, "name", "source_id").alias("source_id"), "ra", "dec", kind.alias("label"), _either(df, "reference").alias("label_source"), method(df).alias("label_method"), F.lit(True).alias("independent_of_pipeline"), notes(df).alias("notes"))
        parts.append(conform(made, SCHEMA))
    if not parts:
        raise ValueError("no table of benchmark sources")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_sources(df: DataFrame) -> DataFrame:
    """Each (id, position to six places) once."""
    place = {"_ra": F.round(F.col("ra").try_cast("double"), 6), "_dec": F.round(F.col("dec").try_cast("double"), 6), "source_id": F.col("source_id").cast("string")}
    return df.withColumns(place).dropDuplicates(["source_id", "_ra", "_dec"]).drop("_ra", "_dec")


def is_reference(text: Column) -> Column:
    """A DOI, a word that says bibcode, or ten characters that begin with a year."""
    t = F.coalesce(text, F.lit(""))
    return t.contains("10.") | F.lower(t).contains("bibcode") | t.rlike(r"^\d{4}.{6,}")


def json_fields(text: Column, names: tuple[str, ...]) -> dict[str, Column]:
    """Fields of one JSON object as trimmed text, empty ones null."""
    parsed = F.from_json(text, ", ".join(f"`{n}` string" for n in names))
    return {n: F.nullif(F.trim(parsed[n]), F.lit("")) for n in names}


CONTAMINANT = ("source_id", "ra", "dec", "contaminant_type", "citation", "classification_method", "independent_of_pipeline", "notes", *MAGNITUDES, "redshift")
POSITIVE = ("source_id", "ra", "dec", "redshift", "spectroscopic_reference", "doi", "ads_bibcode", "label_method", "label_basis", "independent_of_pipeline", "spectral_state_1", "spectral_state_2", "epoch_1", "epoch_2", *MAGNITUDES)


def _numbers(f: dict[str, Column], names: tuple[str, ...]) -> list[Column]:
    return [f[n].try_cast("double").alias(n) for n in names]


def contaminants_from_json(objects: DataFrame, text: str) -> DataFrame:
    """Sources with ``error``, the first rule that the object breaks (null: none).  A caller keeps
    those without, or refuses the list; rows are checked where they are."""
    f = json_fields(F.col(text), CONTAMINANT)
    independent = F.coalesce(F.lower(f["independent_of_pipeline"]), F.lit("true")).isin("true", "1")
    error = F.when(f["source_id"].isNull() | f["ra"].isNull() | f["dec"].isNull(), "no id or position").when(f["contaminant_type"].isNull(), "no type").when(f["citation"].isNull(), "no citation").when(f["classification_method"].isNull(), "no method").when(~independent, "not independent")
    own = [f["source_id"].alias("source_id"), *_numbers(f, ("ra", "dec")), f["contaminant_type"].alias("class"), f["citation"].alias("label_source"), f["classification_method"].alias("label_method"), f["notes"].alias("notes")]
    return objects.select(*own, *_numbers(f, (*MAGNITUDES, "redshift")), error.alias("error"))


def positives_from_json(objects: DataFrame, text: str) -> DataFrame:
    """Spectroscopic positives with ``error``, the first rule that the object breaks."""
    f = json_fields(F.col(text), POSITIVE)
    reference, method, basis = F.coalesce(f["spectroscopic_reference"], f["doi"], f["ads_bibcode"]), F.lower(F.coalesce(f["label_method"], F.lit(""))), F.lower(F.coalesce(f["label_basis"], F.lit("")))
    independent = F.coalesce(F.lower(f["independent_of_pipeline"]), F.lit("true")).isin("true", "1")
    error = F.when(f["source_id"].isNull() | f["ra"].isNull() | f["dec"].isNull(), "no id or position").when(f["redshift"].isNull(), "no redshift").when(~is_reference(reference), "no reference").when((method != "") & (method != "spectroscopic"), "method is not spectroscopic").when(~independent, "not independent")
    error = error.when(basis.contains("wise") & ~basis.contains("spectro"), "label from photometry")
    for n in ("spectral_state_1", "spectral_state_2", "epoch_1", "epoch_2"):
        error = error.when(f[n].isNull(), f"no {n}")
    own = [f["source_id"].alias("source_id"), *_numbers(f, ("ra", "dec", "redshift")), *[f[n].alias(n) for n in ("spectral_state_1", "spectral_state_2", "epoch_1", "epoch_2")], F.lit("clagn").alias("class"), reference.alias("label_source")]
    return objects.select(*own, *_numbers(f, MAGNITUDES), error.alias("error"))


def refused(checked: DataFrame, least: int) -> None:
    """Raises where any object breaks a rule or fewer than ``least`` are left."""
    worst = checked.filter(F.col("error").isNotNull()).select("source_id", "error").limit(5).collect()
    if worst:
        raise ValueError("; ".join(f"{r['source_id']}: {r['error']}" for r in worst))
    n = checked.count()
    if n < least:
        raise ValueError(f"{n} sources, {least} needed")


def class_name(label: Column) -> Column:
    """One name for each kind of contaminant."""
    s = F.lower(F.trim(label.cast("string")))
    return F.when(s.isin("normal_agn", "agn"), "normal_agn").when(s.isin("sn_in_host", "supernova", "sn"), "sn").when(s.isin("variable_star", "star"), "star").otherwise(s)


def with_truth(df: DataFrame) -> DataFrame:
    """``class`` (from class, else label; "positive" is "clagn") and ``y_true``; raises where
    there is neither."""
    have = [c for c in ("class", "label") if c in df.columns]
    if not have:
        raise ValueError("neither class nor label")
    text = F.trim(F.col(have[0]).cast("string"))
    named = F.when(text == "positive", "clagn").otherwise(text)
    out = df.withColumn("class", named)
    if have == ["label"]:
        out = out.drop("label")
    return out.withColumn("y_true", F.coalesce(F.lower("class").isin("clagn", "positive"), F.lit(False)).cast("int"))
