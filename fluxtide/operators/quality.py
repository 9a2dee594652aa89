"""Quality filters: ordered reject cascades with accounting, coverage and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import P


def unpivot_bands(wide: DataFrame, keys: list[str], bands: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide to long: band -> (magnitude column, error column) give rows (keys, band, mag, mag_err)."""
    parts = ", ".join(f"'{b}', `{m}`, `{e}`" for b, (m, e) in bands.items())
    return wide.select(*keys, F.expr(f"stack({len(bands)}, {parts}) AS (band, mag, mag_err)"))


def pick_by_table(table: Column, early: Column, late: Column) -> Column:
    """The multi-epoch column for early tables, else the single-exposure one, each with the
    other as fallback."""
    return F.when(F.lower(table).contains("allwise"), F.coalesce(early, late)).otherwise(F.coalesce(late, early))


def flag_bad(flags: Column, band: str) -> Column:
    """The band's character of a packed flag string is not 0; missing is not bad."""
    place = {"W1": 1, "W2": 2, "W3": 3, "W4": 4}[band]
    c = F.substring(F.trim(flags), place, 1)
    return F.coalesce((c != "") & (c != "0"), F.lit(False))


def moon_bad(level: Column, band: str, least: int = 5) -> Column:
    """The band's digit reaches ``least``; a single character stands for all bands."""
    place = {"W1": 1, "W2": 2, "W3": 3, "W4": 4}[band]
    own = F.when(F.length(level) >= place, F.substring(level, place, 1)).otherwise(F.substring(level, 1, 1))
    return F.coalesce(own.try_cast("int") >= least, F.lit(False))


def moon_clean(level: Column) -> Column:
    return F.coalesce(F.trim(level).rlike("^0*$"), F.lit(True))


def reject_step(steps: list[tuple[str, Column]]) -> Column:
    """The first failing step's name; null if the row passes all."""
    found = F.lit(None).cast("string")
    for name, bad in reversed(steps):
        found = F.when(F.coalesce(bad, F.lit(False)), F.lit(name)).otherwise(found)
    return found


def cascade(df: DataFrame, steps: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reject_step)."""
    marked = df.withColumn("reject_step", reject_step(steps))
    return marked.filter("reject_step IS NULL").drop("reject_step"), marked.filter("reject_step IS NOT NULL")


def accounting(df: DataFrame, keys: list[str], steps: list[tuple[str, Column]]) -> DataFrame:
    """Per key: raw, kept, fraction_rejected and the count of each step, in one pass."""
    marked = df.withColumn("reject_step", reject_step(steps))
    counts = [F.count_if(F.col("reject_step") == n).alias(f"n_{n}") for n, _ in steps]
    out = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("reject_step").isNull()).alias("kept"), *counts)
    return out.withColumn("fraction_rejected", (F.col("raw") - F.col("kept")) / F.col("raw"))


def main_causes(counts: DataFrame, names: list[str], top: int = 3) -> Column:
    """The most frequent steps as text, most first, ties by name."""
    pairs = F.filter(F.array(*[F.struct((-F.col(f"n_{n}")).alias("n"), F.lit(n).alias("name")) for n in names]), lambda s: s["n"] < 0)
    return F.concat_ws(", ", F.transform(F.slice(F.array_sort(pairs), 1, top), lambda s: F.concat(s["name"], F.lit("="), (-s["n"]).cast("string"))))


def value_frequencies(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """Per column its most frequent values with count and fraction; nulls count as a value."""
    parts = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    long = df.select(F.expr(f"stack({len(columns)}, {parts}) AS (column, value)"))
    counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    whole = Window.partitionBy("column")
    return counted.withColumn("fraction", F.col("n") / F.sum("n").over(whole)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def coverage(df: DataFrame, keys: list[str], before: float = P.gap_before_mjd, after: float = P.gap_after_mjd, time: str = "mjd") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.col(time) < before).alias("has_before"), F.max(F.col(time) > after).alias("has_after"))


def baseline(df: DataFrame, keys: list[str], before: float, after: float, min_years: float = P.min_baseline_years, min_epochs: int = P.min_epochs, min_side: int = P.min_epochs_side, time: str = "mjd") -> DataFrame:
    """Counts and the first failing rule: epochs, baseline, either side of the gap."""
    t = F.col(time)
    out = df.groupBy(*keys).agg(F.count(t).alias("n"), ((F.max(t) - F.min(t)) / P.days_per_year).alias("baseline_years"), F.count_if(t < before).alias("n_pre"), F.count_if(t > after).alias("n_post"))
    reason = F.when(F.col("n") < min_epochs, "insufficient epochs").when(F.col("baseline_years") < min_years, "short baseline").when(F.col("n_pre") < min_side, "few before gap").when(F.col("n_post") < min_side, "few after gap")
    return out.withColumn("reason", reason)


def systematics_verdict(raw: Column, kept: Column, seasons1: Column, seasons2: Column, both_sides: Column) -> tuple[Column, Column]:
    """(verdict, reasons): FAIL on few points or seasons; CAUTION on heavy rejection, one-sided
    coverage or a missing band; else PASS.  All reasons are listed."""
    few, thin = kept < 10, seasons1 + seasons2 < 3
    heavy = (raw > 0) & ((raw - kept) / raw > 0.5)
    lone = (seasons1 == 0) | (seasons2 == 0)
    reasons = F.array_compact(F.array(F.when(few, "few_points"), F.when(thin, "few_seasons"), F.when(heavy, "heavy_rejection"), F.when(~both_sides, "one_sided_coverage"), F.when(lone, "missing_band")))
    return F.when(few | thin, "FAIL").when(heavy | ~both_sides | lone, "CAUTION").otherwise("PASS"), F.concat_ws(";", reasons)


def required(df: DataFrame, columns: list[str]) -> None:
    """Raises if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each rule (null counts as broken)."""
    return df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def leakage(columns: list[str], forbidden: tuple[str, ...] = ("score", "delta_mag", "prediction")) -> list[str]:
    return [c for c in columns if any(f in c.lower() for f in forbidden)]
