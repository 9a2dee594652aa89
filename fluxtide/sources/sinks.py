"""Writers and what is recorded beside a written table."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """Doubles rounded; as many files as partitions."""
    df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def write_split(df: DataFrame, path: str, by: str) -> None:
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_text_atomic(path: str, text: str) -> None:
    """A report on the driver: written beside, then renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


def write_json(path: str, payload: dict) -> None:
    write_text_atomic(path, json.dumps(payload, sort_keys=True, indent=2, default=str) + "\n")


def table_hash(df: DataFrame) -> DataFrame:
    """(n, digest): the same for any order of rows and partitions: rows' sha2 prefixes added
    as whole numbers."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", part(0), part(1), part(2), part(3)).alias("digest"))


def provenance(df: DataFrame, settings: dict) -> dict:
    """What a sidecar records of a table."""
    row = table_hash(df).first()
    return {"rows": row["n"], "digest": row["digest"], "columns": df.columns, "settings": settings, "written": datetime.now(UTC).isoformat(timespec="seconds")}


def long_report(df: DataFrame, section: str) -> DataFrame:
    """A one-row table of numbers as (section, metric, value)."""
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in df.columns)
    return df.select(F.lit(section).alias("section"), F.expr(f"stack({len(df.columns)}, {parts}) AS (metric, value)"))
