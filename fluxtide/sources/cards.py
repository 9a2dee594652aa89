"""Nested documents: one row per source with its epochs as an array of structs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_FIELDS = ("ra", "dec", "mjd", "w1mpro", "w1sigmpro", "w2mpro", "w2sigmpro", "qi_fact", "saa_sep")
CARD_SCHEMA = "source_id string, ra double, dec double, z double, label string, reference string, wise_epochs array<struct<" + ",".join(f"{f}:double" for f in EPOCH_FIELDS) + ",moon_masked:string>>, n_epochs int, built_from string, match_radius_arcsec double, built_at_utc string"


def build_cards(df: DataFrame, key: str, fields: list[str], epochs: str = "epochs") -> DataFrame:
    """One row per key: its rows sorted by the fields, NaN as null."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    cells = [F.nanvl(F.col(f), F.lit(None).cast(kinds[f])).alias(f) if kinds[f] in ("double", "float") else F.col(f) for f in fields]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cells))).alias(epochs)).withColumn(f"n_{epochs}", F.size(epochs))


def flatten_cards(cards: DataFrame, key: str, epochs: str = "epochs") -> DataFrame:
    return cards.select(key, F.explode(epochs).alias("_e")).select(key, "_e.*")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents with the fixed card schema, one per file or line."""
    return spark.read.schema(CARD_SCHEMA).json(path, multiLine=True)


def write_cards(cards: DataFrame, path: str, cell: str | None = None) -> None:
    """JSON lines, or Parquet by sky cell where one is named."""
    if cell:
        cards.repartition(F.col(cell)).write.partitionBy(cell).parquet(path)
    else:
        cards.write.json(path)
