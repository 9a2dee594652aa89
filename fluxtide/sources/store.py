"""Written intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir.  Where the session has none, a temporary folder
    serves a local session; a cluster's executors do not share one, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fluxtide-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table: lineage ends here, and lost executors recompute nothing."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, column: str) -> DataFrame:
    """As ``materialise``, in buckets of the column: what groups or joins by it reads the table
    without a shuffle.  The catalogue's entry goes at once, the files stay."""
    spark, name = df.sparkSession, f"table_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("compression", "zstd").saveAsTable(name, format="parquet", path=shared_path(spark))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
