"""The batch session and bin operators over streams.  (An addition: the batch pipeline that
this library follows reads no streams.)"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stats(stream: DataFrame, key: str, time: str, value: str, gap: str, late: str) -> DataFrame:
    """Gap sessions per key, closed when the watermark passes: n, mean, first and last time."""
    s = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key)
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(time).alias("first"), F.max(time).alias("last")).select(key, "n", "mean", "first", "last")


def bin_stats(stream: DataFrame, key: str, time: str, value: str, width: str, late: str) -> DataFrame:
    """Fixed bins per key."""
    s = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("bin"), key)
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(key, F.col("bin.start").alias("start"), "n", "mean")
