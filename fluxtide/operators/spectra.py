"""Emission lines in spectra held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_flux(df: DataFrame, key: str, wave: str, flux: str, continuum: list[tuple[float, float]], line: tuple[float, float], least: int = 5) -> DataFrame:
    """Per spectrum: a straight continuum through the windows, the line's integral above it
    (trapezoids over the line window) and its equivalent width; null where a window has
    fewer than ``least`` samples."""
    s = df.select(key, F.explode(F.arrays_zip(F.col(wave).alias("w"), F.col(flux).alias("f"))).alias("p")).select(key, F.col("p.w").cast("double").alias("w"), F.col("p.f").cast("double").alias("f"))
    inside: Column = F.lit(False)
    for a, b in continuum:
        inside = inside | F.col("w").between(a, b)
    on = F.col("w").between(*line)
    c = s.groupBy(key).agg(F.regr_slope(F.when(inside, F.col("f")), F.when(inside, F.col("w"))).alias("slope"), F.regr_intercept(F.when(inside, F.col("f")), F.when(inside, F.col("w"))).alias("level"), F.count_if(inside).alias("n_continuum"), F.count_if(on).alias("n_line"), F.array_sort(F.collect_list(F.when(on, F.struct("w", "f")))).alias("line"))
    base = lambda w: F.col("level") + F.col("slope") * w
    steps = F.zip_with(F.slice("line", F.lit(1), F.greatest(F.size("line") - 1, F.lit(0))), F.slice("line", F.lit(2), F.greatest(F.size("line") - 1, F.lit(0))), lambda a, b: struct_step(a, b, base))
    c = c.withColumn("steps", F.when((F.col("n_continuum") >= least) & (F.col("n_line") >= least), steps))
    total = lambda n: F.aggregate("steps", F.lit(0.0), lambda acc, x: acc + x[n])
    return c.select(key, "n_continuum", "n_line", total("flux").alias("flux"), total("width").alias("width"))


def struct_step(a: Column, b: Column, base) -> Column:
    dw = b["w"] - a["w"]
    above = (a["f"] - base(a["w"]) + b["f"] - base(b["w"])) / 2.0
    ratio = (F.try_divide(a["f"], base(a["w"])) + F.try_divide(b["f"], base(b["w"]))) / 2.0 - 1.0
    return F.struct((above * dw).alias("flux"), (ratio * dw).alias("width"))
