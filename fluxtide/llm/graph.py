"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import written


def _open(edges: DataFrame) -> bool:
    """Whether a node has two lower neighbours, or a lower and a higher one: no stars yet."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 OR up = 1 AND down = 1").agg(F.count(F.lit(1))).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, root): the smallest node reachable, for every node that has an edge
    and is not its own root.  Each round is written to the shared folder; rounds grow with the
    logarithm of the longest path, and edges that are stars already take none.  The smallest neighbour is a combined aggregate, so a node
    with very many neighbours costs one row a task; the join back can be split by AQE."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while _open(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v"))).distinct()
        now = written(small)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
