"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weighted share of all words, at most ``max_repeat`` times what the
source holds; what stands above is shared again by weight.  Of target / size, the whole part
is given to every document as certain copies.  The rest is an order sample with unequal
probabilities: a document's inclusion probability grows as the root of its size (of its first
six binary digits, so that a source has few classes), is cut at one, and is scaled so that the
expected words fill the rest.  Its rank is its random odds over its inclusion odds,
u/(1-u) : p/(1-p); documents are taken in rank order.

The sample's size is fixed in words: ranks are taken up to the last that fits, and the gap that
is left goes, in rank order again, to documents no larger than it.  So one very long document
near the limit does not make a source miss its target; the gap is a part of that document at most.

Ranks are mapped to (0, 1) and cut into ``buckets``: sums per bucket find the one in which the
limit falls, near the middle by construction, and only its rows are ordered.  What comes of it
is one limit a source, so rows meet their source's line and nothing else.

Defined cases: a null text has size 0; null sources form one source, last in order; rows of
size 0 are never taken; ties of rank go by id, then size, and rows alike in source, id and size
are taken together or not at all; an empty table gives an empty table; other columns are
ignored.  u comes from md5 of the id: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def uniform(id_col: Column) -> Column:
    """A number in (0, 1) from the id: 52 bits of its md5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).  One row per source only."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % n + 1).cast("int"))
    rows = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open_weight", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("open_weight"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))
    rows = rows.withColumn("share", F.min(fits).over(everything)["level"])
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("share") * F.col("weight"), F.col("cap"))).alias("target"))


def inclusion(classes: DataFrame) -> DataFrame:
    """(key, step, words, wanted), one row a class of sizes -> (key, step, p): the chance of a
    document of each class, min(1, c * root of the step), with c such that the expected words
    are those wanted.  Classes from the largest on are certain until c fits those left."""
    down, up = Window.partitionBy("key").orderBy(F.desc("step")), Window.partitionBy("key").orderBy("step")
    rows = classes.withColumn("root", F.sqrt("step"))
    rows = rows.withColumn("sure", (F.sum("words").over(down) - F.col("words")).cast("double"))
    rows = rows.withColumn("scale", (F.col("wanted") - F.col("sure")) / F.sum(F.col("words") * F.col("root")).over(up))
    fits = F.when(F.col("scale") * F.col("root") <= 1.0, F.struct("step", "scale"))
    scale = F.max(fits).over(Window.partitionBy("key"))["scale"]
    return rows.select("key", "step", F.least(F.lit(1.0), F.coalesce(scale, F.lit(1.0)) * F.col("root")).alias("p"))


def _limit(rows: DataFrame, wanted: DataFrame, by_middle: bool) -> DataFrame:
    """(key, at): the last of the rows (key, bucket, order, size) that fits into the wanted
    words of its source, in rank order; ``by_middle``: the nearest one instead."""
    cells = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    cells = cells.withColumn("before", F.sum("words").over(Window.partitionBy("key").orderBy("bucket")) - F.col("words")).join(wanted, "key")
    some = cells.filter(F.col("before") <= F.col("wanted")).groupBy("key").agg(F.max(F.struct("bucket", "before", "wanted")).alias("edge")).select("key", "edge.*")
    # The rows of the edge's bucket, and one limit for the buckets before it.
    inside = rows.join(some, ["key", "bucket"])
    ends = F.col("before") + F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("order"))
    fits = (ends - F.col("size") / 2.0 if by_middle else ends) <= F.col("wanted")
    inside = inside.withColumn("fits", fits).filter("fits").groupBy("key").agg(F.max("order").alias("at"))
    return some.select("key", "bucket").join(inside, "key", "left")


def _within(limit: str) -> Column:
    """Whether a row comes before the limit or is it."""
    return F.coalesce((F.col("bucket") < F.col(f"{limit}.bucket")) | ((F.col("bucket") == F.col(f"{limit}.bucket")) & (F.col("order") <= F.col(f"{limit}.at"))), F.lit(False))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, chance (of the copy beyond
    the certain ones), copies, taken."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    # Null-safe equi-keys: a null source has the key null, all others their own in brackets.
    key = F.coalesce(F.concat(F.lit("["), F.col("source").cast("string"), F.lit("]")), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), uniform(F.col(id_col)).alias("u"))
    step = F.expr("size - size % shiftleft(1L, greatest(0, length(bin(size)) - 6))")
    rows = written(rows.withColumn("key", key).withColumn("step", step))

    classes = written(rows.groupBy("key", "step").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    sums = classes.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = source_targets(sums.select("source", "source_size"), weights, max_repeat).withColumn("key", key).withColumn("ratio", ratio)
    plan = written(plan.select("key", "source_size", "target", F.floor("ratio").alias("certain"), ((F.col("ratio") - F.floor("ratio")) * F.col("source_size")).alias("wanted")))
    chances = inclusion(classes.filter("step > 0").join(plan.select("key", "wanted"), "key").select("key", "step", "words", "wanted"))

    # Rank q = odds / inclusion odds, as q / (1 + q); certain documents have 0.
    met = rows.join(written(chances), ["key", "step"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    far = F.col("u") * (1.0 - F.col("p"))
    met = met.withColumn("rank", F.when(F.col("p") > 0, far / (far + (1.0 - F.col("u")) * F.col("p"))).otherwise(F.lit(1.0)))
    met = met.withColumn("bucket", F.floor(F.col("rank") * buckets)).withColumn("order", F.struct("rank", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), "size"))
    open_ = met.filter("size > 0 AND p > 0").select("key", "bucket", "order", "size")
    wanted = plan.filter("wanted > 0").select("key", "wanted")
    first = written(_limit(open_, wanted, False))

    beside = open_.join(first.select("key", F.struct("bucket", "at").alias("first")), "key", "left").withColumn("in", _within("first"))
    taken = beside.filter("in").groupBy("key").agg(F.sum("size").alias("got"))
    gap = written(wanted.join(taken, "key", "left").select("key", (F.col("wanted") - F.coalesce("got", F.lit(0))).alias("wanted")))
    small = beside.filter("NOT in").join(gap, "key").filter(F.col("size") <= F.col("wanted")).select("key", "bucket", "order", "size")
    second = written(_limit(small, gap, True))

    limits = plan.join(first.select("key", F.struct("bucket", "at").alias("first")), "key", "left").join(second.select("key", F.struct("bucket", "at").alias("second")), "key", "left").join(gap.withColumnRenamed("wanted", "gap"), "key", "left").drop("wanted")
    out = met.join(limits, "key")
    more = (F.col("p") > 0) & (_within("first") | ((F.col("size") <= F.coalesce("gap", F.lit(0.0))) & _within("second")))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + more.cast("long")).otherwise(F.lit(0)).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", F.col("target").cast("double").alias("target"), F.col("p").alias("chance"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
