"""A Merkle manifest of a dataset: leaf digests, subroots per group, one root, and proofs.

H is the lowercase hex SHA-256 of its inputs concatenated; digests go in as hex text.  A row is
a leaf: H of its columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.
Within a group leaves ascend by id; while more than one node remains, every 8 consecutive ones
(the last run may have fewer, even one) become their H.  What remains is the group's subroot;
the subroots, ordered by group (null first, bytewise), form a tree of the same kind.

Everything is Column expressions:

1. A rank in the group without a sort in one task: rows are range-partitioned by group and id,
   numbered in their partition, and the sizes of earlier partitions are added (a table of one
   row a partition and group).
2. 512 consecutive leaves are an aligned block.  A block keeps each of its levels as one string
   of hex digests, side by side.  Fixed-width substrings of a level are what its parents hash;
   the substrings left and right of a node's own are its siblings.
3. Blocks' own nodes are the leaves of the next stage: the same function over 1/512 of the
   nodes, until every tree is one block.  Proofs come back down by joins on (tree, block), so a
   group with a third of all rows is as many keys as it has blocks.

A proof is the siblings, level by level from the leaf to the root, left to right in each level.

Defined cases: null ids come first in their group; equal ids are ordered by leaf digest, then
as they come (repeated rows are equal leaves); a null group is a group of its own; an empty
table gives an empty table; a leaf alone in its group is the subroot, and a single subroot is
the root, with an empty proof; columns beside the named ones take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import written

HEX, FAN = 64, 8
DEPTH = 3
BLOCK = FAN**DEPTH
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """H of the values, each with its length, so that no two rows read the same."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, values)), 256)


def lower_ascii(c: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(df: DataFrame, id_col: str, group_col: str, columns: tuple[str, ...], tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, tree, leaf, tampered): ``tampered`` replaces columns in the rows that ``where``
    names, as a forger would; elsewhere the column is null."""
    change = tampered or {}
    other = leaf_digest([change.get(c, F.col(c)) for c in columns])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    return df.select(F.col(id_col).alias("id"), tree.alias("tree"), leaf_digest([F.col(c) for c in columns]).alias("leaf"), F.when(where, other).alias("tampered") if where is not None else F.lit(None).cast("string").alias("tampered"))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the rank in the tree from 0, and ``n``, the tree's nodes.

    The frame is written before it is range-partitioned (the ranges' sample would compute it
    again) and after it is numbered (numbers must not change if a task is repeated)."""
    numbered = written(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy("tree", part.alias("_part")).agg(F.count(F.lit(1)).alias("_here"), F.min("_at").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("tree", "_part", "_first", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"), F.sum("_here").over(Window.partitionBy("tree")).alias("n"))
    # A (tree, partition) meets one row here; a tree that fills many partitions is as many keys.
    met = numbered.withColumn("_part", part).join(starts, ["tree", "_part"])
    return met.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _piece(level: Column, first: Column, count: Column | int) -> Column:
    """``count`` digests of a level from digest ``first``; a level is its bytes, of which a
    substring is a plain copy."""
    return F.substring(level, (first * HEX + 1).cast("int"), (F.lit(count) if isinstance(count, int) else count).cast("int") * HEX)


def _parents(level: Column) -> Column:
    last = F.ceil(F.length(level) / (HEX * FAN)).cast("int") - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(_piece(level, i * FAN, FAN), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, block, n, members, levels, own): ``levels`` are those that have parents in the
    block, ``own`` is the node that the block passes up."""
    member = F.struct("pos", "leaf", *carried)
    grouped = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("tree", "block").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
    out = grouped.withColumn("l0", F.array_join(F.transform("members", lambda m: m["leaf"]), "").cast("binary"))
    # A tree within one block ends at its only node; a block of a larger tree has all levels.
    whole = F.col("n") > BLOCK
    levels, at = [], F.col("l0")
    for k in range(DEPTH):
        goes_on = whole | (F.length(at) > HEX)
        levels.append(F.when(goes_on, at))
        out = out.withColumn(f"l{k + 1}", F.when(goes_on, _parents(at)).otherwise(at))
        at = F.col(f"l{k + 1}")
    out = out.withColumn("levels", F.array_compact(F.array(*levels))).withColumn("own", at.cast("string"))
    return out.select("tree", "block", "n", "members", "levels", "own")


def _siblings(levels: Column, at: Column) -> Column:
    """(left, right) of each level for the member at index ``at`` of its block."""

    def one(level: Column, k: Column) -> Column:
        node = F.floor(at / F.pow(F.lit(float(FAN)), k)).cast("int")
        first = node - node % FAN
        return F.struct(_piece(level, first, node - first).alias("left"), _piece(level, node + 1, FAN - 1 - (node - first)).alias("right"))

    return F.transform(levels, one)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc.cast("binary"), x["right"]), 256))


def proof_digest(proof: Column) -> Column:
    empty = F.lit("").cast("binary")
    return F.sha2(F.aggregate(proof, empty, lambda acc, x: F.concat(acc, x["left"], x["right"])), 256)


def _proved(nodes: DataFrame, carried: list[str], above: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(blocks with ``up``, the proof of the block's own node to the root, and ``subroot``,
    ``root``; roots by tree).  ``above`` gives (tree, up, root) for subroots, or is None where
    the subroots are the roots."""
    blocks = written(_blocks(nodes, carried))
    own = blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("own").alias("leaf"))
    if blocks.filter(F.col("n") > BLOCK).limit(1).count():
        higher, roots = _proved(own, [], above)
        return blocks.join(_opened(higher).withColumnRenamed("pos", "block").drop("leaf"), ["tree", "block"]), roots
    roots = own.select("tree", F.col("leaf").alias("subroot"))
    top = above(roots) if above else roots.select("tree", F.col("subroot").alias("root"), F.expr("CAST(array() AS array<struct<left: binary, right: binary>>)").alias("up"))
    met = blocks.withColumnRenamed("own", "subroot").join(top.select("tree", "root", "up"), "tree")
    return met, roots


def _opened(blocks: DataFrame) -> DataFrame:
    """One row a member with its whole proof, ``up``."""
    proof = lambda at: F.concat(_siblings(F.col("levels"), at), F.col("up"))
    names = [f.name for f in blocks.schema["members"].dataType.elementType.fields]
    found = F.transform("members", lambda m, at: F.struct(*[m[c].alias(c) for c in names], proof(at).alias("up")))
    return blocks.select("tree", "subroot", "root", F.inline(found))


def _over_subroots(roots: DataFrame) -> DataFrame:
    """(tree, up, root) of the tree whose leaves are the subroots."""
    nodes = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("subroot").alias("leaf")), ["group"])
    blocks, _ = _proved(nodes, ["group"], None)
    return _opened(blocks).select(F.col("group").alias("tree"), "up", "root")


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, tree, leaf, tampered, proof, subroot, root), one row per row of the frame;
    ``proof`` has a (left, right) pair of sibling segments a level."""
    narrow = written(leaves(df, id_col, group_col, columns, tampered, where))
    nodes = ranked(narrow, ["id", "leaf"])
    blocks, _ = _proved(nodes, ["id", "tampered"], _over_subroots)
    return _opened(blocks).withColumnRenamed("up", "proof").select("id", "tree", "leaf", "tampered", "proof", "subroot", "root")


def verify(proved: DataFrame) -> DataFrame:
    """Adds ``proof_sha256`` (H of the siblings), ``folded_root`` (of the tampered leaf where
    there is one, else of the leaf) and ``verified``."""
    folded = proved.withColumns({"folded_root": fold(F.coalesce("tampered", "leaf"), F.col("proof")), "proof_sha256": proof_digest(F.col("proof"))})
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
