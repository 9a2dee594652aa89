"""SimHash near-dedup: 64-bit fingerprints, links within a Hamming radius, vantage-point trees.

Fingerprints are made once per text and reduced to distinct values.  A first cut deals them to
shards: two values within ``radius`` bits agree wholly on ``t`` of radius + t bit blocks, so each
value goes to one shard for each choice of t blocks, by a hash of those blocks, and every linked
pair meets.  There are so many shards for a choice that one holds some ``FILL`` values, whatever
the table's size; t is the least at which blocks have values enough for that: one shard for
small tables, five copies a value up to some tens of millions, fifteen up to thousands of
millions.  A shard then is far larger than what shares its blocks, and a vantage-point tree does
the search in it: a vantage point and the median distance to it part the values, and a query
enters a side only if the triangle bound lets a value there be within the radius, so queries
near the boundary enter both.  Shards give a spanning forest of their links, never all pairs;
the forests' union has the components of the link graph.  (A tree over *all* values is not the
first cut: at radius 4 two thirds of unrelated 64-bit values lie near a median boundary and
would be copied to both sides at every level; the README has figures.)

A shard with more than ``most`` values is cut into chunks, and pairs of chunks are the tasks.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links
like any other; a null id takes part but never names a component unless no id is there;
repeated rows share a component; an empty table gives an empty table; other columns are
ignored, or passed on by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import slices, unused, utf8, written
from .graph import components

WORDS, RADIUS, SEED = 4, 4, 42
MOST = 8192
FILL = 2048
LEAF = 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bit i is 1 if over half the shingles' hashes have it."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint's bits as a long, one row per input row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t) for t in utf8(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """Roots of the values of one shard, joined as links are found."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Values a[i] and b[i] are linked."""
        while len(a):
            low, high = np.minimum(self.root[a], self.root[b]), np.maximum(self.root[a], self.root[b])
            open_ = low < high
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            np.minimum.at(self.root, high, low)
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


class VantageTree:
    """Over places in ``values``; queries are searched together."""

    def __init__(self, values: np.ndarray, places: np.ndarray):
        self.values = values
        self.visits = [0, 0]  # queries times inner nodes entered, and sides that bounds spared
        self.top = self._build(places)

    def _build(self, places: np.ndarray):
        if len(places) <= LEAF:
            return places
        apart = _apart(self.values[places], self.values[places[0]])
        middle = int(np.median(apart))
        inside = apart <= middle
        if inside.all():  # many equal distances: part by whether they are at the vantage point
            middle = int(apart.max()) - 1
            inside = apart <= middle
        if not inside.any() or inside.all():
            return places
        return places[0], middle, self._build(places[inside]), self._build(places[~inside])

    def links(self, queries: np.ndarray, radius: int, forest: Forest, node=None) -> None:
        """Joins every query with the values within the radius."""
        node = self.top if node is None else node
        if not len(queries):
            return
        if isinstance(node, np.ndarray):
            for at in range(0, len(queries), 4096):
                part = queries[at : at + 4096]
                far = forest.root[part][:, None] != forest.root[node][None, :]
                if far.any():
                    i, j = np.nonzero(far & (_apart(self.values[part][:, None], self.values[node][None, :]) <= radius))
                    forest.join(part[i], node[j])
            return
        vantage, middle, inner, outer = node
        apart = _apart(self.values[queries], self.values[vantage]).astype(np.int64)
        near, far = queries[apart - radius <= middle], queries[apart + radius > middle]
        self.visits[0] += len(queries)
        self.visits[1] += 2 * len(queries) - len(near) - len(far)
        self.links(near, radius, forest, inner)
        self.links(far, radius, forest, outer)


def shard_forest(values: np.ndarray, radius: int = RADIUS, visits=None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, root value) that span the links among distinct values; ``visits``, an
    accumulator, gets the tree's."""
    forest, places = Forest(len(values)), np.arange(len(values))
    tree = VantageTree(values, places)
    tree.links(places, radius, forest)
    if visits is not None:
        visits.add(tree.visits[0])
    own = np.flatnonzero(forest.root != places)
    return values[own], values[forest.root[own]]


def blocks_shared(n: int, radius: int = RADIUS, most: int = MOST) -> int:
    """t: how many of radius + t blocks two values of a shard have in common, for n values."""
    t = 0
    while n > (most // 2) << (64 * t // (radius + t)):
        t += 1
    return t


def _shards(t: int, radius: int, many: int) -> Column:
    """A value's shards, ``many`` for each choice of t blocks: equal blocks share one."""
    if not t:
        return F.array(F.lit(0).cast("long"))
    edges = [64 * i // (radius + t) for i in range(radius + t + 1)]
    block = lambda i: F.shiftrightunsigned(F.col("fp"), edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1)
    return F.array(*[F.lit(k * many) + F.pmod(F.xxhash64(*map(block, chosen)), F.lit(many)) for k, chosen in enumerate(combinations(range(radius + t), t))])


def meetings(rows: DataFrame, by: str) -> DataFrame:
    """Rows with ``chunks``, the number of chunks of their group, get ``pair`` instead: a group
    of one chunk (or null) is one task; of more, chunk c, chosen by the hash of ``by``, meets
    every chunk, so its rows go to all pairs that hold c."""
    chunks = F.col("chunks")
    own = F.pmod(F.xxhash64(by), chunks).cast("int")
    every = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.least(own, c) * chunks + F.greatest(own, c))
    return rows.withColumn("pair", F.explode(F.when(chunks > 1, every).otherwise(F.array(F.lit(0))))).drop("chunks")


def links(values: DataFrame, radius: int = RADIUS, most: int = MOST, visits=None) -> DataFrame:
    """Distinct (fp) -> (u, v): edges whose components are those of all links."""
    n = values.count()
    t = blocks_shared(n, radius, most)
    rows = values.select("fp", F.explode(_shards(t, radius, max(1, -(-n // min(FILL, most // 4 or 1))))).alias("shard"))
    big = written(rows.groupBy("shard").count().filter(F.col("count") > most).withColumn("chunks", F.ceil(F.col("count") / (most // 2)).cast("int")).select("shard", "chunks"))
    small = big.count() <= 100_000  # else the join is left to the optimiser
    rows = meetings(rows.join(F.broadcast(big) if small else big, "shard", "left"), "fp")
    rows = rows.repartition(F.col("shard"), F.col("pair")).sortWithinPartitions("shard", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of whole groups."""
            edges = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))
            sizes = np.diff(edges)
            group = np.repeat(np.arange(len(sizes)), sizes)
            us, vs = [], []
            for step in range(1, LEAF):  # groups that are a single leaf, all at once
                a = np.flatnonzero((group[step:] == group[:-step]) & (sizes[group[step:]] <= LEAF))
                near = a[_apart(fps[a], fps[a + step]) <= radius]
                us.append(fps[near])
                vs.append(fps[near + step])
            for g in np.flatnonzero(sizes > LEAF):
                u, v = shard_forest(np.unique(fps[edges[g] : edges[g + 1]]), radius, visits)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

        keys, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("shard", "pair")], 1)
            keys, fps = np.concatenate((keys, key)), np.concatenate((fps, batch.column("fp").to_numpy().view(np.uint64)))
            last = np.flatnonzero((keys != keys[-1]).any(1))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield from out(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield from out(keys, fps)

    return rows.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    rows = written(fingerprints(docs, id_col, text_col))
    return _grouped(rows, radius, most).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def _grouped(rows: DataFrame, radius: int, most: int) -> DataFrame:
    values = _values(rows)
    return grouped(rows, links(values.select("fp"), radius, most), values)


def _values(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))


HOT = 1000


def grouped(rows: DataFrame, edges: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(id, fp) with the component: the smallest id among the values that edges connect.

    Values with more than a thousandth of all rows are fewer than ``HOT``; they are broadcast to
    their rows, so that no task gets all rows of a value, and the other rows are joined."""
    values = _values(rows) if values is None else values
    roots = components(edges)
    placed = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component"))
    placed = written(placed.join(least, "root").select("fp", "component", "n"))
    total = placed.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    often = F.broadcast(placed.filter(hot).select("fp", "component"))
    rest = rows.join(often.select("fp"), "fp", "left_anti").join(placed.filter(~hot).select("fp", "component"), "fp")
    return rows.join(often, "fp").unionByName(rest)


def marked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The input rows with what orders them in a component, and that column's name."""
    name = unused(docs, "mark")
    return docs.withColumn(name, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("sum"))), name


def keep_first(docs: DataFrame, mark: str, placed: DataFrame, rows: DataFrame) -> DataFrame:
    """Of marked rows those that name their component; ``rows`` has the marks as id."""
    stay = placed.filter("id = component").select(F.col("id.sum").alias("kept_sum"), F.col("id.id").alias("kept_id")).distinct()
    # Joined by the sum, which is never null, and the id, null-safe.
    found = docs.join(stay, (docs[mark]["sum"] == stay["kept_sum"]) & docs[mark]["id"].eqNullSafe(stay["kept_id"]), "left_semi")
    # Rows alike in id and text are rare: only a table that has some pays the second exchange.
    alike = rows.groupBy("id").count().filter("count > 1").limit(1).count()
    return (found.dropDuplicates([mark]) if alike else found).drop(mark)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """The input rows less all but one of each component: the one with the smallest id, then
    the smallest md5 of its text (rows alike in both are one).  Null ids come last."""
    with_mark, mark = marked(docs, id_col, text_col)
    rows = written(fingerprints(with_mark, mark, text_col))
    return keep_first(with_mark, mark, _grouped(rows, radius, most), rows)
