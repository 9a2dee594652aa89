"""Exact dedup by a tree merge of sorted digest runs.

1. Each input partition writes its rows' digests (a table), and makes sorted runs of the distinct
   ones: digest, number of rows, smallest id.  A run has ``RUN_ROWS`` rows at most.
2. Runs live at addresses, written in base ``fan``: first the partition's number.  In round k
   the runs of the addresses that differ in digit k alone exchange parts: a digest goes to the
   address whose digit k is digit k of the digest's own range.  There a multiway merge of the
   sorted parts joins equal digests, adds their counts and keeps the smallest id.  With fan 2
   these are the rounds of a binomial tree; a larger fan merges more runs in fewer rounds.
   After the last round an address holds one range of the digests, merged from all runs.  An
   address never holds more than a partition's share, and a text that a third of all rows have
   is one row a run in the first round and fewer in each that follows.
3. The runs' digests meet the merged ones (a row a run and digest), then each row meets its own
   run's answer by (run, digest): again no key has more rows than one run.

Equality is verified in every merge: runs are sorted by 64 bits of a hash, and rows become one
only if length and SHA-256 of the text agree too.

A text is normalised by replacing each ``[\\x20\\x09-\\x0D]+`` with one space.

Defined cases: a null text is an empty one; a null id is larger than any other and stays only
where its text has no other id (``keep_id`` is then null); of rows with equal ids and texts the
first written one stays; an empty table gives an empty table; other columns are ignored,
or passed on by :func:`keep_first`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import unused, written

RUN_ROWS = 1 << 19
FAN = 16
BLANKS = r"[\x20\x09-\x0D]+"
RUN = "address long, keys binary, shas binary, sizes binary, ids binary, places binary, counts binary"
MERGED = "key long, sha binary, n_bytes long, keep_id long, keep_place long, group_size long"
NONE = np.iinfo(np.int64).max


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


class Rows:
    """Columns of digest rows: key, SHA-256 as four numbers, length, id, place, count.  An id is
    its place in the order of ids; ``NONE`` stands for null."""

    __slots__ = ("key", "sha", "size", "id", "place", "count")
    KINDS = (np.int64, np.uint64, np.int64, np.int64, np.int64, np.int64)

    def __init__(self, key, sha, size, id, place, count):
        self.key, self.sha, self.size, self.id, self.place, self.count = key, sha, size, id, place, count

    def __len__(self) -> int:
        return len(self.key)

    def take(self, at) -> Rows:
        return Rows(*(getattr(self, c)[at] for c in self.__slots__))

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*(np.concatenate([getattr(p, c) for p in parts]) for c in Rows.__slots__))

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, c)).tobytes() for c in self.__slots__]

    @staticmethod
    def unpacked(cells: list[bytes]) -> Rows:
        key, sha, *rest = (np.frombuffer(x, kind) for x, kind in zip(cells, Rows.KINDS))
        return Rows(key, sha.reshape(-1, 4), *rest)

    def collapsed(self) -> Rows:
        """Of rows sorted by text, id and place: one row a text, verified by length and SHA."""
        if not len(self):
            return self
        fresh = np.ones(len(self), bool)
        fresh[1:] = (self.key[1:] != self.key[:-1]) | (self.size[1:] != self.size[:-1]) | (self.sha[1:] != self.sha[:-1]).any(1)
        at = np.flatnonzero(fresh)
        return Rows(self.key[at], self.sha[at], self.size[at], self.id[at], self.place[at], np.add.reduceat(self.count, at))

    def ordered(self) -> Rows:
        order = np.lexsort((self.place, self.id, *self.sha.T[::-1], self.size, self.key))
        return self.take(order)


def merge(runs: list[Rows]) -> Rows:
    """Multiway merge of runs sorted by key.  Each row's place in the result is its own index
    plus, for every other run, the rows there that come before it, by binary search; rows of
    one key, which are few, are then ordered by text, id and place."""
    runs = [r for r in runs if len(r)]
    if len(runs) < 2:
        return runs[0].collapsed() if runs else Rows.unpacked([b""] * 6)
    total = sum(map(len, runs))
    source = np.empty(total, np.int64)
    offset = 0
    for i, a in enumerate(runs):
        at = np.arange(len(a))
        for j, b in enumerate(runs):
            if i != j:
                at += np.searchsorted(b.key, a.key, "right" if j < i else "left")
        source[at] = offset + np.arange(len(a))
        offset += len(a)
    out = Rows.joined(runs).take(source)
    same = np.flatnonzero(out.key[1:] == out.key[:-1])
    if len(same):
        tied = np.zeros(total, bool)
        tied[same], tied[same + 1] = True, True
        at = np.flatnonzero(tied)
        ordered = out.take(at).ordered()
        for c in Rows.__slots__:
            getattr(out, c)[at] = getattr(ordered, c)
    return out.collapsed()


def _digit(address: np.ndarray, k: int, fan: int) -> np.ndarray:
    return address // fan**k % fan


def _dealt(address: int, run: Rows, k: int, fan: int, rounds: int) -> Iterator[tuple[int, Rows]]:
    """The parts of a sorted run for round k: by digit k of the digest's range, with digit k of
    the address replaced."""
    mixed = run.key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    span = np.uint64(fan**rounds)
    digit = _digit((mixed >> np.uint64(24)) % span, k, fan).astype(np.int64) if rounds else np.zeros(len(run), np.int64)
    base = address - address // fan**k % fan * fan**k
    for d in np.unique(digit).tolist():
        yield base + d * fan**k, run.take(np.flatnonzero(digit == d))


def _batch(rows: list[tuple[int, Rows]]) -> pa.RecordBatch:
    cells = [[address, *run.packed()] for address, run in rows]
    kinds = [pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in RUN.split(", ")])


def _read(batch: pa.RecordBatch | pa.Table) -> list[Rows]:
    columns = [batch.column(i).to_pylist() for i in range(1, 7)]
    return [Rows.unpacked(list(cells)) for cells in zip(*columns)]


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(run, place, id, key, sha, n_bytes), a table: a row per document, and the partition that
    read it."""
    # The normalised text is named first, so that the pattern runs once a row.
    text = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).cast("binary").alias("text"))
    hashed = text.select(F.spark_partition_id().cast("long").alias("run"), F.monotonically_increasing_id().alias("place"), "id", F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    return written(hashed)


def _runs(rows: DataFrame, fan: int, rounds: int) -> DataFrame:
    """Sorted runs of the digests of each partition, dealt for the first round.  A file may be
    read by several tasks and a task may read several: runs are made of what a task has of a
    partition, and parts of one partition meet where they would have anyway."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def runs() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            own = table.column("run").to_numpy()
            sha = np.frombuffer(b"".join(table.column("sha").to_pylist()), np.uint64).reshape(-1, 4)
            ids = table.column("id").fill_null(NONE).to_numpy()
            all_ = Rows(table.column("key").to_numpy(), sha, table.column("n_bytes").to_numpy(), ids, table.column("place").to_numpy(), np.ones(len(own), np.int64))
            for address in np.unique(own).tolist():
                run = all_.take(np.flatnonzero(own == address)).ordered().collapsed()
                yield _batch(list(_dealt(address, run, 0, fan, rounds)))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= RUN_ROWS:
                yield from runs()
                held, n = [], 0
        if n:
            yield from runs()

    return rows.select("run", "place", "id", "key", "sha", "n_bytes").mapInArrow(sort, RUN)


def _round(runs: DataFrame, k: int, fan: int, rounds: int) -> DataFrame:
    """Merges the parts that met at each address; deals the result for round k + 1, or, after
    the last round, leaves it at its address."""

    def meet(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        address, out = key[0].as_py(), merge([r for b in parts for r in _read(b)])
        yield _batch(list(_dealt(address, out, k + 1, fan, rounds)) if k + 1 < rounds else [(address, out)])

    return runs.groupBy("address").applyInArrow(meet, RUN)


def _opened(runs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _read(batch):
                ids = pa.array(r.id, mask=r.id == NONE)
                sha = pa.Array.from_buffers(pa.binary(32), len(r), [None, pa.py_buffer(r.sha.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(r.key), sha, pa.array(r.size), ids, pa.array(r.place), pa.array(r.count)], names=[x.split()[0] for x in MERGED.split(", ")])

    return runs.select("address", "keys", "shas", "sizes", "ids", "places", "counts").mapInArrow(rows, MERGED)


def merged_digests(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """(key, sha, n_bytes, keep_id, keep_place, group_size): every distinct text of the digest
    rows once."""
    last = rows.agg(F.max("run")).first()[0] or 0
    rounds = 1
    while fan**rounds <= last:
        rounds += 1
    runs = _runs(rows, fan, rounds)
    for k in range(rounds):
        runs = _round(runs, k, fan, rounds)
    return _opened(runs)


def _answers(docs: DataFrame, id_col: str, text_col: str, fan: int) -> DataFrame:
    rows = _digested(docs, id_col, text_col)
    merged = written(merged_digests(rows, fan))
    text = ["key", "sha", "n_bytes"]
    of_runs = rows.select("run", *text).distinct().join(merged, text)
    return rows.join(of_runs, ["run", *text])


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of the frame.  Ids are
    whole numbers."""
    found = _answers(docs, id_col, text_col, fan)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """The frame's rows without those whose text a row with a smaller id has; of equal rows
    one stays.  Ids and texts decide, so the kept rows are found by (id, SHA-256)."""
    sha, nth, at = (unused(docs, x) for x in ("_sha", "_nth", "_at"))
    kept = duplicate_groups(docs, id_col, text_col, fan).filter("kept").select(F.col(id_col).alias(at), F.col("text_sha256").alias(nth))
    own = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    met = own.join(kept, own[id_col].cast("long").eqNullSafe(kept[at]) & (own[sha] == kept[nth]), "left_semi")
    # Rows with equal ids and texts: the first of them.
    return met.drop_duplicates([id_col, sha]).select(*docs.columns)
