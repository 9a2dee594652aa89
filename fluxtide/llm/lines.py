"""Line dedup over a corpus with two Bloom filters.

1. Tasks send the 128-bit hashes of their lines' keys, with the document's mark and id, to
   segments of the hash space.  A hash that a run of documents has twice is suspected there and
   then: it goes to its segment once, without its documents, so a line that a third of all
   documents hold meets no single task.
2. A segment holds a filter of hashes seen once and one of hashes seen twice; what the first
   already holds, or a run had twice, enters the second.  The run's other hashes that the
   second filter holds are suspected.
3. Only suspected repeats shuffle on: they are counted by the whole hash, in documents, with the
   smallest id.  Those found in ``min_docs`` documents are confirmed.
4. Each document meets its own confirmed hashes by its mark, and a last pass drops their lines,
   all or all but the first occurrence.

The plan is the same at every size, and nothing is broadcast or sent to the driver but the
number of lines, which sets the number of segments.  Two keys count as the same line if their
128-bit hashes agree.  A mark is 64 bits of id and text; documents whose marks collide are offered
each other's hashes too, which changes nothing.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased.

Defined cases: a null or empty text is one empty line; an empty key is never dropped;
repeated rows are documents of their own; a null id is never the first occurrence; among
equal ids the first line of each keeps; an empty table gives an empty table; other columns are
passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, unused, utf8, written

BLANK = b" \t\n\r\x0b\x0c"
SEGMENT_LINES = 1 << 20
RUN_LINES = 1 << 18
BITS_PER_LINE, PROBES = 16, 4
SALTS = 32


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(BLANK).lower() for x in text.split(b"\n")]


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """(keys, 2) halves of the 128-bit hashes; the filters read the first."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(probes, hashes) bit places of a filter whose size is a power of two."""
    first, second = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * second) & np.uint64(bits - 1) for i in range(PROBES)])


class Bloom:
    def __init__(self, bits: int):
        self.bits = bits
        self.store = np.zeros(bits >> 3, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = _probes(hashes, self.bits).ravel()
        np.bitwise_or.at(self.store, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = _probes(hashes, self.bits)
        return ((self.store[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    """From mixed bits: the probes use all, so segments must not fix the low ones."""
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(segments)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def suspected_lines(rows: DataFrame, segment_lines: int = SEGMENT_LINES) -> DataFrame:
    """(mark, id, text) -> (h1, h2, mark, id): each document's lines whose hash the second filter
    holds, once a document."""
    id_type = rows.schema["id"].dataType.simpleString()
    lines = rows.agg(F.sum(F.regexp_count("text", F.lit("\n")) + 1)).first()[0] or 0
    segments = max(1, -(-lines // segment_lines))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> Iterator[pa.RecordBatch]:
            hashes, own = np.concatenate(found), np.concatenate(of)
            marks, ids = pa.concat_arrays(of_marks), pa.concat_arrays(of_ids)
            order = np.lexsort((hashes[:, 1], hashes[:, 0]))
            hashes, own = hashes[order], own[order]
            same = (hashes[1:] == hashes[:-1]).all(1)
            again, more = np.append(False, same), np.append(same, False)
            twice = again | more
            if twice.any():
                yield rows_of(None, hashes[twice], pa.array(own[twice]), marks, ids, True)
            # To the segments: a single hash with its document, a repeated one once without.
            sent = np.flatnonzero(~again)
            part = _segment(hashes[sent, 0], segments).astype(np.int64)
            sent = sent[np.argsort(part, kind="stable")]
            edges = np.searchsorted(np.sort(part), np.arange(segments + 1))
            for s in np.flatnonzero(np.diff(edges)):
                here = sent[edges[s] : edges[s + 1]]
                yield rows_of(int(s), hashes[here], pa.array(own[here], mask=more[here]), marks, ids, False)

        def rows_of(segment, hashes: np.ndarray, own: pa.Array, marks: pa.Array, ids: pa.Array, direct: bool) -> pa.RecordBatch:
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            single = pa.array(np.asarray(own.is_valid()))
            columns = [pa.array([segment], pa.int32()), *(one(v) for v in (_longs(hashes[:, 0]), _longs(hashes[:, 1]), single, marks.take(own), ids.take(own)))]
            return pa.RecordBatch.from_arrays(columns, names=["segment", "h1", "h2", "single", "mark", "id"])

        found, of, of_marks, of_ids, count, docs = [], [], [], [], 0, 0
        for batch in slices(batches, "text"):
            keys = [[k for k in set(line_keys(t)) if k] for t in utf8(batch, "text")]
            sizes = [len(k) for k in keys]
            found.append(key_hashes([k for own in keys for k in own]))
            of.append(np.repeat(np.arange(docs, docs + batch.num_rows), sizes))
            of_marks.append(batch.column("mark"))
            of_ids.append(batch.column("id"))
            docs, count = docs + batch.num_rows, count + sum(sizes)
            if count >= RUN_LINES:
                yield from packed()
                found, of, of_marks, of_ids, count, docs = [], [], [], [], 0, 0
        if count:
            yield from packed()

    def build(key: tuple, runs: pa.Table) -> pa.Table:
        first = [np.asarray(x.values).view(np.uint64) for x in runs.column("h1")]
        single = [np.asarray(x.values) for x in runs.column("single")]
        bits = 1 << max(10, (sum(map(len, first)) * BITS_PER_LINE - 1).bit_length())
        once, twice = Bloom(bits), Bloom(bits)
        for seen, alone in zip(first, single):
            twice.add(seen[once.holds(seen)])
            twice.add(seen[~alone])
            once.add(seen)
        out = []
        for i, (seen, alone) in enumerate(zip(first, single)):
            stay = pa.array(np.flatnonzero(alone & twice.holds(seen)))
            out.append(pa.table({n: runs.column(n)[i].values.take(stay) for n in ("h1", "h2", "mark", "id")}))
        return pa.concat_tables(out)

    kind = f"h1 array<long>, h2 array<long>, single array<boolean>, mark array<long>, id array<{id_type}>"
    runs = written(rows.mapInArrow(send, f"segment int, {kind}"))
    direct = runs.filter("segment IS NULL").select(F.explode(F.arrays_zip("h1", "h2", "mark", "id")).alias("z")).select("z.*")
    held = runs.filter("segment IS NOT NULL").groupBy("segment").applyInArrow(build, f"h1 long, h2 long, mark long, id {id_type}")
    return held.unionByName(direct)


def _kept(text: bytes, row: object, bad: dict[bytes, object], keep: str) -> tuple[bytes, int, int]:
    """bad: the confirmed hashes of this document, each with the id of its first occurrence."""
    if not bad:
        return text, text.count(b"\n") + 1, 0
    lines, out, here = text.split(b"\n"), [], set()
    for line in lines:
        key = line.strip(BLANK).lower()
        if key and (h := xxhash.xxh3_128_digest(key)) in bad:
            if not (keep == "first" and row is not None and bad[h] == row and h not in here):
                continue
            here.add(h)
        out.append(line)
    return b"\n".join(out), len(lines), len(lines) - len(out)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, keep: str = "first", segment_lines: int = SEGMENT_LINES) -> DataFrame:
    """The input rows with the text less its repeated lines, and ``n_lines`` (before) and
    ``n_dropped``, which replace columns of these names.

    keep: "first" leaves a repeated line where it occurs first by id, "none" nowhere.
    """
    docs = docs.drop("n_lines", "n_dropped")
    names, mark, bad = docs.columns, unused(docs, "mark"), unused(docs, "bad")
    marked = docs.withColumn(mark, F.xxhash64(F.col(id_col), F.col(text_col)))
    rows = marked.select(F.col(mark).alias("mark"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    suspected = written(suspected_lines(rows, segment_lines))
    confirmed = suspected.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first")).filter(F.col("n_docs") >= min_docs)
    # A line of very many documents meets its verdict in several tasks, one a salt.
    salted = confirmed.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = suspected.select("h1", "h2", F.pmod("mark", F.lit(SALTS)).cast("int").alias("salt"), F.col("mark").alias(mark)).join(salted, ["h1", "h2", "salt"])
    own = own.groupBy(mark).agg(F.collect_set(F.struct("h1", "h2", "first")).alias(bad))
    joined = marked.join(own, mark, "left").drop(mark)
    schema = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = []
            for text, row, hits in zip(utf8(batch, text_col), batch.column(id_col).to_pylist(), batch.column(bad).to_pylist()):
                found.append(_kept(text, row, {np.array([x["h1"], x["h2"]]).tobytes(): x["first"] for x in hits or ()}, keep))
            columns = [pa.array([f[0].decode("utf-8", "replace") for f in found], pa.string()) if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema)
