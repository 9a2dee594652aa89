"""Removal of repeated byte strings by a distributed, prefix-aware merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the
same document or another; strings are judged on the input.

Every window of ``length`` bytes has an anchor: the leftmost smallest hash of its half-length
grams.  Equal windows have their anchors at equal offsets, so only suffixes that begin at
anchors are sorted, and of those only the ones whose gram's hash occurs twice.

* Tasks sort the suffixes of their documents into a run; alike entries become one with a
  multiplicity.  Runs are cut at splitters on the suffixes' first bytes, front-coded (length
  of the common prefix with the entry before, then the rest) and exchanged.
* A range's runs are merged by a loser tree that knows how far each head agrees with the
  last winner, from the front codes, and compares bytes only beyond that.
* Entries that agree on the gram are one group.  Exact classes of what follows the anchor
  (from the merge's prefix lengths) and of what stands before it (sorted backwards) tell for
  each offset which windows are equal.

No group of places is ever gathered: a run's entry stands for all its places, and they meet
the verdict by a join on (run, entry).

Defined cases: a null or empty text has no bytes and loses none; texts shorter than
``length`` lose none; two equal rows repeat each other; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, utf8, written

LENGTH = 400
PASSAGE = 51  # words
SEGMENT = 1 << 20
HEAD = 32
SAMPLE = 20_000
RANGE_BYTES = 16 << 20
RUN_BYTES = 48 << 20
_BASE = 0x9E3779B97F4A7C15
_POS = np.uint64((1 << 24) - 1)


class Anchors:
    """Finds the anchors of one text; powers of the hash base are made once."""

    def __init__(self, length: int = LENGTH):
        self.length, self.gram = length, length // 2
        n = SEGMENT + length
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(n, _BASE, np.uint64))
            self.back = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, last window, gram hash), by windows in order."""
        parts = [self._segment(text, s) for s in range(0, max(1, len(text) - self.length + 1), SEGMENT)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def least(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By window, where its anchor is; and all grams' hashes.  For ``length`` values or more,
        ``SEGMENT`` windows at most."""
        w = self.gram
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)])))
        hashes = (sums[w:] - sums[:-w]) * self.back[: len(raw) - w + 1]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
        least, width = (hashes & ~_POS) | np.arange(len(hashes), dtype=np.uint64), 1
        span = self.length - w + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        return (least & _POS).astype(np.int64), hashes

    def _segment(self, text: bytes, start: int):
        raw = np.frombuffer(text, np.uint8, min(len(text) - start, SEGMENT + self.length - 1), start)
        if len(raw) < self.length:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64)
        at, hashes = self.least(raw)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        return at[first] + start, first + start, last + start, hashes[at[first]]


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n, i = min(len(a), len(b)), start
    while i < n:
        x, y = a[i : i + 32], b[i : i + 32]
        if x == y:
            i += 32
            continue
        for p, q in zip(x, y):
            if p != q:
                return i
            i += 1
    return n


class LoserTree:
    """Merges runs of (string, common prefix with the one before in its run).

    ``agree[r]`` is how far the head of run r agrees with the last string given out, or with
    the one that it lost to since; of two heads the one that agrees further is smaller, and
    only if both agree equally far are bytes compared, from there on.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.at = [0] * len(runs)
        self.head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (self.size - len(runs))
        self.agree = [0] * self.size
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.loser[node] = self._play(a, b)
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.agree[a], self.agree[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        p = common_prefix(x, y, p)
        if p == len(x) if p == len(x) or p == len(y) else x[p] < y[p]:
            self.agree[b] = p
            return a, b
        self.agree[a] = p
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in it, common prefix with the string before), in order."""
        while self.head[self.winner] is not None:
            r = self.winner
            strings, prefixes = self.runs[r]
            i = self.at[r]
            yield r, i, self.agree[r]
            self.at[r] = i = i + 1
            self.head[r] = strings[i] if i < len(strings) else None
            self.agree[r] = prefixes[i] if i < len(strings) else 0
            node = (r + self.size) >> 1
            while node:
                r, self.loser[node] = self._play(r, self.loser[node])
                node >>= 1
            self.winner = r


def pack(entries: list[tuple[bytes, bytes, int]], first: int) -> bytes:
    """Sorted (suffix, before, multiplicity) front-coded; ``first`` is the first's number."""
    prefixes, rests, last = [], [], b""
    for s, _, _ in entries:
        p = common_prefix(last, s)
        prefixes.append(p)
        rests.append(s[p:])
        last = s
    numbers = np.array([prefixes, [len(x) for x in rests], [len(b) for _, b, _ in entries], [m for _, _, m in entries]], np.int32)
    body = struct.pack("<qq", len(entries), first) + numbers.tobytes() + b"".join(rests) + b"".join(b for _, b, _ in entries)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> tuple[int, list[bytes], list[int], list[bytes], np.ndarray]:
    """First number, suffixes, common prefixes, what stands before, multiplicities."""
    body = zstandard.ZstdDecompressor().decompress(blob)
    n, first = struct.unpack_from("<qq", body)
    prefixes, sizes, fronts, times = np.frombuffer(body, np.int32, 4 * n, 16).reshape(4, n)
    at, suffixes, last = 16 + 16 * n, [], b""
    for p, size in zip(prefixes.tolist(), sizes.tolist()):
        last = last[:p] + body[at : at + size]
        at += size
        suffixes.append(last)
    before = []
    for size in fronts.tolist():
        before.append(body[at : at + size])
        at += size
    return first, suffixes, prefixes.tolist(), before, times


def repeated_offsets(suffixes: list[bytes], prefixes: list[int], before: list[bytes], times: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Of one group, sorted by suffix, all entries different: the byte ranges, relative to
    each entry's anchor, that its repeated windows cover.

    An entry has the windows that begin ``offset`` bytes before the anchor, from
    ``length - len(suffix)`` to ``len(before)``.
    """
    m = len(suffixes)
    low, high = [length - len(s) for s in suffixes], [len(b) for b in before]
    if m == 1:
        return [[(-high[0], length - low[0])] if times[0] > 1 else []]
    offsets = np.arange(min(low), max(high) + 1)
    low, high, many = np.array(low), np.array(high), np.array(times) > 1
    backwards = [b[::-1] for b in before]
    order = sorted(range(m), key=backwards.__getitem__)
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    behind = np.array([0] + [common_prefix(backwards[i], backwards[j]) for i, j in zip(order, order[1:])])
    after = np.array([0, *prefixes[1:]])
    covered = np.zeros((m, len(offsets)), bool)
    step = max(1, (1 << 21) // m)
    for at in range(0, len(offsets), step):
        some = offsets[at : at + step]
        right = np.cumsum(after[:, None] < length - some, axis=0)
        left = np.cumsum(behind[:, None] < some, axis=0)[place]
        keys = right * (m + 1) + left
        own = (low[:, None] <= some) & (some <= high[:, None])
        keys = np.where(own, keys, -1 - np.arange(m)[:, None])
        rank = np.argsort(keys, axis=0, kind="stable")
        ranked = np.take_along_axis(keys, rank, 0)
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros_like(ranked, dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        np.put_along_axis(covered[:, at : at + step], rank, twice, 0)
        covered[:, at : at + step] |= own & many[:, None]
    found = []
    for row in covered:
        edge = np.diff(row.astype(np.int8), prepend=0, append=0)
        found.append([(-int(offsets[b - 1]), length - int(offsets[a])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
    return found


def merge(blobs: list[tuple[int, bytes]], length: int = LENGTH) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(run, entry, byte ranges) of the entries of one range that have any."""
    runs = [(run, *unpack(blob)) for run, blob in blobs]
    group: list[tuple[bytes, int, bytes, list[tuple[int, int]], int]] = []  # suffix, prefix, before, entries, times

    def close() -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        # Entries alike in suffix and in what stands before count as one.
        merged: list[list] = []
        place: dict[bytes, list] = {}
        for suffix, prefix, before, entry, times in group:
            if prefix < len(suffix) or not merged or len(merged[-1][0]) != len(suffix):
                place = {}
            if before in place:
                place[before][3].append(entry)
                place[before][4] += times
            else:
                place[before] = [suffix, prefix, before, [entry], times]
                merged.append(place[before])
        ranges = repeated_offsets([m[0] for m in merged], [m[1] for m in merged], [m[2] for m in merged], [m[4] for m in merged], length)
        for own, spans in zip(merged, ranges):
            if spans:
                for run, entry in own[3]:
                    yield run, entry, spans

    for r, i, agree in LoserTree([(suffixes, prefixes) for _, _, suffixes, prefixes, _, _ in runs]):
        if agree < length // 2 and group:
            if len(group) > 1 or group[0][4] > 1:
                yield from close()
            group = []
        run, first, suffixes, _, before, times = runs[r]
        group.append((suffixes[i], agree, before[i], (run, first + i), int(times[i])))
    if group and (len(group) > 1 or group[0][4] > 1):
        yield from close()


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs) of a text less the spans."""
    step = np.zeros(len(text) + 1, np.int32)
    if spans:
        np.add.at(step, [s for s, _ in spans], 1)
        np.add.at(step, [e for _, e in spans], -1)
    gone = np.cumsum(step[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans and
    kept (binary; ``digest``: kept_sha256 instead, so that texts without repeats need no
    exchange)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("r1", F.xxhash64("id")).withColumn("r2", F.xxhash64("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in slices(batches, "text"):
            of, found, heads = [], [], []
            for i, text in enumerate(utf8(batch, "text")):
                at, _, _, h = anchors.find(text)
                found.append(h.view(np.int64))
                of.append(np.full(len(h), i))
                # One gram in 4096 shows its first bytes, for the splitters.
                heads += [text[a : a + HEAD] if few else None for a, few in zip(at.tolist(), (h >> np.uint64(52) == 0).tolist())]
            of = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays([batch.column("r1").take(of), batch.column("r2").take(of), pa.array(np.concatenate(found)), pa.array(heads, pa.binary())], names=["r1", "r2", "h", "head"])

    every = written(rows.filter(F.octet_length("text") >= length).select("r1", "r2", "text").mapInArrow(hashes, "r1 long, r2 long, h long, head binary"))
    twice = written(every.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("head").alias("head")).filter("n > 1"))
    stats = twice.agg(F.sum("n")).first()
    ranges = max(1, -(-(stats[0] or 0) * length * 3 // 2 // RANGE_BYTES))
    heads = sorted(bytes(r["head"]) for r in twice.filter("head IS NOT NULL").orderBy("h").limit(SAMPLE).select("head").collect())
    splitters = sorted({heads[len(heads) * i // ranges] for i in range(1, ranges)}) if len(heads) >= ranges else heads
    # A document's suspected grams; each gram once a document before the join.
    own = every.select("r1", "r2", "h").distinct().join(twice.select("h"), "h").groupBy("r1", "r2").agg(F.collect_list("h").alias("hs"))
    suspected = written(rows.join(own, ["r1", "r2"]))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, task = Anchors(length), TaskContext.get().partitionId()
        entries: dict[tuple[bytes, bytes], list[tuple[int, int, int]]] = {}
        size = flushed = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal flushed
            run = (task << 24) | flushed
            flushed += 1
            listed = sorted(entries)
            part = np.array([bisect_right(splitters, s[:HEAD]) for s, _ in listed])
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                blob = pack([(*k, len(entries[k])) for k in listed[a:b]], int(a))
                yield row(int(part[a]), run, blob, [], [], [], [])
            for a in range(0, len(listed), 50_000):
                places = [(i, *p) for i in range(a, min(len(listed), a + 50_000)) for p in entries[listed[i]]]
                yield row(None, run, None, *zip(*places))

        def row(part, run, blob, numbers, r1, r2, at) -> pa.RecordBatch:
            lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in (numbers, r1, r2, at)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run], pa.int64()), pa.array([blob], pa.binary()), *lists], names=["part", "run", "blob", "entry", "p1", "p2", "at"])

        for batch in slices(batches, "text"):
            for text, hs, r1, r2 in zip(utf8(batch, "text"), batch.column("hs"), batch.column("r1").to_pylist(), batch.column("r2").to_pylist()):
                at, first, last, h = anchors.find(text)
                known = np.isin(h.view(np.int64), hs.values.to_numpy(zero_copy_only=False))
                for a, p1, p2 in zip(at[known].tolist(), first[known].tolist(), last[known].tolist()):
                    key = (text[a : p2 + length], text[p1:a])
                    if key in entries:
                        entries[key].append((r1, r2, a))
                    else:
                        entries[key] = [(r1, r2, a)]
                        size += length + length // 2
                    size += 100
                if size > RUN_BYTES:
                    yield from flush()
                    entries.clear()
                    size = 0
        if entries:
            yield from flush()

    runs = written(suspected.mapInArrow(sort, "part int, run long, blob binary, entry array<long>, p1 array<long>, p2 array<long>, at array<long>"))

    def merged(key: tuple, blobs: pa.Table) -> pa.Table:
        found = list(merge([(run, blob) for run, blob in zip(blobs.column("run").to_pylist(), blobs.column("blob").to_pylist())], length))
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), *[pa.array([[s[i] for s in f[2]] for f in found], pa.list_(pa.int64())) for i in (0, 1)]], names=["run", "entry", "starts", "ends"])

    verdicts = runs.filter("part IS NOT NULL").select("part", "run", "blob").groupBy("part").applyInArrow(merged, "run long, entry long, starts array<long>, ends array<long>")
    places = runs.filter("part IS NULL").select("run", F.explode(F.arrays_zip("entry", "p1", "p2", "at")).alias("z")).select("run", "z.entry", "z.p1", "z.p2", "z.at")
    hits = places.join(verdicts, ["run", "entry"]).select(F.col("p1").alias("r1"), F.col("p2").alias("r2"), F.explode(F.arrays_zip("starts", "ends")).alias("z"), "at")
    spans = hits.groupBy("r1", "r2").agg(F.collect_set(F.struct((F.col("at") + F.col("z.starts")).alias("start"), (F.col("at") + F.col("z.ends")).alias("end"))).alias("found"))
    some = suspected.select("r1", "r2", "id", "text").join(spans, ["r1", "r2"], "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = utf8(batch, "text")
            found = [cut(t, [(x["start"], x["end"]) for x in f or ()]) for t, f in zip(texts, batch.column("found").to_pylist())]
            kept = pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in found]) if digest else pa.array([k for k, _, _ in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int64()), kept], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    done = some.select("id", "text", "found").mapInArrow(finish, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    plain = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rest = rows.select("r1", "r2", "id", F.octet_length(plain).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), (F.sha2(plain, 256) if digest else plain).alias("kept"))
    rest = rest.join(suspected.select("r1", "r2").distinct(), ["r1", "r2"], "left_anti").drop("r1", "r2")
    return done.unionByName(rest).withColumnsRenamed({"id": id_col, "kept": "kept_sha256" if digest else "kept"})


def shared_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE) -> DataFrame:
    """(id, n_shared_runs) for the ids of documents that hold text of another: anchors of windows
    of ``words`` words, that is runs of half as many, found in two rows or more.

    Every passage of ``words`` words that two rows share has such an anchor, however short it is
    in bytes; a shared run shorter than that counts only where it is an anchor.  A-Z count as
    lower case, blanks between words as one.  A null or empty text, or one of fewer words, has
    none; equal rows share all theirs, and rows of one id are added up; a null id is an id.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(words)

        def own(text: bytes) -> np.ndarray:
            each = np.array([xxhash.xxh64_intdigest(w) for w in text.lower().split()], np.uint64)
            found = [np.zeros(0, np.uint64)]
            for start in range(0, len(each) - words + 1, SEGMENT):
                at, hashes = anchors.least(each[start : start + SEGMENT + words - 1])
                found.append(hashes[at])
            return np.unique(np.concatenate(found))

        for batch in slices(batches, "text"):
            found = [own(t) for t in utf8(batch, "text")]
            of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(of), pa.array(np.concatenate(found).view(np.int64))], names=["id", "h"])

    every = written(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, h long"))
    twice = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return every.join(twice, "h").groupBy("id").agg(F.count(F.lit(1)).alias("n_shared_runs")).withColumnRenamed("id", id_col)
