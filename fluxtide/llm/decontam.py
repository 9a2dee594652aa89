"""Benchmark decontamination by latent semantic retrieval.

1. One scan counts in how many documents each word of the benchmark stands, over all documents,
   and takes a sample of windows of the corpus, about ``SAMPLE`` of them at any corpus size.
2. Benchmark passages (windows of 64 words) and the sampled windows become TF-IDF rows; a
   randomised SVD of both, its products summed over partitions, gives the latent space.  Its
   rank is far below the number of rows, so words that keep the same company fall together;
   passages weigh ``EMPHASIS`` times a window, so that what tells them apart stays.
3. Every document is cut into windows of 64 words, 32 apart; one whose latent vector has
   the cosine and the share of a passage is a candidate.
4. A candidate is confirmed by the longest common subsequence of words of the passage and
   the window's surroundings: ``same`` of the passage or more, or ``alike`` of it and its
   answer (the passage's last sentence).

A benchmark is taken in blocks of ``block`` passages: what is broadcast is bounded by that,
and a larger benchmark costs more passes, not more memory.

Words are runs outside ``[\\x20\\x09-\\x0D]``, in lower case, without marks at their ends.

Defined cases: a null or empty text, of a document or an item, has no words and matches
nothing; items equal in text each match; repeated rows are treated alike; equal scores need
no order, since all that pass count; empty tables give no matches; other columns are
ignored, or passed on by :func:`drop_contaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, utf8, written

WINDOW, STEP = 64, 32
BLOCK_PASSAGES, RANK, OVERSAMPLE = 256, 160, 10
TOGETHER = 8  # blocks that a pass searches: some fifty MB of indexes
SAMPLE, EMPHASIS = 4096, 4.0
VOCABULARY = 1_000_000
COSINE, SHARE = 0.35, 0.3
SAME, ALIKE = 0.8, 0.6
COMMON = 0.1
EDGES = b".,;:!?\"'()[]{}|*_-"
BLOCK = 512


def lowered(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def words_of(text: bytes) -> list[bytes]:
    return [x for w in lowered(text).split() if (x := w.strip(EDGES))]


def answer_of(text: bytes) -> list[bytes]:
    """The words of the last sentence."""
    parts = [p for p in map(words_of, re.split(rb"[.?!\n:]+(?=\s|$)", text)) if p]
    return parts[-1] if parts else []


@dataclass(frozen=True)
class Passage:
    item: object
    words: tuple[bytes, ...]
    answer: tuple[bytes, ...]


def passages_of(item: object, text: bytes) -> list[Passage]:
    words, answer = words_of(text), answer_of(text)
    starts = range(0, max(1, len(words) - STEP), STEP) if len(words) > WINDOW else (0,)
    found = [words[s : s + WINDOW] for s in starts if words]
    return [Passage(item, tuple(w), tuple(answer) if i == len(found) - 1 and len(answer) <= len(w) else ()) for i, w in enumerate(found)]


class Known(dict):
    """Written word -> feature, -1 if none; emptied when full."""

    def __init__(self, features: dict[bytes, int], most: int = 300_000):
        self.features, self.most = features, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.features.get(word.strip(EDGES), -1) if word.strip(EDGES) else -2
        return found


def _places(texts: list[bytes], known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words one after the other (-1: none), and where each text begins."""
    flat: list[int] = []
    starts = []
    for text in texts:
        starts.append(len(flat))
        flat += [k for w in lowered(text).split() if (k := known[w]) != -2]
    return np.array(flat, np.int64), np.array([*starts, len(flat)], np.int64)


def document_frequencies(docs: DataFrame, text_col: str, features: dict[bytes, int], every: int = 0) -> tuple[np.ndarray, int, list[list[int]]]:
    """Documents with each feature, all documents, and, of one document in ``every`` by a hash
    of its text, the features of a window of words at a place that the hash chooses.  Copies
    count once in the sample, in a task as in all, so its size is that of distinct texts."""
    shared, n = docs.sparkSession.sparkContext.broadcast(features), len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, rows, sampled = Known(shared.value), np.zeros(n + 1, np.int64), 0, {}
        for batch in slices(batches, "text"):
            places, starts = _places(utf8(batch, "text"), known)
            of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            has = places >= 0
            found[:n] += np.bincount(np.unique(of[has] * n + places[has]) % n if n else [], minlength=n)[:n].astype(np.int64)
            rows += batch.num_rows
            if every:
                draw = batch.column("draw").to_numpy().view(np.uint64)
                for i in np.flatnonzero(draw % np.uint64(every) == 0):
                    if int(draw[i]) in sampled:  # a copy
                        continue
                    own = places[starts[i] : starts[i + 1]]
                    at = int(draw[i] // np.uint64(every)) % max(1, len(own) - WINDOW + 1)
                    own = own[at : at + WINDOW]
                    sampled[int(draw[i])] = own[own >= 0].tolist()
        found[n] = rows
        some = np.flatnonzero(found)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some]), pa.nulls(len(some), kind)], names=["feature", "df", "window"])
        if sampled:
            yield pa.RecordBatch.from_arrays([pa.array([-1 - (x >> 2) for x in sampled], pa.int64()), pa.nulls(len(sampled), pa.int64()), pa.array(list(sampled.values()), kind)], names=["feature", "df", "window"])

    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("draw")).mapInArrow(run, "feature long, df long, window array<long>")
    counted = rows.groupBy("feature").agg(F.sum("df").alias("df"), F.first("window", True).alias("window")).collect()
    found = np.zeros(n + 1, np.int64)
    for r in counted:
        if r["feature"] >= 0:
            found[r["feature"]] = r["df"]
    return found[:n], int(found[n]), sorted(list(r["window"]) for r in counted if r["window"])


def _summed(rows: DataFrame, width: int, product) -> np.ndarray:
    """The sum over partitions of ``product(row places, features, weights)``, a matrix of
    this width, added up block by block of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            lists = batch.column("features")
            of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            part = product(of, lists.flatten().to_numpy(zero_copy_only=False), batch.column("weights").flatten().to_numpy(zero_copy_only=False), len(lists))
            total = part if total is None else total + part
        if total is not None:
            starts = range(0, len(total), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([s // BLOCK for s in starts], pa.int64()), pa.array([total[s : s + BLOCK].tobytes() for s in starts], pa.binary())], names=["block", "part"])

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in parts.column("part"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

    blocks = rows.mapInArrow(run, "block long, part binary").groupBy("block").applyInArrow(add, "block long, part binary").collect()
    return np.concatenate([np.frombuffer(bytes(b["part"]), np.float64).reshape(-1, width) for b in sorted(blocks, key=lambda b: b["block"])])


def latent_space(rows: DataFrame, features: int, passages: int, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Right singular vectors (features, k) of the sparse rows (features, weights): a random
    range of the row space, one power step, then the small Gram matrix's eigenvectors."""
    width = min(rank + OVERSAMPLE, features, passages + OVERSAMPLE)
    start = np.random.default_rng(seed).standard_normal((features, width))

    def dense(of: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
        out = np.zeros((n, basis.shape[1]))
        np.add.at(out, of, weight[:, None] * basis[at])
        return out

    basis = start
    for _ in range(2):

        def back(of, at, weight, n, basis=basis):
            out = np.zeros((features, basis.shape[1]))
            np.add.at(out, at, weight[:, None] * dense(of, at, weight, n, basis)[of])
            return out

        basis = np.linalg.qr(_summed(rows, width, back))[0]

    def gram(of, at, weight, n, basis=basis):
        own = dense(of, at, weight, n, basis)
        return own.T @ own

    power, turn = np.linalg.eigh(_summed(rows, width, gram))
    best = np.argsort(-power)[:rank]
    best = best[power[best] > 1e-9 * max(power.max(), 1e-300)]
    return basis @ turn[:, best]


def common_words(short: tuple[bytes, ...], masks: dict[bytes, int], text: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: masks has, for each
    word of ``short``, the bits of its places."""
    full = (1 << len(short)) - 1
    row, get = full, masks.get
    for word in text:
        if m := get(word):
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(short) - row.bit_count()


def _masks(words: tuple[bytes, ...]) -> dict[bytes, int]:
    found: dict[bytes, int] = {}
    for i, w in enumerate(words):
        found[w] = found.get(w, 0) | 1 << i
    return found


@dataclass
class Index:
    """One block of passages in their latent space."""

    passages: list[Passage]
    features: dict[bytes, int]
    project: np.ndarray  # feature -> idf * latent, float32
    latent: np.ndarray  # passage -> latent vector
    cosine: float = COSINE
    share: float = SHARE
    same: float = SAME
    alike: float = ALIKE

    def __post_init__(self):
        self.norm = np.linalg.norm(self.latent, axis=1)
        self.masks = [(_masks(p.words), _masks(p.answer)) for p in self.passages]

    def candidates(self, texts: list[bytes], known: Known, most: int = 8192) -> Iterator[tuple[int, int, int, float]]:
        """(text, window, passage, cosine) of all windows near a passage."""
        places, starts = _places(texts, known)
        at = np.flatnonzero(places >= 0)
        if not len(at):
            return
        of = np.searchsorted(starts, at, "right") - 1
        window = (at - starts[of]) // STEP
        both = np.concatenate((window, window - 1))
        keys, tokens = np.concatenate((of, of)) << 32 | np.maximum(both, 0), np.concatenate((at, at))
        keys, tokens = keys[both >= 0], tokens[both >= 0]
        order = np.argsort(keys, kind="stable")
        keys, tokens = keys[order], places[tokens[order]]
        edges = np.concatenate((np.flatnonzero(np.diff(keys, prepend=-1)), [len(keys)]))
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + most, "right")) - 1)
            own = np.add.reduceat(self.project[tokens[edges[a] : edges[b]]], edges[a:b] - edges[a], axis=0)
            dots = own @ self.latent.T
            length = np.linalg.norm(own, axis=1)
            i, j = np.nonzero((dots >= self.share * self.norm**2) & (dots >= self.cosine * length[:, None] * self.norm) & (dots > 0))
            for w, p in zip(i, j):
                key = int(keys[edges[a + w]])
                yield key >> 32, key & 0xFFFFFFFF, int(p), float(dots[w, p] / (length[w] * self.norm[p]))
            a = b

    def matches(self, texts: list[bytes], known: Known) -> dict[tuple[int, object], tuple[float, float, bool]]:
        """(text, item) -> best cosine, share of common words, whether the answer is there."""
        found: dict[tuple[int, object], tuple[float, float, bool]] = {}
        cut: dict[int, list[bytes]] = {}
        for text, window, p, cosine in self.candidates(texts, known):
            if text not in cut:
                cut = {text: words_of(texts[text])}
            near = cut[text][max(0, window * STEP - STEP) : window * STEP + WINDOW + STEP]
            passage, (masks, answer) = self.passages[p], self.masks[p]
            ratio = common_words(passage.words, masks, near) / len(passage.words)
            if ratio < self.alike:
                continue
            told = bool(passage.answer) and common_words(passage.answer, answer, near) >= self.same * len(passage.answer)
            if ratio >= self.same or told:
                key = (text, passage.item)
                before = found.get(key, (0.0, 0.0, False))
                found[key] = (max(cosine, before[0]), max(ratio, before[1]), told or before[2])
        return found


def indexes(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rank: int = RANK, block: int = BLOCK_PASSAGES) -> Iterator[Index]:
    """The benchmark's blocks, one after the other.  Items come to the driver a block at a
    time; what is kept of a block is at most ``block`` passages of 64 words, and of all of them
    their words' frequencies and the sample."""
    items = lambda: benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).toLocalIterator()
    vocabulary = sorted({w for row in items() for w in words_of((row["text"] or "").encode())})
    if not vocabulary:
        return
    every = max(1, docs.count() // SAMPLE)
    df, windows, n = np.zeros(0, np.int64), [], 0
    for at in range(0, len(vocabulary), VOCABULARY):  # one scan for a million words
        part, n, found = document_frequencies(docs, text_col, {w: i for i, w in enumerate(vocabulary[at : at + VOCABULARY])}, 0 if at else every)
        df, windows = np.concatenate((df, part)), windows or found
    frequency = dict(zip(vocabulary, df.tolist()))
    sample = [[vocabulary[i] for i in w] for w in windows]
    passages: list[Passage] = []
    for row in items():
        for passage in passages_of(row["item"], (row["text"] or "").encode()):
            passages.append(passage)
            if len(passages) == block:
                yield _index(docs, passages, frequency, n, sample, rank)
                passages = []
    if passages:
        yield _index(docs, passages, frequency, n, sample, rank)


def _index(docs: DataFrame, block: list[Passage], frequency: dict[bytes, int], n: int, sample: list[list[bytes]], rank: int) -> Index:
    features = {w: i for i, w in enumerate(sorted({w for p in block for w in p.words}))}
    df = np.array([frequency[w] for w in features])
    weight = np.log((1.0 + n) / (1.0 + df)) + 1e-3
    # Words of every tenth document (and ten more, for small tables) say little; they stay
    # where a passage has few others.
    rare = df <= COMMON * n + 10
    needed = {w for p in block if sum(rare[features[w]] for w in set(p.words)) < 5 for w in p.words}
    weight[[i for w, i in features.items() if not rare[i] and w not in needed]] = 0.0
    used = {w: i for w, i in features.items() if weight[i] > 0}

    def row(words, times: float) -> tuple[list[int], list[float]]:
        own: dict[int, float] = {}
        for w in words:
            if w in used:
                own[used[w]] = own.get(used[w], 0.0) + times * float(weight[used[w]])
        return list(own), list(own.values())

    rows = [row(p.words, 1.0) for p in block]
    fitted = [row(p.words, EMPHASIS) for p in block] + [r for w in sample if (r := row(w, 1.0))[0]]
    frame = docs.sparkSession.createDataFrame(fitted, "features array<int>, weights array<double>").repartition(8)
    space = latent_space(frame, len(features), len(fitted), rank)
    latent = np.array([np.asarray(w) @ space[f] if f else np.zeros(space.shape[1]) for f, w in rows])
    return Index(block, used, (weight[:, None] * space).astype(np.float32), latent.astype(np.float32))


def together(found: Iterator[Index], most: int = TOGETHER) -> Iterator[list[Index]]:
    """Indexes of several blocks, which one pass over the documents searches."""
    group: list[Index] = []
    for index in found:
        group.append(index)
        if len(group) == most:
            yield group
            group = []
    if group:
        yield group


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", rank: int = RANK, block: int = BLOCK_PASSAGES) -> DataFrame:
    """One row per document row and item found in it: id, item, cosine, lcs_share, answer."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, cosine double, lcs_share double, answer boolean"
    found = docs.sparkSession.createDataFrame([], schema)
    for group in together(indexes(docs, benchmark, text_col, item_col, rank=rank, block=block)):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = [Known(index.features) for index in shared.value]
            for batch in slices(batches, "text"):
                texts = utf8(batch, "text")
                for index, words in zip(shared.value, known):
                    hits = list(index.matches(texts, words).items())
                    if not hits:
                        continue
                    columns = [batch.column("id").take(pa.array([t for (t, _), _ in hits])), pa.array([i for (_, i), _ in hits]), *(pa.array(list(x)) for x in zip(*(v for _, v in hits)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "cosine", "lcs_share", "answer"])

        found = found.unionByName(rows.mapInArrow(run, schema))
    # A long item has several passages, maybe in two blocks.
    best = found.groupBy("id", "item").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"), F.max("answer").alias("answer"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "cosine", "lcs_share", "answer")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", rank: int = RANK, block: int = BLOCK_PASSAGES) -> DataFrame:
    """The input rows in which no item is found, with all their columns."""
    out = None
    for group in together(indexes(docs, benchmark, text_col, item_col, rank=rank, block=block)):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = [Known(index.features) for index in shared.value]
            for batch in slices(batches, text_col):
                texts = utf8(batch, text_col)
                hit = {t for index, words in zip(shared.value, known) for t, _ in index.matches(texts, words)}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)]))

        # Groups are passes of their own: a task never has more than one group's indexes.
        out = (docs if out is None else written(out)).mapInArrow(run, docs.schema)
    return docs if out is None else out
