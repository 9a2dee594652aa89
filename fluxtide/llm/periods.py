"""Periodic runs of words, found with recompression and grammar LCE queries.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and
at least ``max(LEAST, 2 * q)`` words that no neighbouring word extends keeping period q.

Texts are numbered words; many texts of like length are laid side by side as one sequence, with
a symbol of its own after each.

1. *Recompression.*  Rounds alternate: block compression replaces each maximal stretch ``aa...a``
   by one symbol, pair compression deals symbols to two classes by a hash and replaces each
   left symbol with the right one after it.  What a symbol stands for depends on its neighbours
   alone, so equal stretches are compressed alike but at their ends.  The levels are the run-length
   grammar of the sequence: each has its symbols, their parents and each parent's first child.
2. *LCE by the grammar.*  How far two places agree: at each level the two step on symbol by
   symbol (in a block, by the shorter rest of the two) until both stand where a parent begins,
   which is after a few steps, and go up; where symbols differ they go down to the first words
   that differ.  All queries of a batch climb and descend together as numpy arrays.  The same
   levels read from the right give extensions to the left.
3. *Harmonic grid.*  A run of period p holds two places i and i + p, i a multiple of
   max(LEAST - p, p).  Grid places whose words agree are the candidates: n/6 + n/7 + ... places
   a text of n words.  A candidate's exact extensions to both sides give the run.  A run met
   under a multiple of its period is the same stretch, so the smallest period stays.

No suffix array is built.  Extensions are exact: symbols are named by sorting, not by hashes.
The hash that parts left from right symbols changes the grammar's shape only.

Defined cases: a null or empty text, or one without words, has no run and keeps nothing;
repeated rows, ties and null ids are rows like any other; very long texts stand alone in a
sequence; an empty table gives an empty table; columns beside the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import slices, utf8

LEAST = 12
WORDS = 1 << 19
PENDING = 1 << 20
TOP = 32

RUNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Grammar:
    """The levels of a sequence: ``symbols[k]``, ``up[k]`` (each symbol's parent in level k + 1)
    and ``first[k]`` (each parent's first child, and the end).  Levels from even k are blocks,
    from odd k pairs."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.up, self.first = [symbols.astype(np.int64)], [], []
        fresh = int(symbols.max(initial=-1)) + 1
        while len(self.symbols[-1]) > TOP and len(self.up) < 120:
            s, blocks = self.symbols[-1], len(self.up) % 2 == 0
            begins = np.ones(len(s), bool)
            if blocks:
                begins[1:] = s[1:] != s[:-1]
            else:
                left = _mixed(s, len(self.up)) & 1 == 0
                begins[1:] = ~(left[:-1] & ~left[1:])
            first = np.append(np.flatnonzero(begins), len(s))
            size = np.diff(first)
            heads, many = s[first[:-1]].copy(), np.flatnonzero(size > 1)
            if len(many):
                # Only what was compressed is named anew; other symbols keep their names.
                tail = size[many] if blocks else s[first[many] + 1]
                names = _named(heads[many], tail)
                heads[many] = fresh + names
                fresh += int(names.max()) + 1
            self.up.append(np.cumsum(begins) - 1)
            self.first.append(first)
            self.symbols.append(heads)

    def reversed(self) -> Grammar:
        """The same levels read from the right."""
        other = object.__new__(Grammar)
        other.symbols = [s[::-1] for s in self.symbols]
        other.up = [len(f) - 2 - u[::-1] for u, f in zip(self.up, self.first)]
        other.first = [f[-1] - f[::-1] for f in self.first]
        return other

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on agree, for i < j."""
        x, y = i.astype(np.int64).copy(), j.astype(np.int64).copy()
        stopped = np.full(len(x), -1)  # the level at which symbols differ
        live, top = np.arange(len(x)), len(self.up)
        for k in range(top + 1):
            live = self._along(k, x, y, live, stopped, climbing=k < top)
            if k < top:
                x[live], y[live] = self.up[k][x[live]], self.up[k][y[live]]
            if not len(live):
                break
        for k in range(int(stopped.max(initial=0)), 0, -1):
            down = np.flatnonzero(stopped == k)
            for z in (x, y):
                z[down] = self.first[k - 1][z[down]]
            self._along(k - 1, x, y, down, stopped, climbing=False)
        return x - i

    def _along(self, k: int, x: np.ndarray, y: np.ndarray, live: np.ndarray, stopped: np.ndarray, climbing: bool) -> np.ndarray:
        """Steps on at level k until symbols differ, which sets ``stopped``, or, when climbing,
        until both places begin a parent; returns those queries."""
        s, n, risen = self.symbols[k], len(self.symbols[k]), []
        blocks = k % 2 == 0 and k < len(self.up)
        while len(live):
            a, b = x[live], y[live]
            if climbing:
                f, u = self.first[k], self.up[k]
                ready = (f[u[np.minimum(a, n - 1)]] == a) & (f[u[np.minimum(b, n - 1)]] == b) & (b < n)
                risen.append(live[ready])
                live, a, b = live[~ready], a[~ready], b[~ready]
            # The sequence ends in a symbol of its own, so a place at the end agrees with none.
            same = (b < n) & (s[np.minimum(a, n - 1)] == s[np.minimum(b, n - 1)])
            stopped[live[~same]] = k
            live, a, b = live[same], a[same], b[same]
            if blocks:
                f, u = self.first[k], self.up[k]
                by = np.minimum(f[u[a] + 1] - a, f[u[b] + 1] - b)
            else:
                by = 1
            x[live], y[live] = a + by, b + by
        return np.concatenate(risen) if risen else live


def _mixed(s: np.ndarray, salt: int) -> np.ndarray:
    x = (s.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.int64)


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs, by sorting."""
    span = int(b.max()) + 1
    if int(a.max()) < (1 << 62) // span:
        return np.unique(a * span + b, return_inverse=True)[1]
    return np.unique(np.stack([a, b], 1), axis=0, return_inverse=True)[1].ravel()


def _candidates(s: np.ndarray, text: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, p): grid places whose words p apart agree, in one text; some ``PENDING`` at a time."""
    places, periods, held = [], [], 0
    for p in range(1, longest // 2 + 1):
        step = max(LEAST - p, p)
        at = np.flatnonzero(s[: len(s) - p : step] == s[p::step]) * step
        if len(at):
            at = at[text[at] == text[at + p]]
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), p))
            held += len(at)
            if held >= PENDING:
                yield np.concatenate(places), np.concatenate(periods)
                places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, given as its words' numbers, its runs (start, length, period) by start,
    then period."""
    sizes = np.array([len(t) for t in texts])
    if not len(texts) or int(sizes.max()) < LEAST:
        return [np.zeros((0, 3), np.int64) for _ in texts]
    most = max(int(t.max(initial=-1)) for t in texts) + 1
    s = np.concatenate([x for k, t in enumerate(texts) for x in (t, [most + k])]).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    grammar = back = None
    found = []
    for i, p in _candidates(s, text, int(sizes.max())):
        if grammar is None:
            grammar = Grammar(s)
            back = grammar.reversed()
        right = grammar.lce(i, i + p)
        # Of a long run many grid places tell; the run is extended to the left from each.
        left = back.lce(len(s) - i - p, len(s) - i)
        start, length = i - left, left + right + p
        ok = length >= np.maximum(LEAST, 2 * p)
        found.append(_smallest(np.stack([start, length, p], 1)[ok]))
    runs = _smallest(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
    order = np.lexsort((runs[:, 2], runs[:, 0]))
    runs = runs[order]
    of = text[runs[:, 0]]
    runs = runs - np.stack([begins[of], np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)], 1)
    return np.split(runs, np.searchsorted(of, np.arange(1, len(texts))))


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[fresh]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for the words that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """The places of the original words that stand at 0, 1, ...: texts of one id in ten get a
    periodic tail, by the id's CRC-32.  A null id leaves the text as it is."""
    places = np.arange(n)
    if doc_id is None or not n:
        return places
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(places >= a, a + (places - a) % p, places)


def _digest(text: list[bytes], runs: np.ndarray) -> tuple:
    listed = "".join(f"{a},{b},{p}\n" for a, b, p in runs.tolist())
    kept = np.flatnonzero(kept_words(len(text), runs)).tolist() if len(runs) else range(len(text))
    shown = (None,) * 4
    if len(runs):
        a, b, p = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        shown = a, b, p, 1000 * b // p
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(runs), *shown, sha(listed.encode()), sha(b" ".join([text[i] for i in kept]))


def _by_length(sizes: list[int]) -> Iterator[list[int]]:
    """Texts of like length (within a factor of two) together, ``WORDS`` words at a time."""
    classes: dict[int, list[int]] = {}
    for k, n in enumerate(sizes):
        classes.setdefault(n.bit_length(), []).append(k)
    for members in classes.values():
        group, held = [], 0
        for k in members:
            if group and held + sizes[k] > WORDS:
                yield group
                group, held = [], 0
            group.append(k)
            held += sizes[k] + 1
        yield group


def _numbered(words: list[list[bytes]]) -> list[np.ndarray]:
    flat = pa.array([w for t in words for w in t], pa.large_binary()).dictionary_encode()
    numbers = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(numbers, np.cumsum([len(t) for t in words])[:-1])


def runs_of_texts(words: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, in the given order."""
    numbers = _numbered(words) if words else []
    out: list = [None] * len(words)
    for group in _by_length([len(t) for t in words]):
        for k, runs in zip(group, find_runs([numbers[k] for k in group])):
            out[k] = runs
    return out


def _over_texts(docs: DataFrame, id_col: str, text_col: str, schema: str, row: Callable[[list[bytes], np.ndarray], tuple], change: Callable[[int | None, int], np.ndarray] | None) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            words = [t.split() for t in utf8(batch, text_col)]
            if change is not None:
                words = [[t[i] for i in change(d, len(t)).tolist()] for d, t in zip(batch.column(id_col).to_pylist(), words)]
            rows = [row(t, r) for t, r in zip(words, runs_of_texts(words))]
            found = [pa.array(list(x), t) for x, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *found], names=names)

    types = [{"long": pa.int64(), "string": pa.string()}.get(x.split()[1], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))) for x in schema.split(", ")]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed): every run, and the text's words without those that a run holds
    after its first period, joined by one space."""

    def row(text: list[bytes], runs: np.ndarray) -> tuple:
        listed = [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()]
        return listed, b" ".join([text[i] for i in np.flatnonzero(kept_words(len(text), runs)).tolist()]).decode()

    return _over_texts(docs, id_col, text_col, "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", row, None)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, int], np.ndarray] | None = None) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the
    longest run and digests of all.  ``change`` gives, for an id and a number of words, the
    places of the words that the text is taken to have."""
    return _over_texts(docs, id_col, text_col, RUNS, _digest, change)
