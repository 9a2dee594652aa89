"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths over a document's words tell which n-grams occur
more than once; the share of the document's characters inside their later occurrences, and
inside lines seen before, decides.  One pass in Arrow batches, no shuffle, memory bounded by a few megabytes
of text at a time.

Defined cases: a null or empty text has no words and fails the base rule; ties cannot
arise; repeated rows are judged alike; an empty table gives an empty table; other columns
of the input are ignored by :func:`repetition_signals` and passed through unchanged by
:func:`keep_unrepetitive`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, utf8, word_bounds

# Published limits on the share of characters in repeated n-grams.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, dup_ngram_share double, base_failed boolean, kept boolean"
_FIELDS = [x.split() for x in SIGNALS.split(", ")]
_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _covered(keys: np.ndarray, n: int, words: int, first: bool) -> np.ndarray:
    """Which words lie in an n-gram that occurs at least twice; ``first``: in its first
    occurrence as well."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return np.zeros(words, bool)
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    if first:
        twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    step = np.zeros(words + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: bytes, ngram_limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> tuple:
    """The signals of one text, in the order of SIGNALS."""
    raw = np.frombuffer(text, np.uint8)
    words = text.split()
    n = len(words)
    starts, ends = word_bounds(raw)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    chars = points[ends] - points[starts]
    total = int(chars.sum())
    symbols = int(SYMBOLS[raw].sum())

    dup_lines = dup_chars = 0
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if not line.strip():
            continue
        if line in seen:
            dup_lines += 1
            dup_chars += len(b"".join(line.split()).decode("utf-8", "replace"))
        else:
            seen.add(line)

    repeated, share, over = 0, 0.0, False
    if n >= 3:
        number: dict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        # Exact: with ids below 2**21 three of them fit one key; else pairs are numbered first.
        if len(number) < 1 << 21:
            keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:
            pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
            keys = pairs[:-1] * len(number) + ids[2:]
        mask = _covered(keys, 3, n, first=True)
        repeated = int(mask.sum())
        if repeated:  # a repeated longer n-gram holds a repeated 3-gram
            codes = _mix((ids + 1).astype(np.uint64) * _BASE)
            rolled, length = codes, 1
            for size in sorted(ngram_limits):
                if n < size:
                    break
                while length < size:
                    rolled = rolled[:-1] * _BASE + codes[length:]
                    length += 1
                mask = _covered(_mix(rolled), size, n, first=False)
                if not mask.any():
                    break
                part = float(chars[mask].sum()) / total
                share = max(share, part)
                over |= part > ngram_limits[size]
    line_share = dup_chars / total if total else 0.0
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    kept = not (failed or over or line_share > line_limit)
    return n, total, symbols, dup_lines, repeated, line_share, share, failed, kept


def _signals(batch: pa.RecordBatch, text: str, limits: dict, line_limit: float) -> list[pa.Array]:
    found = [measure(x, limits, line_limit) for x in utf8(batch, text)]
    return [pa.array(list(x), _ARROW[kind]) for x, (_, kind) in zip(zip(*found), _FIELDS)]


def repetition_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row per input row: the id, the signals, the base rule and the verdict."""
    limits = dict(ngram_limits or NGRAM_LIMITS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [id_col, *(n for n, _ in _FIELDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_signals(batch, "text", limits, line_limit)], names=names)

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, {SIGNALS}")


def keep_unrepetitive(docs: DataFrame, text_col: str = "text", ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows that pass, with all their columns."""
    limits = dict(ngram_limits or NGRAM_LIMITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            kept = _signals(batch, text_col, limits, line_limit)[-1]
            yield batch.filter(pc.fill_null(kept, False))

    return docs.mapInArrow(run, docs.schema)
