"""Token counts without tokens: Viterbi over a unigram vocabulary that carries, at each
position of a text, only the best score and the number of pieces on the best path.

An Aho-Corasick automaton lists the vocabulary pieces ending at a position, longest first.
Ties follow the public unigram tokenizers: a later candidate must be strictly better, so of
equal paths the one whose last piece is longest stays.  A character that is no piece itself
may stand as an unknown, at the lowest score less ten; it counts as its UTF-8 bytes where
the vocabulary falls back to bytes, else a run of unknowns counts once.

The text is marked as those tokenizers do: blanks become U+2581, one is put in front.  If no
piece holds a mark behind another character, the text falls apart before marks, and where no
piece holds a newline, around newlines; the best path passes there anyway.  Parts recur, so
each task counts a part once and remembers it.  (Scores are summed part by part: whole-number
scores, as in the default vocabulary, are exact.)

Defined cases: a null or empty text has no tokens and score 0; repeated rows are treated
alike; an empty table gives an empty table; other columns are ignored.  No shuffle; the
memory of a task is one slice of text and at most ``REMEMBERED`` parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 400_000
MARK = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces with scores, and whether unknown characters fall back to bytes."""

    pieces: dict[str, float]
    bytes_fallback: bool = True

    @staticmethod
    def read(path: str = MODEL) -> Vocabulary:
        """From a public tokenizer file; only its ordinary pieces take part."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in ids}, any(map(model.is_byte, range(model.get_piece_size()))))

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "bytes_fallback": self.bytes_fallback}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            found.add_word(piece, (len(piece), score))
        found.make_automaton()
        return found

    @cached_property
    def singles(self) -> set[str]:
        return {p for p in self.pieces if len(p) == 1}

    @cached_property
    def unknown(self) -> float:
        return min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def cuts(self) -> re.Pattern | None:
        """Parts that no piece crosses; None if there are none for sure."""
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            return None
        apart = not any("\n" in p for p in self.pieces) and "\n" not in self.singles and self.bytes_fallback
        return re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if apart else f"{MARK}*[^{MARK}]+|{MARK}+")

    def best(self, part: str) -> tuple[int, float]:
        """(pieces, score) of the best path through one part."""
        n, lowest = len(part), float("-inf")
        score, count = [0.0] + [lowest] * n, [0] * (n + 1)
        if self.singles.issuperset(part):
            for end, (length, value) in self.automaton.iter(part):
                reached = score[end + 1 - length] + value
                if reached > score[end + 1]:
                    score[end + 1], count[end + 1] = reached, count[end + 1 - length] + 1
            return count[n], score[n]
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(part):
            ends[end].append(match)
        strange = [False] * (n + 1)
        for end in range(n):
            for length, value in ends[end]:
                reached = score[end + 1 - length] + value
                if reached > score[end + 1]:
                    score[end + 1], count[end + 1] = reached, count[end + 1 - length] + 1
            if part[end] not in self.singles and score[end] + self.unknown > score[end + 1]:
                score[end + 1], strange[end + 1] = score[end] + self.unknown, True
                more = len(part[end].encode("utf-8", "replace")) if self.bytes_fallback else int(not strange[end])
                count[end + 1] = count[end] + more
        return count[n], score[n]


class Remembered(dict):
    """part -> (pieces, score), emptied when full."""

    def __init__(self, vocabulary: Vocabulary, most: int = REMEMBERED):
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, part: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        found = self[part] = self.vocabulary.best(part)
        return found


def count_one(text: str | None, known: Remembered) -> tuple[int, float]:
    if not text:
        return 0, 0.0
    marked, cuts = MARK + text.replace(" ", MARK), known.vocabulary.cuts
    if cuts is None:
        return known.vocabulary.best(marked)
    found = [known[p] for p in cuts.findall(marked)]
    return sum([n for n, _ in found]), float(sum([s for _, s in found]))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, score (of the best path)."""
    vocabulary = vocabulary or Vocabulary.read()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(vocabulary)
        for batch in slices(batches, "text"):
            found = [count_one(t, known) for t in batch.column("text").to_pylist()]
            columns = [batch.column("id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_tokens long, score double")
