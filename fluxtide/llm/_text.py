"""What the text operators share: slicing of Arrow batches, words, scratch tables.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  ``bytes.split`` cuts at exactly
those six bytes and ``bytes.lower`` changes A-Z alone, so both work on UTF-8 as it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame

from ..sources.store import materialise as written
from ..sources.store import materialise_by as written_by

__all__ = ["SPACE", "slices", "unused", "utf8", "word_bounds", "written", "written_by"]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column has about ``most`` bytes in each slice; a
    longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            below = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, below + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as bytes; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a text begin and end."""
    edge = np.diff(np.concatenate(([True], SPACE[raw], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
