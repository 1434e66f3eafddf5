"""Cutting Arrow batches by rows and bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def slices(b: pa.RecordBatch, column: int, rows: int, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of b of at most ``rows`` rows and, beyond one row, about ``size`` bytes of the text column."""
    texts = b.column(column)
    lengths = pc.binary_length(texts).fill_null(0).to_pylist()
    lo, held = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and (i - lo >= rows or held + n > size):
            yield b.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < b.num_rows:
        yield b.slice(lo, b.num_rows - lo)
