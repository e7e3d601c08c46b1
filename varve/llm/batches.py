"""Arrow batches in small slices, so that Python objects of one slice at a time are alive."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sized_slices(batches: Iterable[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes; a larger row comes alone."""
    for batch in slices(batches, rows):
        step = max(batch.num_rows * size // max(batch.nbytes, 1), 1)
        yield from slices([batch], step)
