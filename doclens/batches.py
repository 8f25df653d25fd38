"""Slices of Arrow batches, so that a task's Python holds few rows' worth of work at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def byte_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each string or binary value; a null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def slices(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose rows' ``sizes`` sum up to ``most``; a larger row is a slice of its own."""
    for batch in batches:
        upto = np.concatenate(([0], np.cumsum(sizes(batch), dtype=np.int64)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(upto, upto[start] + most, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
