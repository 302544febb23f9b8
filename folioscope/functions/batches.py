"""Arrow batches of texts in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that a slice has about ``most_bytes`` of ``column`` or is one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        until = np.cumsum(np.asarray(sizes, np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(until, done + most_bytes, "right")))
            yield batch.slice(start, end - start)
            start, done = end, int(until[end - 1])
