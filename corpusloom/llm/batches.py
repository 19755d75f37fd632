"""Cutting Arrow batches by size of text, so that memory follows characters and not rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

MOST = 4_000_000  # characters handled at once; a longer text is handled by itself


def by_size(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` characters, or of one row. Empty batches are left out."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        if ends[-1] <= most:
            yield batch
            continue
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
