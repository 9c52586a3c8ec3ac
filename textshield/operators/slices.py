"""Arrow data a part at a time, so that the memory of a task does not follow the rows of its batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT_BYTES = 1 << 20  # text that a task turns into Python objects at once, or one longer text


def ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes together are at most ``most``, or one larger alone."""
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, last
        first = last


def _sizes(column: pa.Array) -> np.ndarray:
    listed = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    found = pc.list_value_length(column) if listed else pc.binary_length(column)
    return found.fill_null(0).to_numpy(zero_copy_only=False)


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a list column has about ``most`` elements in each, a text column so many bytes."""
    for batch in batches:
        for first, last in ranges(_sizes(batch.column(column)), most):
            yield batch.slice(first, last - first)


def mapped(texts: pa.Array, change: Callable, kind: pa.DataType, most: int = TEXT_BYTES) -> pa.Array:
    """A function of Python values over a text or binary column, some of them at a time."""
    parts = [pa.array([change(t) for t in texts.slice(a, b - a).to_pylist()], kind) for a, b in ranges(_sizes(texts), most)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
