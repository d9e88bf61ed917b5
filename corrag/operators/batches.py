"""Arrow batches worked through in slices, so that a worker's memory follows the slice, not the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, characters of pages, and cells of scores that a worker holds as Python or numpy values at once.
WORDS_AT_ONCE, BYTES_AT_ONCE, CELLS_AT_ONCE = 1 << 19, 1 << 22, 1 << 22


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to ``most`` or less; a larger row stands alone."""
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, end
        start = end


def list_lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)


def text_sizes(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)


def by_slices(column: pa.Array, sizes: np.ndarray, most: int, run: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``run`` on slices of a column, its results joined."""
    parts = [run(column.slice(start, end - start)) for start, end in slices(sizes, most)]
    return pa.concat_arrays(parts) if parts else run(column)
