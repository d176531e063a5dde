"""Arrow batches in parts of bounded size, for functions that make Python objects of texts.

An Arrow batch has a bounded number of rows, not of bytes, and Python workers live on between tasks, so their peaks add up.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of which Python objects are made at a time; a longer text is handled alone and whole.
PART_BYTES = 1 << 20


def ranges(columns: list[pa.Array], most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Begin and length of consecutive rows whose strings stay near `most` bytes; one row at least."""
    n = len(columns[0]) if columns else 0
    sizes = np.full(n, 16, dtype=np.int64)
    for column in columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, end - at
        at = end


def by_parts(texts: pa.Array, make: Callable[[list[str | None]], pa.Array], kind: pa.DataType) -> pa.Array:
    """`make` over the texts, a part at a time."""
    parts = [make(texts.slice(at, n).to_pylist()) for at, n in ranges([texts])]
    out = pa.concat_arrays(parts) if parts else pa.array([], kind)
    del parts
    give_back()
    return out


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
