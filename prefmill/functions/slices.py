"""Arrow columns a part at a time, where Python objects made of them take many times their room."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a column that are turned into Python objects at once.
SLICE_BYTES = 1 << 20


def sliced(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The column in consecutive parts of at most ``most`` bytes; a longer value is a part of its own."""
    if len(column) <= 1 or column.nbytes <= most:
        yield column
    else:
        half = len(column) // 2
        yield from sliced(column.slice(0, half), most)
        yield from sliced(column.slice(half), most)
