"""Text columns of Arrow batches as bytes, a bounded number at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_bytes(column: pa.Array) -> tuple[np.ndarray, pa.Buffer | None]:
    """Where each text of ``column`` (without nulls) begins and ends, and the buffer that holds them."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return edges, column.buffers()[2]


def ranges(edges: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``size`` bytes together; a longer text is alone."""
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + size, "right")) - 1)
        yield a, b
        a = b
