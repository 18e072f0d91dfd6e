"""Rows packed into blocks of bytes, so that a pass over them in Python costs arithmetic only.

A task takes `ROWS` rows at a time, whatever its size. Rows with equal features share their place in a
block, so what depends on the features alone is computed once for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS = 1 << 18
BYTES = 1 << 26  # of features that a task holds


def taken(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, labels and weights of the columns x, y and w, many rows at a time."""
    most = max(1, min(ROWS, BYTES // (8 * max(width, 1))))
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        held.append((x, *(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "yw")))
        n += batch.num_rows
        if n >= most:
            yield tuple(np.concatenate(parts) for parts in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(parts) for parts in zip(*held))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different rows of a matrix, and which of them each row equals byte by byte."""
    n, size = len(values), values.itemsize * values.shape[1]
    padded = np.zeros((n, -(-size // 8) * 8), np.uint8)
    padded[:, :size] = np.ascontiguousarray(values).view(np.uint8).reshape(n, size)
    keys = padded.view(np.uint64 if padded.shape[1] == 8 else f"V{padded.shape[1]}").ravel()
    _, places, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return places, inverse.ravel()
