"""What the operators share: whole-text columns, Arrow batches, kept results and intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.durable import materialize as stored  # noqa: F401

BATCH_BYTES = 32 << 20
SLICE = 8 << 20  # bytes of text whose distinct words are looked up together
KEPT_LENGTH = 64


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names of our own beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def free_names(columns: list[str], *wanted: str) -> tuple[str, ...]:
    """The wanted names, each with as many underscores in front as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return tuple(found)


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most about `limit` bytes, one row at least, so that long texts fit in memory."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit // max(limit, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Kept(dict):
    """Key -> `make(key)`, remembered in two generations of bounded size.

    When full, the entries kept become the older generation; those met again come back from there,
    so frequent ones are never made twice.
    """

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size = make, size
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = made
        return made


def gather(values: np.ndarray, first: np.ndarray, n: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `values[first[c] : first[c] + n[c]]` of all codes one after another, and where each ends."""
    each = n[code]
    ends = np.cumsum(each)
    place = np.repeat(first[code] - ends + each, each)
    place += np.arange(len(place))
    return values[place], ends
