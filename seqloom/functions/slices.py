"""Arrow batches taken a part at a time: a batch has up to 10,000 rows of any length, and what is made of them on the way takes several times
their room."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Elements of lists, and rows, that are worked on at once.
ELEMENTS, ROWS = 200_000, 256


def _parts(columns: Sequence[pa.Array], elements: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Starts and stops of parts whose lists, of all columns, hold fewer than so many elements beside their first row, and of at most so many rows."""
    n = len(columns[0])
    lengths = sum((pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns if pa.types.is_list(c.type)), np.zeros(n, np.int64))
    new = np.diff(np.cumsum(lengths) // elements) != 0
    if rows:
        new |= np.diff(np.arange(n) // rows) != 0
    return pairwise([0, *(np.flatnonzero(new) + 1).tolist(), n])


def by_elements(batch: pa.RecordBatch, column: int = 1, elements: int = ELEMENTS) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose lists hold fewer than so many elements beside their first row."""
    for start, stop in _parts([batch.column(column)], elements):
        yield batch.slice(start, stop - start)


def objects(column: pa.Array) -> list:
    """A column of strings, or of lists of them, as Python objects; whole buffers are converted, not value by value."""
    if pa.types.is_list(column.type):
        flat, ends = objects(column.flatten()), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
        return [flat[a:b] if known else None for (a, b), known in zip(pairwise([0, *ends]), column.is_valid().to_pylist(), strict=True)]
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()


def row_by_row(f: Callable[..., dict], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``f`` of each row as an array of ``kind``; few rows, and few elements of long lists, are Python objects at a time."""
    parts = (zip(*(objects(c.slice(start, stop - start)) for c in columns), strict=True) for start, stop in _parts(columns, ELEMENTS, ROWS))
    return pa.concat_arrays([pa.array([f(*row) for row in part], kind) for part in parts])
