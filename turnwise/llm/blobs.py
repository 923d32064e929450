"""Keyed numbers on their way through a shuffle, many in a row.

A task sorts its keys and sends the numbers of one range of keys as a few binary values, ``ENTRIES`` at most in each. Rows are
dealt out by range, so that all numbers of a key meet in one task, which reads range after range as a stream. The JVM moves a row
for hundreds of keys, and neither hashes nor sorts them one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ENTRIES = 1024  # of a row
ROWS = 256  # handed to the JVM at a time


def range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The range of every 64-bit key: its highest ``bits`` bits, 1 at least."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def cuts(places: np.ndarray) -> np.ndarray:
    """Where the rows begin, and the end, if ``places`` in order go into rows of one place and at most ``ENTRIES`` entries."""
    n = len(places)
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if n else np.zeros(0, dtype=np.int64)
    inside = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return np.append(np.flatnonzero(inside % ENTRIES == 0), n)


def packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Numbers as binary values, cut at ``edges``; less than 2 GB in all."""
    offsets = pa.py_buffer((edges * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, start: int, stop: int, kind: type) -> np.ndarray:
    """The numbers of rows ``start`` to ``stop``."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset + start : column.offset + stop + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets) or offsets[0] == offsets[-1]:
        return np.zeros(0, dtype=kind)
    return np.frombuffer(memoryview(data)[offsets[0] : offsets[-1]], dtype=kind).copy()


def lengths(column: pa.Array, kind: type) -> np.ndarray:
    """How many numbers each row holds; a null none."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets) // np.dtype(kind).itemsize


def handed(names: Sequence[str], arrays: Sequence[pa.Array], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """A few rows at a time."""
    whole = pa.RecordBatch.from_arrays(list(arrays), list(names))
    return (whole.slice(start, rows) for start in range(0, whole.num_rows, rows))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of one value of the first key follow each other in one task, ordered by the other keys."""
    return df.repartition(keys[0]).sortWithinPartitions(*keys)


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each batch that agree in ``key``, and its value. A run goes on in the next batch."""
    for batch in batches:
        places = batch.column(key).to_numpy()
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else []
        for start, stop in zip(starts, [*starts[1:], len(places)]):
            yield int(places[start]), batch.slice(int(start), int(stop - start))
