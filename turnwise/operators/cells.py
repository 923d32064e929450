"""Work on cells: bounded groups of rows that meet in one place, such as two blocks of turns.

Cells stream through a task one after the other, so a task holds one cell at a time and thousands of small
conversations cost no more than their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Turns per block where numpy does the work.
WIDTH = 256
# Blocks per group where whole blocks are compared.
GROUP = 256

CellFunction = Callable[[pa.Table], Iterable[pa.RecordBatch | pa.Table]]


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls are alike."""
    if len(column) < 2:
        return np.zeros(0, dtype=bool)
    differs = pc.not_equal(column[1:], column[:-1])
    nulls = column.is_null()
    return pc.fill_null(differs, pc.xor(nulls[1:], nulls[:-1])).to_numpy(zero_copy_only=False)


def split_cells(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """One table per run of rows with equal keys."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for key in keys:
            changed |= _changes(batch.column(key))
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            key = tuple(batch.column(k)[start].as_py() for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _run(batches: Iterable[pa.RecordBatch], keys: Sequence[str], function: CellFunction) -> Iterator[pa.RecordBatch]:
    for cell in split_cells(batches, keys):
        for out in function(cell):
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]


def in_cells(rows: DataFrame, keys: Sequence[str], function: CellFunction, schema: str) -> DataFrame:
    """Apply ``function`` to the rows of every combination of ``keys``."""
    placed = rows.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(partial(_run, keys=tuple(keys), function=function), schema)


def meet(rows: DataFrame, block: str = "block") -> DataFrame:
    """Rows copied to all pairs of the blocks of their conversation: ``i <= j`` and ``side`` (0 for block i).

    ``rows`` has ``conv_id`` and ``blocks``, their number; a row of a conversation with one block is not copied.
    """
    other = F.explode(F.expr("sequence(0L, blocks - 1)"))
    met = rows.withColumn("__other", other)
    return met.withColumns(
        {
            "i": F.least(block, "__other"),
            "j": F.greatest(block, "__other"),
            "side": F.when(F.col(block) > F.col("__other"), 1).otherwise(0),
        }
    ).drop("__other", block, "blocks")


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """A column of lists of ``dims`` numbers as a matrix."""
    whole = column.combine_chunks()
    flat = pc.list_flatten(whole).to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(len(whole), dims)


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a column of lists."""
    rows, dims = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * dims, pa.int32()), pa.array(values.ravel()))
