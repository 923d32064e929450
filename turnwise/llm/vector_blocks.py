"""A stated set of queries against all vectors, block against block."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 13
BLOCK_QUERIES = 1 << 11


def usable(vectors: DataFrame, id_column: str, vector_column: str, *, zero: bool = True) -> DataFrame:
    """``id``, ``vector`` (doubles) of the rows that take part: an id, and only finite components.

    Rows with a null id, a null or empty vector, or a null, infinite or NaN component are left out; with
    ``zero=False`` all-zero vectors too.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & finite)
    return kept if zero else kept.where(F.exists("vector", lambda x: x != 0))


def _blocks(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def each_pair_of_blocks(
    vectors: DataFrame,
    queries: DataFrame,
    function: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    *,
    home: bool = False,
) -> DataFrame:
    """Call ``function`` with every block of queries and every block of vectors.

    Blocks are dealt by a hash of the id, so they are about equal in size whatever the data; a task holds one
    block of each. With ``home`` a block of queries meets one block of vectors only.
    """
    n, q = vectors.count(), queries.count()
    row_blocks, query_blocks = _blocks(n, BLOCK_ROWS), _blocks(q, BLOCK_QUERIES)

    def dealt(df: DataFrame, blocks: int) -> DataFrame:
        return df.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def to_all(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = dealt(queries, query_blocks).withColumnRenamed("own", "query_block")
    right = dealt(vectors, row_blocks).withColumnRenamed("own", "row_block")
    if home:
        left = left.withColumn("row_block", F.col("query_block") % row_blocks)
        right = right.withColumn(
            "query_block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(query_blocks - 1)), lambda b: b % row_blocks == F.col("row_block")))
        )
    else:
        left = left.withColumn("row_block", to_all(row_blocks))
        right = right.withColumn("query_block", to_all(query_blocks))
    keys = ["query_block", "row_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(function, schema)


def matrix(table: pa.Table, width: int | None = None) -> np.ndarray:
    """The vectors of a block, one per row; a shorter vector ends in zeros."""
    column = table.column("vector").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy()
    sizes = np.diff(column.offsets.to_numpy())
    wide = max(width or 0, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide)[None, :] < sizes[:, None]] = flat
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query, ties to the smaller id."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
