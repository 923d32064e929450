"""Exact top-k search by inner product with MaxScore.

Every dimension is a term. In a block of vectors a term of the query has a least and a largest contribution;
counted from the least one all contributions are non-negative, as in a posting list. Terms are sorted by the
largest contribution. The longest run of small ones whose bounds together cannot reach the
threshold is non-essential: only the essential terms are traversed, then the others are probed from the largest
down for the vectors that can still reach the threshold.

The threshold of a query starts at its k-th best score in one block, so that no other block begins
without one, and only rises. Scores are integers and exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.vector_blocks import each_pair_of_blocks, matrix, ranked, usable
from turnwise.llm.written import written

LONG = (1 << 63) - 1
PROBE = 4  # non-essential terms between two looks at the threshold


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as whole doubles."""
    return np.floor(values * float(scale))


def _exact(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every partial sum is exact in doubles, else as Python integers."""
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if most < 2.0**53:
        return queries, rows
    whole = np.vectorize(int, otypes=[object])
    return whole(queries), whole(rows)


def block_search(query: np.ndarray, terms: np.ndarray, low: np.ndarray, high: np.ndarray, threshold) -> tuple[np.ndarray, np.ndarray]:
    """The columns of ``terms`` (a row per dimension) that may score ``threshold`` or more, and their scores."""
    bounds = np.stack((query * low, query * high))
    least, most = bounds.min(axis=0), bounds.max(axis=0)
    order = np.argsort(most - least, kind="stable")  # from the smallest bound up
    rising = np.cumsum((most - least)[order])
    split = 0
    if threshold is not None and terms.dtype != object:
        split = int(np.searchsorted(rising, threshold - least.sum(), side="left"))
    essential, rest = order[split:], order[:split][::-1]
    columns = np.arange(terms.shape[1])
    score = np.zeros(terms.shape[1], dtype=terms.dtype)
    for d in essential.tolist():
        if query[d]:
            score += terms[d] * query[d]
    for start in range(0, len(rest), PROBE):
        left = most[rest[start:]].sum()
        able = score + left >= threshold
        if not able.all():
            columns, score = columns[able], score[able]
        for d in rest[start : start + PROBE].tolist():
            if query[d]:
                score = score + terms[d, columns] * query[d]
    if threshold is not None:
        able = score >= threshold
        columns, score = columns[able], score[able]
    return columns, score


def _search(k: int, scale: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_query, out_vec, out_score = [], [], []
        if left.num_rows and right.num_rows:
            rows = matrix(right)
            queries = matrix(left, rows.shape[1])
            if queries.shape[1] > rows.shape[1]:
                rows = matrix(right, queries.shape[1])
            queries, rows = _exact(integers(queries, scale), integers(rows, scale))
            ids = right.column("id").to_numpy()
            terms = np.ascontiguousarray(rows.T)
            low, high = terms.min(axis=1), terms.max(axis=1)
            known = left.column("threshold").to_pylist()
            for i, query_id in enumerate(left.column("id").to_pylist()):
                columns, score = block_search(queries[i], terms, low, high, known[i])
                other = ids[columns] != query_id
                columns, score = columns[other], score[other]
                if len(columns) > k:
                    kth = np.sort(score)[-k]
                    near = score >= kth
                    columns, score = columns[near], score[near]
                best = np.lexsort((ids[columns], -score))[:k]
                out_query += [query_id] * len(best)
                out_vec += ids[columns[best]].tolist()
                out_score += [max(-LONG - 1, min(LONG, int(x))) for x in score[best]]
        return pa.table(
            {
                "query_id": pa.array(out_query, pa.int64()),
                "vec_id": pa.array(out_vec, pa.int64()),
                "score": pa.array(out_score, pa.int64()),
            }
        )

    return run


def maxscore_search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` highest integer inner products of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components are taken as ``floor(scale * x)`` in double precision. Candidates are all rows of ``vectors`` but
    those with the id of the query; all are returned if there are fewer than ``k``. Ties go to the smaller id.

    Rows with a null id, and vectors that are null, empty, or hold null or non-finite components take no part. A shorter
    vector ends in zeros. Repeated rows are candidates of their own; repeated queries are one. Scores beyond a
    long are held at its ends. Other columns are not looked at. Empty tables give an empty result.
    """
    rows = usable(vectors, id_column, vector_column)
    asked = usable(queries, id_column, vector_column).distinct()
    schema = "query_id long, vec_id long, score long"
    search = _search(k, scale)
    no_bound = asked.withColumn("threshold", F.lit(None).cast("long"))
    first = each_pair_of_blocks(rows, no_bound, search, schema, home=True)
    bound = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("threshold"))
    bound = bound.where(F.col("found") >= k).select(F.col("query_id").alias("id"), "threshold")
    begun = written(asked.join(bound, "id", "left"), "queries")
    return ranked(each_pair_of_blocks(rows, begun, search, schema), k)
