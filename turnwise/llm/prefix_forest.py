"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree gives every vector a long string of sign bits and keeps a sorted array of them. A query descends
to its longest matching prefix in every tree; then all trees ascend together, one bit at a time, until the
ranges below the common prefix length hold enough candidates. Candidates are scored exactly.

Vectors get one more component that brings them all to the greatest norm of the block, so that a larger
inner product is a smaller angle. The hyperplanes are drawn from a seed, so nothing is fitted; every row is in the index. Each block of
vectors has its own forest, built where the block lies, and every query visits all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnwise.llm.vector_blocks import each_pair_of_blocks, matrix, ranked, usable

TREES = 64
BITS = 24
CANDIDATES = 0.75  # entries to gather per row of the block, counted in all trees
SEED = 20


def _lifted(rows: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(axis=1)
    return np.column_stack((rows, np.sqrt(np.maximum(square.max() - square, 0.0))))


class Forest:
    """The trees over the rows of one block."""

    def __init__(self, rows: np.ndarray, trees: int, bits: int, seed: int):
        self.bits = bits
        rows = _lifted(rows)
        draw = np.random.default_rng(seed)
        self.planes = draw.standard_normal((trees, rows.shape[1], bits))
        self.order, self.codes = [], []
        for plane in self.planes:
            code = self._code(rows, plane)
            order = np.argsort(code, kind="stable")
            self.order.append(order)
            self.codes.append(code[order])

    def _code(self, rows: np.ndarray, plane: np.ndarray) -> np.ndarray:
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return (rows @ plane > 0) @ weights

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each prefix length, tree and query: the range of the array below the prefix of the query."""
        low = np.empty((self.bits + 1, len(self.codes), len(queries)), dtype=np.int64)
        high = np.empty_like(low)
        queries = np.column_stack((queries, np.zeros(len(queries))))
        for t, (codes, plane) in enumerate(zip(self.codes, self.planes)):
            code = self._code(queries, plane)
            for length in range(self.bits + 1):
                shift = self.bits - length
                prefix = code >> shift
                low[length, t] = np.searchsorted(codes, prefix << shift)
                high[length, t] = np.searchsorted(codes, (prefix + 1) << shift)
        return low, high


def candidates(forest: Forest, queries: np.ndarray, enough: int):
    """For each query the rows below the longest common prefix length at which all trees hold enough."""
    low, high = forest.ranges(queries)
    held = (high - low).sum(axis=1)
    lengths = np.maximum((held >= enough).sum(axis=0) - 1, 0)  # held falls as prefixes grow
    for i, length in enumerate(lengths.tolist()):
        mark = np.zeros(len(forest.codes[0]), dtype=bool)
        a, b = low[length, :, i].tolist(), high[length, :, i].tolist()
        for order, start, stop in zip(forest.order, a, b):
            mark[order[start:stop]] = True
        yield np.flatnonzero(mark)


def _distinct(rows: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different vectors of a block, and for each its ``most`` smallest ids: no more can be among the nearest."""
    vectors, group = np.unique(rows, axis=0, return_inverse=True)
    group = group.reshape(-1)
    order = np.lexsort((ids, group))
    cuts = np.searchsorted(group[order], np.arange(1, len(vectors)))
    return vectors, [x[:most] for x in np.split(ids[order], cuts)]


def _search(k: int, trees: int, bits: int, share: float, seed: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_query, out_vec, out_score = [], [], []
        if left.num_rows and right.num_rows:
            rows = matrix(right)
            queries = matrix(left, rows.shape[1])
            if queries.shape[1] > rows.shape[1]:
                rows = matrix(right, queries.shape[1])
            # Copies of a vector fall into the same place of every tree: they count, and are scored, as one.
            rows, ids = _distinct(rows, right.column("id").to_numpy(), k + 1)
            forest = Forest(rows, trees, bits, seed)
            enough = min(len(rows) * trees, max(trees * k, int(share * len(rows))))
            found = candidates(forest, queries, enough)
            for query_id, query, near in zip(left.column("id").to_pylist(), queries, found):
                others = sum(int((ids[i] != query_id).sum()) for i in near[: k + 2].tolist())
                if others < k and len(near) < len(rows):
                    near = np.arange(len(rows))  # up to the roots of the trees: the query alone is no neighbour
                score = rows[near] @ query
                if len(near) > k + 1:  # one of them may be the query itself
                    kth = np.partition(score, len(score) - k - 1)[-k - 1]
                    near = near[score >= kth - 1e-9 * max(1.0, abs(kth))]
                score = (rows[near] * query).sum(axis=1)  # row by row: equal vectors score equally
                score = np.repeat(score, [len(ids[i]) for i in near.tolist()])
                held = np.concatenate([ids[i] for i in near.tolist()])
                score, held = score[held != query_id], held[held != query_id]
                best = np.lexsort((held, -score))[:k]
                out_query += [query_id] * len(best)
                out_vec += held[best].tolist()
                out_score += score[best].tolist()
        return pa.table(
            {
                "query_id": pa.array(out_query, pa.int64()),
                "vec_id": pa.array(out_vec, pa.int64()),
                "score": pa.array(out_score, pa.float64()),
            }
        )

    return run


def prefix_forest_search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    trees: int = TREES,
    bits: int = BITS,
    candidates: float = CANDIDATES,
    seed: int = SEED,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """About the ``k`` largest inner products of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Candidates are all rows of ``vectors`` but those with the id of the query; a query gets ``k`` rows wherever there are
    as many. A higher share of ``candidates`` or more
    ``trees`` find more of the true neighbours; on vectors without any clusters the defaults find over nine
    tenths. Scores are exact, ties go to the smaller id.

    Rows with a null id, and vectors that are null, empty, all zero, or hold null or non-finite components take no part. A
    shorter vector ends in zeros. Repeated rows are candidates of their own; repeated queries are one. Other columns are
    not looked at. Empty tables give an empty result.
    """
    rows = usable(vectors, id_column, vector_column, zero=False)
    asked = usable(queries, id_column, vector_column, zero=False).distinct()
    found = each_pair_of_blocks(
        rows, asked, _search(k, trees, bits, candidates, seed), "query_id long, vec_id long, score double"
    )
    return ranked(found, k)
