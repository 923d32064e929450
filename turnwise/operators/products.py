"""Products of the turns' sparse vectors: similarity, shared terms and strongest common concepts at any vocabulary.

Entries (turn, term, value) of a conversation are cut into cells, two blocks of turns by a bucket of terms. Inside a cell the
terms of one block look up their postings in the other and add to one sum per pair of turns; cells add up. No
turn's vocabulary is ever one value, and a pair keeps only its best few terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.cells import WIDTH, in_cells, meet
from turnwise.operators.concepts import in_sentences
from turnwise.operators.ordering import attach, block_of

CELL = 1 << 16  # entries of a block in a cell, about
PRODUCTS = 1 << 20  # single products at a time

_TOP = pa.list_(pa.struct([("minus", pa.float64()), ("term", pa.string())]))
SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("row_turn", pa.int64()), ("col_turn", pa.int64()), ("value", pa.float64()), ("top", _TOP)]
)
SUMS = "conv_id bigint, row_turn bigint, col_turn bigint, value double, top array<struct<minus:double,term:string>>"


class _Entries:
    """One side of a cell, by term."""

    def __init__(self, rows: pa.Table, terms: pa.Array) -> None:
        order = np.argsort(code := pc.index_in(rows["term"], value_set=terms).to_numpy(), kind="stable")
        self.code, self.value = code[order], rows["x"].to_numpy()[order]
        self.turns, self.turn = np.unique(rows["turn"].to_numpy()[order], return_inverse=True)
        self.start = np.searchsorted(self.code, np.arange(len(terms) + 1))


def _best(pair: np.ndarray, minus: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """Where the first ``n`` entries of each pair stand, pairs in order."""
    order = np.lexsort((term, minus, pair))
    sorted_pair = pair[order]
    first = np.searchsorted(sorted_pair, sorted_pair)
    return order[np.arange(len(order)) - first < n]


def _products(cell: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
    """Sums of products per pair of turns of a cell, with the ``n`` largest positive products."""
    side = cell["side"].to_numpy()
    own = cell["i"][0].as_py() == cell["j"][0].as_py()
    known = pc.unique(cell["term"])
    terms = known.take(pc.sort_indices(known))
    one = _Entries(cell.filter(pa.array(side == 0)), terms)
    other = one if own else _Entries(cell.filter(pa.array(side == 1)), terms)
    width = max(len(other.turns), 1)
    sums = np.zeros(len(one.turns) * width)
    met = np.zeros(len(sums), dtype=bool)
    best = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))

    length = other.start[one.code + 1] - other.start[one.code]
    edges = np.concatenate([[0], np.cumsum(length)])
    at = 0
    while at < len(one.code):
        # A posting list is at most a block long, so a step holds little more than PRODUCTS.
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + PRODUCTS, side="right")) - 1)
        some = length[at:end]
        left = np.repeat(np.arange(at, end), some)
        right = np.arange(edges[end] - edges[at]) + np.repeat(other.start[one.code[at:end]] - (edges[at:end] - edges[at]), some)
        if own:
            later = one.turn[left] < other.turn[right]
            left, right = left[later], right[later]
        pair = one.turn[left] * width + other.turn[right]
        product = one.value[left] * other.value[right]
        sums += np.bincount(pair, weights=product, minlength=len(sums))
        met[pair] = True
        if n:
            good = product > 0
            joined = [
                np.concatenate(x)
                for x in zip(best, (pair[good], -np.round(product[good], 9), one.code[left[good]]))
            ]
            kept = _best(*joined, n)
            best = tuple(x[kept] for x in joined)
        at = end

    pairs = np.flatnonzero(met)
    starts = np.searchsorted(best[0], np.append(pairs, len(sums)))
    top = pa.ListArray.from_arrays(
        pa.array(starts, pa.int32()),
        pa.StructArray.from_arrays([pa.array(best[1]), terms.take(pa.array(best[2]))], ["minus", "term"]),
    )
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([cell["conv_id"][0].as_py()] * len(pairs), pa.int64()),
            pa.array(one.turns[pairs // width]),
            pa.array(other.turns[pairs % width]),
            pa.array(sums[pairs]),
            top,
        ],
        names=SCHEMA.names,
    )


def _cells(entries: DataFrame) -> DataFrame:
    rows = entries.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "term", F.col("x").cast("double"),
        block_of("turn", WIDTH).alias("block"),
    )
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).groupBy("conv_id")
    layout = sizes.agg((F.max("block") + 1).alias("blocks"), F.expr(f"max(n) div {CELL} + 1").alias("buckets"))
    placed = attach(rows, layout)
    return meet(placed.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets"))).drop("buckets"))


def sparse_products(entries: DataFrame, n: int = 0) -> DataFrame:
    """``conv_id, row_turn, col_turn, value, top`` for the pairs of turns that share a term, earlier turn first.

    ``entries`` has ``conv_id, turn`` (dense), ``term, x``. ``value`` is the sum of the products, ``top`` the terms of the ``n``
    largest positive ones, rounded to 9 digits, then by term.
    """
    keys = ["conv_id", "i", "j", "bucket"]
    parts = in_cells(_cells(entries), keys, partial(_products, n=n), SUMS)
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, max(n, 1))
    sums = parts.groupBy("conv_id", "row_turn", "col_turn")
    if not n:
        return sums.agg(F.sum("value").alias("value"))
    return sums.agg(F.sum("value").alias("value"), F.transform(merged, lambda t: t["term"]).alias("top"))


def unit_entries(vectors: DataFrame) -> DataFrame:
    """``conv_id, turn, term, x`` from long vectors ``conv_id, turn, term, value``: every turn scaled to length 1."""
    turn = Window.partitionBy("conv_id", "turn")
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(turn))
    return vectors.select("conv_id", "turn", "term", "value", norm.alias("norm")).where("norm > 0").select(
        "conv_id", "turn", "term", (F.col("value") / F.col("norm")).alias("x")
    )


def turn_terms(base: DataFrame) -> DataFrame:
    """Every term of every turn with the value 1."""
    terms = F.explode(F.array_distinct(F.flatten("sentences"))).alias("term")
    return in_sentences(base).select("conv_id", "turn", terms).withColumn("x", F.lit(1.0))
