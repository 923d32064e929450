"""Pairs of turns of at least a given similarity, without forming the others.

The product of two unit vectors is at most the sum over dimensions of the products of the largest values there
(per-dimension maxima) and, once some dimensions are added up, at most that sum plus the product of the norms
of the rest (residual norms). Extents of whole blocks of turns, by dimension and by angle, tell which blocks have to meet
at all; in a pair of blocks dimensions are added from the strongest on, and a pair is given up as soon as its bound falls below the threshold.
What is left is summed in the order of the dimensions, so values equal those of :mod:`turnwise.operators.pairs`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.cells import GROUP, WIDTH, in_cells, matrix, meet
from turnwise.operators.ordering import attach, block_of

SLACK = 1e-9  # bounds are rounded, too
STEP = 8  # dimensions added between two looks at the bounds

PAIRS = "conv_id bigint, row_turn bigint, col_turn bigint, similarity double"
FORMED = "conv_id bigint, pairs bigint, formed bigint, similar bigint"


def _extents(cell: pa.Table, dims: int) -> Iterator[pa.RecordBatch]:
    """Largest and least value of every dimension of a block, its middle direction and the widest angle from it."""
    m = matrix(cell["unit"], dims)
    middle = m.sum(axis=0)
    norm = np.linalg.norm(middle)
    middle = middle / norm if norm > 0 else m[0]
    angle = np.arccos(np.clip(m @ middle, -1.0, 1.0)).max()
    yield pa.RecordBatch.from_pylist(
        [{"conv_id": cell["conv_id"][0].as_py(), "block": cell["block"][0].as_py(), "high": m.max(axis=0).tolist(),
          "low": m.min(axis=0).tolist(), "middle": middle.tolist(), "angle": float(angle)}]
    )


def _two(cell: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The two sides of a cell; of one block, twice the same."""
    side = cell["side"].to_numpy()
    one = cell.filter(pa.array(side == 0))
    if cell["i"][0].as_py() == cell["j"][0].as_py():
        return one, one, True
    return one, cell.filter(pa.array(side == 1)), False


def _blocks_that_meet(cell: pa.Table, dims: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks whose extents allow a similar pair."""
    one, other, own = _two(cell)
    high, low, middle = ([matrix(side[c], dims) for side in (one, other)] for c in ("high", "low", "middle"))
    bounds = np.zeros((len(one), len(other)))
    for d in range(dims):
        ends = [np.multiply.outer(x[0][:, d], y[1][:, d]) for x in (high, low) for y in (high, low)]
        bounds += np.max(ends, axis=0)
    angle = np.arccos(np.clip(middle[0] @ middle[1].T, -1.0, 1.0))
    apart = angle - one["angle"].to_numpy()[:, None] - other["angle"].to_numpy()[None, :]
    meets = np.minimum(bounds, np.cos(np.maximum(apart, 0.0))) >= threshold - SLACK
    a, b = one["number"].to_numpy(), other["number"].to_numpy()
    if own:
        meets &= a[:, None] < b[None, :]
    x, y = np.nonzero(meets)
    conv = pa.array([cell["conv_id"][0].as_py()] * len(x), pa.int64())
    yield pa.RecordBatch.from_arrays([conv, pa.array(a[x]), pa.array(b[y])], names=["conv_id", "i", "j"])


def _candidates(left: np.ndarray, right: np.ndarray, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs that no bound rules out, and how many were taken up after the first look."""
    peak = np.abs(left).max(axis=0) * np.abs(right).max(axis=0)
    order = np.argsort(-peak, kind="stable")
    left, right = left[:, order], right[:, order]
    # Norms of what follows each dimension, and the bound by the maxima of the other block.
    rest = [np.sqrt(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]) for m in (left, right)]
    high = np.abs(right).max(axis=0)
    reach = np.cumsum((np.abs(left) * high)[:, ::-1], axis=1)[:, ::-1]
    dims = left.shape[1]
    least = threshold - SLACK

    def open_pairs(sums: np.ndarray, a, b, done: int) -> np.ndarray:
        if done == dims:
            return sums >= least
        return sums + np.minimum(rest[0][a, done] * rest[1][b, done], reach[a, done]) >= least

    done = min(STEP, dims)
    sums = left[:, :done] @ right[:, :done].T
    rows, columns = np.arange(len(left))[:, None], np.arange(len(right))[None, :]
    alive = open_pairs(sums, rows, columns, done)
    if own:
        alive = np.triu(alive, 1)
    a, b = np.nonzero(alive)
    formed, kept = len(a), sums[a, b]
    while done < dims and len(a):
        end = min(done + STEP, dims)
        kept = kept + np.einsum("ij,ij->i", left[a, done:end], right[b, done:end])
        done = end
        alive = open_pairs(kept, a, b, done)
        a, b, kept = a[alive], b[alive], kept[alive]
    return a, b, formed


def _similar(
    cell: pa.Table, dims: int, threshold: float, report: bool, payload: Sequence[str] = ()
) -> Iterator[pa.RecordBatch]:
    # Within a block the earlier turn stands first.
    one, other, own = _two(cell.sort_by("turn"))
    left, right = matrix(one["unit"], dims), matrix(other["unit"], dims)
    if not len(left) or not len(right):
        return
    a, b, formed = _candidates(left, right, threshold, own)
    value = np.zeros(len(a))
    for d in range(dims):
        value += left[a, d] * right[b, d]
    near = value >= threshold
    a, b, value = a[near], b[near], value[near]
    conv_id = cell["conv_id"][0].as_py()
    if report:
        pairs = len(left) * (len(left) - 1) // 2 if own else len(left) * len(right)
        yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "pairs": pairs, "formed": formed, "similar": len(a)}])
        return
    x, y = one.take(pa.array(a)), other.take(pa.array(b))
    columns = [pa.array([conv_id] * len(a), pa.int64()), x["turn"], y["turn"], pa.array(value)]
    carried = [side[c] for side in (x, y) for c in payload]
    names = ["conv_id", "row_turn", "col_turn", "similarity", *[f"{s}_{c}" for s in "ab" for c in payload]]
    yield from pa.table([*columns, *carried], names=names).to_batches()


def _cells(units: DataFrame, dims: int, threshold: float, brief: bool, payload: Sequence[str] = ()) -> DataFrame:
    """The turns in the pairs of blocks that may hold a similar pair: ``conv_id, i, j, side, turn, unit``."""
    if not threshold > 0:
        raise ValueError("only a threshold above 0 rules pairs out")
    block = F.lit(0).cast("bigint") if brief else block_of("turn", WIDTH)
    rows = units.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "unit", *payload, block.alias("block"))
    same = rows.select("*", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side")).drop("block")
    if brief:
        return same
    kind = "conv_id bigint, block bigint, high array<double>, low array<double>, middle array<double>, angle double"
    extents = in_cells(rows.drop(*payload), ["conv_id", "block"], partial(_extents, dims=dims), kind)
    ends = extents.groupBy("conv_id").agg(F.max("block").alias("last")).where("last > 0")
    grouped = extents.withColumn("number", F.col("block")).withColumn("block", block_of("block", GROUP))
    groups = attach(grouped, ends).withColumn("blocks", F.expr(f"last div {GROUP} + 1"))
    met = in_cells(
        meet(groups.drop("last")),
        ["conv_id", "i", "j"],
        partial(_blocks_that_meet, dims=dims, threshold=threshold),
        "conv_id bigint, i bigint, j bigint",
    )
    sides = F.inline(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")),
                             F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))))
    far = rows.join(met.select("conv_id", "i", "j", sides), ["conv_id", "block"])
    return same.unionByName(far.drop("block"))


def similar_pairs(
    units: DataFrame, dims: int, threshold: float, *, brief: bool = False, payload: Sequence[str] = ()
) -> DataFrame:
    """``conv_id, row_turn, col_turn, similarity`` of the pairs of turns with at least this similarity, which is above 0.

    ``units`` is a table ``conv_id, turn, unit`` with ``dims`` numbers a vector; ``brief`` promises that every conversation
    fits one block. Blocks whose extents rule a similar pair out are not even brought together.
    The ``payload`` columns of both turns come along, as ``a_<name>`` and ``b_<name>``.
    """
    work = partial(_similar, dims=dims, threshold=float(threshold), report=False, payload=tuple(payload))
    kinds = {c: units.schema[c].dataType.simpleString() for c in payload}
    schema = ", ".join([PAIRS, *[f"{s}_{c} {kinds[c]}" for s in "ab" for c in payload]])
    return in_cells(_cells(units, dims, threshold, brief, payload), ["conv_id", "i", "j"], work, schema)


def pairs_formed(units: DataFrame, dims: int, threshold: float, *, brief: bool = False) -> DataFrame:
    """What :func:`similar_pairs` does per conversation: ``conv_id, pairs, formed, similar``.

    ``pairs`` are those in blocks that met, ``formed`` those left after the first dimensions, ``similar`` the result.
    """
    work = partial(_similar, dims=dims, threshold=float(threshold), report=True)
    counts = in_cells(_cells(units, dims, threshold, brief), ["conv_id", "i", "j"], work, FORMED)
    return counts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("pairs", "formed", "similar")])
