"""Pairs of turns of one conversation, and the cosine similarity of their vectors.

Turns are put into small blocks and blocks meet blocks: a block pair is the unit of work, so a long
conversation spreads over the cluster, what moves is a small fraction of the pairs that come out, and
a conversation that fits one block (most do) is paired in place.

A similarity table has one row per pair by its nature. Sums over it (recurrence) do not need it: see
``operators.recurrence`` for the forms that work on the vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import binding
from turnwise.operators.ordering import PAIR_BLOCK, attach, block_of

# Dot products of up to this many dimensions are written out.
WRITTEN_OUT = 32


def _blocks(rows: DataFrame, payload: Sequence[str], width: int) -> DataFrame:
    item = F.struct("turn", *payload)
    return (
        rows.withColumn("__block", block_of("turn", width))
        .groupBy("conv_id", "__block")
        .agg(F.collect_list(item).alias("items"))
    )


def near_pairs(rows: DataFrame, payload: Sequence[str], width: int = PAIR_BLOCK) -> DataFrame:
    """``conv_id, a, b`` with ``a.turn < b.turn`` for the turns that share a block."""
    blocks = _blocks(rows, payload, width)
    first = blocks.select("conv_id", "items", F.explode("items").alias("a"))
    later = F.filter("items", lambda item: item["turn"] > F.col("a.turn"))
    return first.select("conv_id", "a", F.explode(later).alias("b"))


def _far_pairs(rows: DataFrame, payload: Sequence[str], width: int) -> DataFrame:
    """The pairs whose turns lie in different blocks."""
    blocks = _blocks(rows, payload, width)
    reach = (
        rows.groupBy("conv_id")
        .agg(
            F.min(block_of("turn", width)).alias("first"),
            F.max(block_of("turn", width)).alias("last"),
        )
        .filter("first < last")
    )
    spread = attach(blocks.withColumn("block", block_of("__block", width)), reach)
    own, other = F.col("__block"), F.col("other")
    left = (
        spread.filter(own < F.col("last"))
        .withColumn("other", F.explode(F.sequence(own + 1, F.col("last"))))
        .select("conv_id", own.alias("b1"), other.alias("b2"), F.col("items").alias("lefts"))
    )
    right = (
        spread.filter(own > F.col("first"))
        .withColumn("other", F.explode(F.sequence(F.col("first"), own - 1)))
        .select("conv_id", other.alias("b1"), own.alias("b2"), F.col("items").alias("rights"))
    )
    met = left.join(right, ["conv_id", "b1", "b2"])
    first = met.select("conv_id", "rights", F.explode("lefts").alias("a"))
    return first.select("conv_id", "a", F.explode("rights").alias("b"))


def turn_pairs(
    rows: DataFrame, payload: Sequence[str], *, brief: bool = False, width: int = PAIR_BLOCK
) -> DataFrame:
    """Every pair of turns of a conversation once: ``conv_id, a, b``, earlier turn first.

    ``rows`` has ``conv_id``, ``turn`` (dense) and the payload columns, which travel in ``a`` and ``b``.
    ``brief`` promises that every conversation fits one block (``ordering.all_brief``).
    """
    near = near_pairs(rows, payload, width)
    return near if brief else near.unionByName(_far_pairs(rows, payload, width))


def dot(a: str, b: str, dims: int | None = None) -> Column:
    """Sum of products of two columns of arrays of doubles.

    With a known, moderate number of dimensions it is written out, which compiles to plain arithmetic.
    """
    if dims is not None and dims <= WRITTEN_OUT:
        return F.expr(" + ".join(["0D", *[f"{a}[{i}] * {b}[{i}]" for i in range(dims)]]))
    return dot_arrays(F.col(a), F.col(b))


def dot_arrays(a: Column, b: Column) -> Column:
    """The same for any two array expressions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)


def unit_vectors(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Scale every vector to length 1 (column ``unit``); zero vectors have no direction and go."""
    exact = F.col(column).cast("array<double>")
    scaled = binding(
        F.sqrt(dot_arrays(exact, exact)),
        lambda norm: F.when(norm > 0, F.transform(exact, lambda x: x / norm)),
    )
    return vectors.withColumn("unit", scaled).filter("unit IS NOT NULL").drop(column)


def pairwise_similarity(
    units: DataFrame, *, dims: int | None = None, diagonal: bool = False, brief: bool = False
) -> DataFrame:
    """``conv_id, row_turn, col_turn, similarity``: the upper triangle of the symmetric matrix.

    Cells that are absent are zero. ``diagonal`` adds each turn with itself.
    """
    pairs = turn_pairs(units.select("conv_id", "turn", "unit"), ["unit"], brief=brief)
    cells = pairs.select(
        "conv_id",
        F.col("a.turn").alias("row_turn"),
        F.col("b.turn").alias("col_turn"),
        dot("a.unit", "b.unit", dims).alias("similarity"),
    ).filter("similarity != 0")
    return cells.unionByName(own_cells(units)) if diagonal else cells


def own_cells(units: DataFrame) -> DataFrame:
    """The cells of each turn with itself."""
    return units.select(
        "conv_id",
        F.col("turn").alias("row_turn"),
        F.col("turn").alias("col_turn"),
        F.lit(1.0).alias("similarity"),
    )
