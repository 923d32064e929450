"""Tables behind the conversation plot: tiles on the diagonal, one cell per similar pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.text import token_count
from turnwise.operators.ordering import running_totals

TILE_PADDING = 1


def unpivot_similarity(wide: DataFrame, id_column: str, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """A square table (one column per turn, names as in ``id_column``) in long form."""
    columns = [c for c in wide.columns if c not in {*keys, id_column}]
    long = wide.unpivot([*keys, id_column], columns, "y_index", "similarity")
    return long.withColumnRenamed(id_column, "x_index")


def similarity_long(cells: DataFrame) -> DataFrame:
    """``conv_id, x_index, y_index, similarity`` with ``x_index <= y_index``."""
    return cells.select(
        "conv_id",
        F.col("row_turn").alias("x_index"),
        F.col("col_turn").alias("y_index"),
        "similarity",
    ).filter("x_index <= y_index")


def turns_in_similarity(turns: DataFrame, long: DataFrame) -> DataFrame:
    """The turns that the similarity table mentions."""
    mentioned = F.explode(F.array("x_index", "y_index")).alias("turn")
    return turns.join(long.select("conv_id", mentioned), ["conv_id", "turn"], "left_semi")


def tile_layout(
    turns: DataFrame, *, padding: int = TILE_PADDING, group_column: str = "speaker", brief: bool = False
) -> DataFrame:
    """``conv_id, turn, group, n_words, size, position`` of each turn's tile.

    ``size`` is the logarithm of the number of words; tiles follow each other with ``padding``
    between, and ``position`` is the middle of one. A turn without words has neither (null).
    ``brief`` promises that every conversation fits one block.
    """
    n_words = token_count(F.col("text"))
    size = F.when(F.col("n_words") > 0, F.ln("n_words"))
    sized = turns.select(
        "conv_id", "turn", F.col(group_column).alias("group"), n_words.alias("n_words")
    ).withColumn("size", size)
    if brief:
        earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        room = F.coalesce(F.sum(F.coalesce("size", F.lit(0.0))).over(earlier), F.lit(0.0))
        before = sized.withColumns({"index": F.count("*").over(earlier), "room": room})
    else:
        before = running_totals(
            sized,
            ["conv_id"],
            "turn",
            {"index": F.lit(1).cast("bigint"), "room": F.coalesce("size", F.lit(0.0))},
        )
    position = F.col("room") + F.col("size") / 2 + F.col("index") * padding
    return before.withColumn("position", position).drop("index", "room")


def tile_attributes(long: DataFrame, tiles: DataFrame) -> DataFrame:
    """Add size, position and group of the x and y tile to every cell, and the words of x."""
    x = tiles.select(
        "conv_id",
        F.col("turn").alias("x_index"),
        F.col("size").alias("width"),
        F.col("position").alias("x_position"),
        F.col("group").alias("x_group"),
        "n_words",
    )
    y = tiles.select(
        "conv_id",
        F.col("turn").alias("y_index"),
        F.col("size").alias("height"),
        F.col("position").alias("y_position"),
        F.col("group").alias("y_group"),
    )
    return long.join(x, ["conv_id", "x_index"], "left").join(y, ["conv_id", "y_index"], "left")


#: What a turn brings to the cells it is in, and how its x and y side call it there.
SIDES = {
    "x": {"size": "width", "position": "x_position", "group": "x_group", "n_words": "n_words"},
    "y": {"size": "height", "position": "y_position", "group": "y_group"},
}


def carried_cells(pairs: DataFrame, x: str, y: str, *others: str) -> DataFrame:
    """Cells with the attributes of both tiles from pairs that carry them, the columns starting with ``x`` and ``y``.

    The same columns as :func:`tile_attributes`, without a join.
    """
    sides = [
        F.col(f"{prefix}{name}").alias(called)
        for side, prefix in (("x", x), ("y", y))
        for name, called in SIDES[side].items()
    ]
    return pairs.select("conv_id", "x_index", "y_index", "similarity", *sides, *others)


def diagonal_tiles(cells: DataFrame, turns: DataFrame) -> DataFrame:
    """The cells of a turn with itself, with its text."""
    texts = turns.select("conv_id", F.col("turn").alias("x_index"), "text")
    return cells.filter("x_index = y_index").join(texts, ["conv_id", "x_index"], "left")


def similarity_triangles(cells: DataFrame, *others: str) -> DataFrame:
    """The cells of two different turns with the corners of their upper and lower triangle.

    The y axis runs downwards. Upper: bottom left, top left, top right. Lower: bottom left, top right,
    bottom right. ``others`` names more columns to keep.
    """
    left = F.col("x_position") - F.col("width") / 2
    right = F.col("x_position") + F.col("width") / 2
    top = F.col("y_position") - F.col("height") / 2
    bottom = F.col("y_position") + F.col("height") / 2
    kept = ["conv_id", "x_index", "y_index", "x_group", "y_group", "similarity", *others]
    return cells.filter("x_index < y_index").select(
        *kept,
        F.array(left, left, right).alias("upper_triangle_x"),
        F.array(bottom, top, top).alias("upper_triangle_y"),
        F.array(left, right, right).alias("lower_triangle_x"),
        F.array(bottom, top, bottom).alias("lower_triangle_y"),
    )


def similarity_threshold(cells: DataFrame, threshold: float | None = None) -> DataFrame:
    """The cells of at least this similarity; ``None`` stands for 0."""
    return cells.filter(F.col("similarity") >= F.lit(0.0 if threshold is None else float(threshold)))


def label(concepts: Column) -> Column:
    """A list of concepts as text."""
    return F.coalesce(F.array_join(concepts, ", "), F.lit(""))


def cells_with_concepts(cells: DataFrame, concepts: DataFrame) -> DataFrame:
    """Label every cell with the concepts its turns share, strongest first; may be empty."""
    labels = concepts.select(
        "conv_id",
        F.col("row_turn").alias("x_index"),
        F.col("col_turn").alias("y_index"),
        F.col("concepts").alias("__concepts"),
    )
    joined = cells.join(labels, ["conv_id", "x_index", "y_index"], "left")
    return joined.withColumn("concepts", label(F.col("__concepts"))).drop("__concepts")


def texts_for_cells(turns: DataFrame, selected: DataFrame) -> DataFrame:
    """The turns that are one side of a selected cell."""
    return turns_in_similarity(turns, selected)


def plot_groups(tiles: DataFrame) -> DataFrame:
    """``conv_id, group, n_groups``: the groups of a plot and how many there are."""
    groups = tiles.select("conv_id", "group").filter(F.col("group").isNotNull()).distinct()
    counts = groups.groupBy("conv_id").agg(F.count("*").alias("n_groups"))
    return groups.join(counts, "conv_id")
