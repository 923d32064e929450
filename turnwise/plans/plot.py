"""The data of a conversation plot."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators import concepts, layout, similar
from turnwise.operators.pairs import dot, turn_pairs
from turnwise.plans.conversation import ConceptModel, Conversations, _VectorBacked
from turnwise.session import cut_lineage


class PlotTables:
    """Tables to draw the similarity of the turns of conversations.

    Args:
        similarity: ``conv_id, row_turn, col_turn, similarity`` with the diagonal.
        model: labels the cells with the concepts two turns share.
    """

    def __init__(
        self,
        conversations: Conversations,
        similarity: DataFrame,
        *,
        grouping_column: str = "speaker",
        model: ConceptModel | None = None,
        threshold: float | None = None,
        tile_padding: int = layout.TILE_PADDING,
    ) -> None:
        self.conversations = conversations
        self.long = layout.similarity_long(similarity)
        self.grouping_column = grouping_column
        self.model = model
        self.threshold = threshold
        self.tile_padding = tile_padding

    def shown(self) -> DataFrame:
        """The turns that the similarity table mentions."""
        return layout.turns_in_similarity(self.conversations.turns, self.long)

    @cached_property
    def tiles(self) -> DataFrame:
        shown = self.shown()
        return layout.tile_layout(
            shown, padding=self.tile_padding, group_column=self.grouping_column, brief=self.conversations.brief
        )

    @cached_property
    def cells(self) -> DataFrame:
        return layout.tile_attributes(self.long, self.tiles)

    def groups(self) -> DataFrame:
        return layout.plot_groups(self.tiles)

    def diagonal(self) -> DataFrame:
        return layout.diagonal_tiles(self.cells, self.conversations.turns)

    def triangles(self) -> DataFrame:
        shown = layout.similarity_threshold(self.cells, self.threshold)
        triangles = layout.similarity_triangles(shown)
        if self.model is None:
            return triangles
        return layout.cells_with_concepts(triangles, self.model.common_concepts())

    def texts(self, selected: DataFrame) -> DataFrame:
        return layout.texts_for_cells(self.conversations.turns, selected)


class ModelPlot(PlotTables):
    """The same tables straight from a model: the pairs of turns carry what is drawn.

    Size, position, group and, with ``labelled``, the concepts travel with the vector of a turn, so that similarity, tile and
    label of a cell come from one pairing, and no table of pairs is joined with anything. Pairs below a ``threshold`` above 0
    are mostly not formed.
    """

    def __init__(
        self,
        conversations: Conversations,
        model: _VectorBacked,
        *,
        labelled: bool = False,
        n_concepts: int = 5,
        grouping_column: str = "speaker",
        threshold: float | None = None,
        tile_padding: int = layout.TILE_PADDING,
    ) -> None:
        self.conversations = conversations
        self.model = model
        self.labelled = labelled
        self.n_concepts = n_concepts
        self.grouping_column = grouping_column
        self.threshold = threshold
        self.tile_padding = tile_padding

    def shown(self) -> DataFrame:
        """The turns that have a vector."""
        return self.conversations.turns.join(self.model.units.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")

    @cached_property
    def items(self) -> DataFrame:
        """One row per turn shown: its vector and what it brings to its cells."""
        units = self.model.units.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "unit")
        if self.labelled:
            units = concepts.named_units(units, self.model.lists, brief=self.model.brief)
        tiles = self.tiles.withColumn("turn", F.col("turn").cast("bigint"))
        return cut_lineage(units.join(tiles, ["conv_id", "turn"]))

    @property
    def _names(self) -> list[str]:
        return [*layout.SIDES["x"], *(["concepts"] if self.labelled else [])]

    @cached_property
    def pair_cells(self) -> DataFrame:
        """The cells of two turns of at least the threshold, with a list ``concepts`` if they are labelled."""
        names, threshold, model = self._names, self.threshold, self.model
        if threshold is not None and threshold > 0:
            pairs = similar.similar_pairs(self.items, model.dims, threshold, brief=model.brief, payload=names)
            pairs = pairs.withColumnsRenamed({"row_turn": "x_index", "col_turn": "y_index"})
        else:
            met = turn_pairs(self.items, ["unit", *names], brief=model.brief)
            sides = [F.col(f"{s}.{n}").alias(f"{s}_{n}") for s in "ab" for n in names]
            pairs = met.select(
                "conv_id", F.col("a.turn").alias("x_index"), F.col("b.turn").alias("y_index"),
                dot("a.unit", "b.unit", model.dims).alias("similarity"), *sides,
            ).filter("similarity != 0")
            pairs = pairs if threshold is None else pairs.filter(F.col("similarity") >= threshold)
        if not self.labelled:
            return layout.carried_cells(pairs, "a_", "b_")
        shared = concepts.shared_concepts("a_concepts", "b_concepts", self.n_concepts)
        return layout.carried_cells(pairs.withColumn("concepts", shared), "a_", "b_", "concepts")

    @cached_property
    def own_cells(self) -> DataFrame:
        """The cells of a turn with itself; their list of concepts is empty."""
        turn = F.col("turn")
        own = self.items.withColumns({"x_index": turn, "y_index": turn, "similarity": F.lit(1.0)})
        if not self.labelled:
            return layout.carried_cells(own, "", "")
        return layout.carried_cells(own.withColumn("concepts", F.array().cast("array<string>")), "", "", "concepts")

    @cached_property
    def cells(self) -> DataFrame:
        """All cells from the diagonal on."""
        return self.pair_cells.unionByName(self.own_cells)

    def diagonal(self) -> DataFrame:
        return layout.diagonal_tiles(self.own_cells, self.conversations.turns)

    @cached_property
    def long(self) -> DataFrame:
        return self.cells.select("conv_id", "x_index", "y_index", "similarity")

    def triangles(self) -> DataFrame:
        """The cells of two turns with their corners and, if labelled, the concepts the turns share, as text."""
        cells = layout.similarity_threshold(self.pair_cells, self.threshold)
        if not self.labelled:
            return layout.similarity_triangles(cells)
        label = layout.label(F.col("concepts"))
        return layout.similarity_triangles(cells, "concepts").withColumn("concepts", label)
