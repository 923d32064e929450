import math

import pytest

from turnwise import ConceptModel, Conversations, PlotTables
from turnwise.operators import layout


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(0, 0, "a", "one two three"), (0, 1, "b", ""), (0, 2, "a", "one"), (0, 3, "b", "one two")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string")


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(0, 0, 0, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (0, 0, 2, 0.5), (0, 0, 3, 0.9)]
    return spark.createDataFrame(rows, "conv_id bigint, row_turn bigint, col_turn bigint, similarity double")


def test_tiles(turns):
    tiles = {r["turn"]: r for r in layout.tile_layout(turns).collect()}
    a, d = math.log(3), math.log(2)
    assert tiles[0]["position"] == pytest.approx(a / 2)
    assert tiles[1]["size"] is None and tiles[1]["position"] is None
    assert tiles[2]["position"] == pytest.approx(a + 0 + 2)
    assert tiles[3]["position"] == pytest.approx(a + d / 2 + 3)


def test_plot_tables(spark, turns, cells):
    plot = PlotTables(Conversations(turns, dense=True), cells, threshold=0.6)
    assert sorted(r["turn"] for r in plot.tiles.collect()) == [0, 2, 3]
    triangle = plot.triangles().collect()
    assert [(r["x_index"], r["y_index"]) for r in triangle] == [(0, 3)]
    a, d = math.log(3), math.log(2)
    middle = a + d / 2 + 2
    assert triangle[0]["upper_triangle_x"] == pytest.approx([0, 0, a])
    assert triangle[0]["upper_triangle_y"] == pytest.approx([middle + d / 2, middle - d / 2, middle - d / 2])
    assert triangle[0]["lower_triangle_x"] == pytest.approx([0, a, a])
    assert triangle[0]["lower_triangle_y"] == pytest.approx([middle + d / 2, middle - d / 2, middle + d / 2])
    assert {r["x_index"]: r["text"] for r in plot.diagonal().collect()}[2] == "one"
    selected = plot.long.filter("similarity = 0.5")
    assert sorted(r["turn"] for r in plot.texts(selected).collect()) == [0, 2]
    assert {(r["group"], r["n_groups"]) for r in plot.groups().collect()} == {("a", 2), ("b", 2)}


def test_labels(spark):
    rows = [(0, 0, "a", "red green"), (0, 1, "b", "red green"), (0, 2, "a", "pink")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string")
    data = Conversations(turns, dense=True, stopwords=[])
    model = ConceptModel(data, 3, 1)
    plot = PlotTables(data, model.conversation_similarity(diagonal=True), model=model)
    labels = {(r["x_index"], r["y_index"]): r["concepts"] for r in plot.triangles().collect()}
    assert labels == {(0, 1): "green, red"}


def test_square_tables(spark):
    wide = spark.createDataFrame([("A", 1.0, 0.9), ("B", 0.9, 1.0)], "id string, A double, B double")
    long = layout.unpivot_similarity(wide, "id").collect()
    assert {(r["x_index"], r["y_index"]): r["similarity"] for r in long}[("A", "B")] == 0.9


def test_threshold(cells):
    long = layout.similarity_long(cells)
    assert layout.similarity_threshold(long).count() == 5
    assert layout.similarity_threshold(long, 0.9).count() == 4
