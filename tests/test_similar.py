"""Thresholds, and all terms as key terms, against plain numpy."""

import numpy as np
import pytest

from turnwise import ConceptModel, Conversations, ModelPlot, PlotTables, VectorModel
from turnwise.operators import cells, products, similar, vectors
from turnwise.operators.cells import split_cells


def units(spark, arrays):
    """Vectors of conversations as a table of unit vectors, out of order."""
    rows = []
    for conv_id, m in enumerate(arrays):
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        rows += [(conv_id, t, v.tolist()) for t, v in enumerate(m)]
    return spark.createDataFrame(rows[::-1], "conv_id bigint, turn bigint, unit array<double>").repartition(5)


def expected(arrays, threshold):
    out = set()
    for conv_id, m in enumerate(arrays):
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
            out.add((conv_id, int(a), int(b)))
    return out


def keys(df):
    found = [tuple(r) for r in df.select("conv_id", "row_turn", "col_turn").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture(scope="module")
def given():
    draw = np.random.default_rng(3)
    drift = np.repeat(draw.normal(size=(4, 12)), 256, axis=0) + 0.15 * draw.normal(size=(1024, 12))
    sparse = draw.random((300, 12)) * (draw.random((300, 12)) < 0.2)
    sparse[:, 0] += 0.01
    return [draw.normal(size=(600, 12)), draw.normal(size=(1, 12)), drift, sparse, draw.normal(size=(40, 12))]


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.95])
def test_equals_the_filtered_full_table(spark, given, threshold):
    assert keys(similar.similar_pairs(units(spark, given), 12, threshold)) == expected(given, threshold)


def test_values_are_those_of_the_full_table(spark, given):
    from turnwise.operators.pairs import pairwise_similarity

    table = units(spark, given[3:])
    near = similar.similar_pairs(table, 12, 0.5)
    full = pairwise_similarity(table, dims=12).where("similarity >= 0.5")
    assert near.exceptAll(full).isEmpty() and full.exceptAll(near).isEmpty()


def test_rows_formed_fall_with_the_threshold(spark, given):
    table = units(spark, given).cache()
    counts = []
    for threshold in (0.3, 0.6, 0.9):
        by_conv = {r["conv_id"]: r for r in similar.pairs_formed(table, 12, threshold).collect()}
        counts.append((by_conv[0]["formed"], by_conv[2]["pairs"], by_conv[2]["formed"]))
        assert sum(r["similar"] for r in by_conv.values()) == len(expected(given, threshold))
    formed, met, drifting = zip(*counts)
    assert formed[0] > 2 * formed[1] > 10 * formed[2]
    assert drifting[0] >= drifting[1] > drifting[2]
    # The topics of the third conversation change: at a high threshold distant blocks never meet.
    assert met[0] >= met[1] >= met[2] and met[2] < 1024 * 1023 // 2


def test_one_block(spark, given):
    short = [given[1], given[4]]
    assert keys(similar.similar_pairs(units(spark, short), 12, 0.4, brief=True)) == expected(short, 0.4)


def test_groups_of_blocks(spark, given, monkeypatch):
    monkeypatch.setattr(similar, "GROUP", 2)
    assert keys(similar.similar_pairs(units(spark, given), 12, 0.6)) == expected(given, 0.6)


def test_threshold_above_zero(spark, given):
    with pytest.raises(ValueError):
        similar.similar_pairs(units(spark, given), 12, 0.0)
    empty = units(spark, given).limit(0)
    assert similar.similar_pairs(empty, 12, 0.5).count() == 0


def test_cells_are_split_at_every_key():
    import pyarrow as pa

    batches = [
        pa.record_batch({"a": [None, None, 1], "b": [1, 1, 1]}),
        pa.record_batch({"a": [1, 1, 2], "b": [1, 2, 2]}),
        pa.record_batch({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}),
        pa.record_batch({"a": [2], "b": [2]}),
    ]
    assert [t.to_pylist() for t in split_cells(batches, ["a", "b"])] == [
        [{"a": None, "b": 1}] * 2, [{"a": 1, "b": 1}] * 2, [{"a": 1, "b": 2}], [{"a": 2, "b": 2}] * 2,
    ]


# ---------------------------------------------------------------- all terms


def brute_products(entries, n):
    turns = {}
    for conv_id, turn, term, x in entries:
        turns.setdefault((conv_id, turn), {})[term] = x
    out = {}
    for (c, a), left in turns.items():
        for (d, b), right in turns.items():
            if c == d and a < b and left.keys() & right.keys():
                each = {t: left[t] * right[t] for t in left.keys() & right.keys()}
                top = sorted((-round(p, 9), t.encode(), t) for t, p in each.items() if p > 0)[:n]
                out[c, a, b] = (round(sum(each.values()), 9), [t for _, _, t in top])
    return out


@pytest.mark.parametrize("cell", [1 << 16, 20])
def test_sparse_products(spark, monkeypatch, cell):
    monkeypatch.setattr(products, "CELL", cell)
    draw = np.random.default_rng(1)
    entries = [
        (c, t, f"t{'é' * (k % 2)}{k}", float(draw.integers(-2, 4)) / 4)
        for c, turns in ((0, 300), (1, 3), (2, 1)) for t in range(turns)
        for k in draw.choice(60, 4, replace=False).tolist()
    ]
    table = spark.createDataFrame(entries, "conv_id bigint, turn bigint, term string, x double")
    found = products.sparse_products(table.repartition(3), 2).collect()
    got = {(r["conv_id"], r["row_turn"], r["col_turn"]): (round(r["value"], 9), r["top"]) for r in found}
    assert got == brute_products(entries, 2)
    assert products.sparse_products(table).count() == len(got)


@pytest.fixture(scope="module")
def talk(spark):
    rows = [
        (0, 0, "A", "The river runs. The bank is high."), (0, 1, "B", "A river bank? The bank has money."),
        (0, 2, "A", "Money runs the bank."), (0, 3, "B", "..."), (1, 0, "A", "Alone with the river."),
    ]
    return Conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string"), stopwords=["the"])


def test_overlap_and_concepts_of_all_terms(talk):
    model = ConceptModel(talk, "all")
    overlap = {(r["row_turn"], r["col_turn"]): r["n_terms"] for r in model.term_overlap().collect()}
    assert overlap == {(0, 1): 2, (0, 2): 2, (1, 2): 2}
    shared = {(r["row_turn"], r["col_turn"]): r["concepts"] for r in model.common_concepts(3).collect()}
    assert set(shared) == {(0, 1), (0, 2), (1, 2)} and all(1 <= len(c) <= 3 for c in shared.values())
    full = model.conversation_similarity(diagonal=True)
    assert full.where("similarity > 1.000001").isEmpty()
    above = model.conversation_similarity(threshold=0.5)
    assert above.exceptAll(full.where("row_turn < col_turn AND similarity >= 0.5")).isEmpty()


def test_word_vectors_of_all_terms(spark, talk, monkeypatch):
    monkeypatch.setattr(vectors, "TERM_BLOCK", 2)
    draw = np.random.default_rng(2)
    known = {w: draw.normal(size=5) for w in ["river", "runs", "bank", "is", "high", "has", "money", "alone"]}
    table = spark.createDataFrame([(w, v.tolist()) for w, v in known.items()], "term string, vector array<double>")
    model = VectorModel(talk, table, "all")
    unit = {w: v / np.linalg.norm(v) for w, v in known.items()}
    words = [{"river", "runs", "bank", "is", "high"}, {"river", "bank", "has", "money"}, {"money", "runs", "bank"}]
    vocabulary = sorted(set().union(*words))
    features = np.array([[sum(unit[k] @ unit[w] for w in turn) for k in vocabulary] for turn in words])

    cells_ = {(r["key"], r["term"]): r["similarity"] for r in model.term_similarity().where("conv_id = 0").collect()}
    assert set(cells_) == {(k, t) for k in vocabulary for t in vocabulary}
    assert all(abs(s - unit[k] @ unit[t]) < 1e-12 for (k, t), s in cells_.items())

    found = {(r["turn"], r["term"]): r["value"] for r in model.feature_vectors().where("conv_id = 0").collect()}
    for turn, row in enumerate(features):
        for term, value in zip(vocabulary, row):
            assert abs(found[turn, term] - value) < 1e-12

    scaled = features / np.linalg.norm(features, axis=1, keepdims=True)
    for options in ({}, {"threshold": -2.0}):
        rows = model.conversation_similarity(**options).where("conv_id = 0").collect()
        assert len(rows) == 3
        assert all(abs(r["similarity"] - scaled[r["row_turn"]] @ scaled[r["col_turn"]]) < 1e-9 for r in rows)
    assert model.all_topic_recurrences().count() > 0
    assert model.pairs_formed(0.1).where("conv_id = 0").first()["pairs"] == 3


@pytest.mark.parametrize("threshold", [None, 0.0, 0.5])
def test_plot_of_a_model_equals_the_plot_of_its_table(talk, threshold):
    model = ConceptModel(talk, 3)
    one = PlotTables(talk, model.conversation_similarity(diagonal=True), model=model, threshold=threshold)
    other = ModelPlot(talk, model, labelled=True, threshold=threshold)

    def rows(df):
        return sorted(repr(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.asDict().items())) for r in df.collect())

    assert rows(one.triangles()) == rows(other.triangles())
    assert rows(one.diagonal()) == rows(other.diagonal().drop("concepts"))
    assert rows(one.tiles) == rows(other.tiles)
    assert rows(one.groups()) == rows(other.groups())
    shown = one.cells if threshold is None else one.cells.where(f"similarity >= {threshold}")
    assert rows(shown) == rows(other.cells.drop("concepts"))


def test_no_join_on_the_table_of_pairs(talk):
    plan = ModelPlot(talk, ConceptModel(talk, 3), labelled=True).triangles()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_meet_copies_to_all_pairs_of_blocks(spark):
    rows = spark.createDataFrame([(0, b, 3) for b in range(3)] + [(1, 0, 1)], "conv_id bigint, block bigint, blocks bigint")
    met = sorted(tuple(r) for r in cells.meet(rows).collect())
    assert met == [(0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 1, 1), (0, 0, 2, 0), (0, 0, 2, 1), (0, 1, 1, 0), (0, 1, 2, 0),
                   (0, 1, 2, 1), (0, 2, 2, 0), (1, 0, 0, 0)]
