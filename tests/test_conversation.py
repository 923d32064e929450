from collections import Counter
from itertools import product
from random import Random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnwise import ConceptModel, Conversations, EmbeddingModel, VectorModel
from turnwise.operators import concepts, near, pairs, recurrence, terms
from turnwise.operators.concepts import sentence_windows
from turnwise.plans.plot import ModelPlot

from .conftest import MATRIX, similarity_rows

KINDS = list(product(recurrence.TIME_SCALES, recurrence.DIRECTIONS, recurrence.SPEAKERS))


@pytest.fixture(scope="module")
def four(spark):
    rows = [(0, 0, "Hello.", "A"), (0, 1, "How are you?", "B"), (0, 2, "Good thanks.", "A"), (0, 3, "Great!", "B")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string, speaker string")


def test_descriptors(spark, four):
    data = Conversations(four)
    assert [r["text_id"] for r in data.turns.orderBy("turn").collect()] == [0, 1, 2, 3]
    assert data.n_speakers().first()["n_speakers"] == 2
    assert data.n_utterances().first()["n_utterances"] == 4
    names = data.speaker_names().orderBy("position").collect()
    assert [(r["speaker"], r["first_turn"]) for r in names] == [("A", 0), ("B", 1)]


def test_unknown_speakers_are_not_counted(spark, four):
    unknown = four.withColumn("speaker", F.when(F.col("turn") != 1, F.col("speaker")))
    data = Conversations(unknown)
    assert data.n_speakers().first()["n_speakers"] == 2
    assert data.speaker_names().count() == 3


def test_one_table_as_one_conversation(spark, four):
    data = Conversations(four.drop("conv_id"), conversation_column=None)
    assert data.n_utterances().first()["n_utterances"] == 4


@pytest.mark.parametrize("n, width, sizes", [(5, 3, [3] * 3), (5, 2, [2] * 4), (2, 3, [2]), (0, 3, [0])])
def test_sentence_windows(spark, n, width, sizes):
    text = " ".join(f"Sentence {i}." for i in range(n))
    turns = spark.createDataFrame([(0, 0, text)], "conv_id bigint, turn bigint, text string")
    windows = sentence_windows(turns, width).orderBy("window_no").collect()
    assert [len(r["sentences"]) for r in windows] == sizes


def windows_of(spark, *items, block=True):
    rows = [(0, 0, i, [list(item)]) for i, item in enumerate(items)]
    df = spark.createDataFrame(rows, "conv_id bigint, block bigint, turn bigint, windows array<array<string>>")
    return df if block else df.drop("block")


@pytest.mark.parametrize("block", [True, False])
def test_contingency(spark, block):
    base = windows_of(spark, "AB", "AC", "AD", "BC", "CD", block=block)
    assert concepts.total_windows(base).first()["n_windows"] == 5
    occurrence = {r["term"]: r["occurrence"] for r in concepts.term_occurrence(base).collect()}
    assert occurrence == {"A": 3, "B": 2, "C": 3, "D": 2}
    contingency = concepts.term_contingency(base)
    cell = contingency.filter("term_i = 'A' AND term_j = 'B'").first()
    assert (cell["i_j"], cell["i_not_j"], cell["not_i_j"], cell["not_i_not_j"]) == (1, 2, 1, 1)
    for r in contingency.collect():
        assert r["i_j"] + r["i_not_j"] == occurrence[r["term_i"]]
        assert r["i_j"] + r["not_i_j"] == occurrence[r["term_j"]]
        assert r["i_j"] + r["i_not_j"] + r["not_i_j"] + r["not_i_not_j"] == 5
    similar = concepts.term_similarity(contingency).filter("term_i = 'A' AND term_j = 'B'").first()
    assert similar["similarity"] == pytest.approx(0.5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.sampled_from("ABCDEF")), min_size=1, max_size=12), st.integers(1, 4))
def test_key_terms_give_the_rows_of_the_full_table(spark, items, n):
    base = windows_of(spark, *items)
    full = concepts.term_similarity(concepts.term_contingency(base)).collect()
    lists = concepts.key_term_lists(base, n)
    names = {k["rank"]: k["term"] for r in lists.collect() for k in r["key_terms"]}
    want = {(r["term_i"], r["term_j"]): r["similarity"] for r in full if r["term_i"] in names.values()}
    got = {
        (names[i + 1], r["term"]): w
        for r in concepts.key_similarity(base, lists, n).collect()
        for i, w in enumerate(r["weights"])
        if w
    }
    assert got == pytest.approx(want)


def test_cooccurrence_within_sentences(spark, sherlock):
    turns = sherlock.selectExpr("0L AS conv_id", "text_id AS turn", "speaker", "text")
    model = ConceptModel(Conversations(turns, dense=True), sentence_window_size=3)
    n = {(r["term_i"], r["term_j"]): r["n"] for r in model.cooccurrence().collect()}
    assert n[("sherlock", "holmes")] == n[("holmes", "sherlock")] == 1
    assert ("sherlock", "abhorrent") not in n


def test_terms(spark, sherlock):
    turns = sherlock.selectExpr("0L AS conv_id", "text_id AS turn", "speaker", "text")
    data = Conversations(turns, dense=True, stopwords=["the", "and"])
    frequency = {r["term"]: r["frequency"] for r in data.term_frequencies().collect()}
    assert "the" not in frequency and frequency["his"] == 2 and frequency["she"] == 2
    by_turn = {r["term"]: r["frequency"] for r in data.term_frequencies("n_turns").collect()}
    assert by_turn["that"] == 2
    assert set(by_turn) == {r["term"] for r in data.all_terms().collect()}
    top = data.most_common_terms(3).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and top[0]["frequency"] >= top[2]["frequency"]
    data.add_stopword("his")
    assert data.term_frequencies().filter("term = 'his'").isEmpty()
    given_ = terms.key_terms(turns, ["holmes", "nobody"], stopwords=[])
    assert [r["term"] for r in given_.collect()] == ["holmes"]


def test_stop_words_may_hold_quotes(spark, sherlock):
    turns = sherlock.selectExpr("0L AS conv_id", "text_id AS turn", "speaker", "text")
    data = Conversations(turns, dense=True, stopwords=["don't", "back\\slash", "she"])
    assert data.term_frequencies().filter("term = 'she'").isEmpty()


@pytest.mark.parametrize(
    "call",
    [
        lambda d, s: d.term_frequencies("sometimes"),
        lambda d, s: d.topic_recurrence(s, "very short", "forward", "self"),
        lambda d, s: d.topic_recurrence(s, "short", "sideways", "self"),
        lambda d, s: d.topic_recurrence(s, "short", "forward", "nobody"),
        lambda d, s: d.all_topic_recurrences(s, t_medium=-1),
        lambda d, s: ConceptModel(d, key_terms=2.5),
        lambda d, s: ConceptModel(d, key_terms="some"),
    ],
)
def test_bad_arguments(four, seven_similarity, call):
    with pytest.raises(ValueError):
        call(Conversations(four, dense=True), seven_similarity)


# ---------------------------------------------------------------- recurrence on a given table


def score(data, similarity, scale, direction, speaker, **options):
    found = data.topic_recurrence(similarity, scale, direction, speaker, **options)
    return {"ABCDEFG"[r["turn"]]: r["score"] for r in found.collect()}


def cells(*names):
    return pytest.approx(sum(MATRIX["".join(sorted(n))] for n in names))


@pytest.fixture(scope="module")
def seven_turns(seven):
    return Conversations(seven, dense=True)


def test_backward(seven_turns, seven_similarity):
    def of(*kind, **options):
        return score(seven_turns, seven_similarity, *kind, **options)

    found = of("short", "backward", "self")
    assert found["C"] == cells("AC") and found["D"] == cells("BD") and found["A"] == 0
    found = of("short", "backward", "other")
    assert found["C"] == cells("BC") and found["D"] == cells("CD")
    found = of("medium", "backward", "self", t_medium=4)
    assert found["E"] == cells("AE", "CE") and found["F"] == cells("BF", "DF")
    found = of("medium", "backward", "other", t_medium=4)
    assert found["E"] == cells("BE", "DE") and found["F"] == cells("CF", "EF")
    found = of("long", "backward", "self")
    assert found["G"] == cells("AG", "CG", "EG") and found["F"] == cells("BF", "DF")
    found = of("long", "backward", "other")
    assert found["F"] == cells("AF", "CF", "EF") and found["G"] == cells("BG", "DG", "FG")


def test_forward(seven_turns, seven_similarity):
    def of(*kind, **options):
        return score(seven_turns, seven_similarity, *kind, **options)

    found = of("short", "forward", "self")
    assert found["C"] == pytest.approx(0.2) and found["B"] == pytest.approx(0.4)
    found = of("short", "forward", "other")
    assert found["C"] == pytest.approx(0.1) and found["B"] == pytest.approx(0.5)
    for normalize, own, other in ((False, 1.4, 0.8), (True, 0.7, 0.4)):
        assert of("medium", "forward", "self", t_medium=4, normalize=normalize)["A"] == pytest.approx(own)
        assert of("medium", "forward", "other", t_medium=4, normalize=normalize)["B"] == pytest.approx(other)
    for normalize, own, other in ((False, 1.8, 2.1), (True, 0.6, 0.7)):
        assert of("long", "forward", "self", normalize=normalize)["A"] == pytest.approx(own)
        assert of("long", "forward", "other", normalize=normalize)["A"] == pytest.approx(other)
    assert of("long", "forward", "other", normalize=True)["G"] is None


def test_all_kinds_at_once(seven_turns, seven_similarity):
    found = seven_turns.all_topic_recurrences(seven_similarity).collect()
    assert len(found) == 7 * 12
    for scale, direction, speaker in KINDS[::5]:
        one = score(seven_turns, seven_similarity, scale, direction, speaker)
        many = {
            "ABCDEFG"[r["turn"]]: r["score"]
            for r in found
            if (r["time_scale"], r["direction"], r["speaker"]) == (scale, direction, speaker)
        }
        assert many == pytest.approx(one)


@pytest.fixture(scope="module")
def six(spark):
    rows = [(0, i, "abcbac"[i], ["G1", "G1", "G2", "G1", "G1", "G2"][i], "") for i in range(6)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, grp string, text string")


@pytest.fixture(scope="module")
def six_similarity(spark):
    return spark.createDataFrame(
        similarity_rows("ABCDEF"), "conv_id bigint, row_turn bigint, col_turn bigint, similarity double"
    )


def grouped(table):
    return {(r["initiated_by"], r["repeated_by"]): r["score"] for r in table.collect()}


def test_whole_conversation(six, six_similarity):
    data = Conversations(six, dense=True)
    rate = data.conceptual_recurrence_rate(six_similarity).first()["recurrence_rate"]
    assert rate == pytest.approx(6.8 * 2 / 30)
    assert recurrence.recurrence_rate(six, six_similarity) == pytest.approx(rate)
    for column in ("speaker", "grp"):
        raw = grouped(data.grouped_recurrence(six_similarity, column, normalize=False))
        assert sum(raw.values()) * 2 / 30 == pytest.approx(rate)
    people = grouped(data.grouped_recurrence(six_similarity))
    assert len(people) == 9
    assert people[("a", "c")] == pytest.approx(0.5)
    assert people[("c", "a")] == pytest.approx(0.2)
    assert people[("a", "a")] == pytest.approx(0.6)
    groups = grouped(data.grouped_recurrence(six_similarity, "grp"))
    assert groups[("G1", "G2")] == pytest.approx(2.8 / 6)
    assert groups[("G2", "G1")] == pytest.approx(0.15)


def test_a_single_turn_has_no_rate(spark, six, six_similarity):
    one = six.filter("turn = 0")
    assert Conversations(one, dense=True).conceptual_recurrence_rate(six_similarity).isEmpty()
    with pytest.raises(ValueError, match="fewer than 2"):
        recurrence.recurrence_rate(one, six_similarity)


# ---------------------------------------------------------------- long conversations


def brute(turns, units, t_medium, normalize):
    """All twelve kinds by going through all pairs of turns."""
    speakers = {s for _, s in turns if s is not None}
    reach = {"short": len(speakers), "medium": t_medium, "long": len(turns)}
    found = {}
    for t, own in turns:
        for scale, direction, who in KINDS:
            chosen = [
                o
                for o, other in turns
                if 1 <= (o - t if direction == "forward" else t - o) <= reach[scale]
                and (own is not None and own == other) == (who == "self")
            ]
            total = sum(sum(x * y for x, y in zip(units.get(t, ()), units.get(o, ()))) for o in chosen)
            if normalize:
                total = total / len(chosen) if chosen else None
            found[(t, f"{scale}_{direction}_{who}")] = total
    return found


@pytest.fixture(scope="module")
def long_one(spark):
    """One conversation of 150 turns, some without a speaker, some without a vector."""
    speakers = [None if i % 11 == 3 else "abc"[(i * i + i // 4) % 3] for i in range(150)]
    turns = spark.createDataFrame(
        [(5, i, s, "") for i, s in enumerate(speakers)], "conv_id bigint, turn bigint, speaker string, text string"
    )
    raw = {i: [1.0 + i % 3, float(i % 5), float((i * 7) % 4)] for i in range(150) if i % 13}
    units = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in raw.items()}
    vectors = spark.createDataFrame([(5, i, v) for i, v in raw.items()], "conv_id bigint, turn bigint, embedding array<double>")
    return list(enumerate(speakers)), units, turns, vectors


@pytest.mark.parametrize("normalize", [False, True])
def test_running_totals_equal_all_pairs(long_one, normalize):
    plain, units, turns, vectors = long_one
    model = EmbeddingModel(Conversations(turns, dense=True), vectors, 3)
    assert not model.conversations.brief
    want = brute(plain, units, 7, normalize)
    for r in model.topic_recurrences(normalize=normalize, t_medium=7).collect():
        for kind in recurrence.KINDS:
            assert r[kind] == pytest.approx(want[(r["turn"], kind)], abs=1e-9), (r["turn"], kind)


def test_long_pairs_and_sums_agree(long_one):
    plain, units, turns, vectors = long_one
    data = Conversations(turns, dense=True)
    model = EmbeddingModel(data, vectors, 3)
    similarity = model.conversation_similarity()
    found = {(r["row_turn"], r["col_turn"]): r["similarity"] for r in similarity.collect()}
    for i, j in ((1, 2), (1, 149), (70, 140), (63, 64)):
        assert found[(i, j)] == pytest.approx(sum(x * y for x, y in zip(units[i], units[j])))
    assert len(found) == len(units) * (len(units) - 1) // 2
    rate = model.recurrence_rate().first()["recurrence_rate"]
    assert rate == pytest.approx(sum(found.values()) * 2 / (150 * 149))
    assert data.conceptual_recurrence_rate(similarity).first()["recurrence_rate"] == pytest.approx(rate)
    for normalize in (False, True):
        of_vectors = grouped(model.grouped_recurrence(normalize=normalize))
        of_pairs = grouped(data.grouped_recurrence(similarity, normalize=normalize))
        assert of_vectors == pytest.approx(of_pairs)
        assert len(of_vectors) == 9
        a_b = [
            found.get((i, j), 0.0) for i, s in plain for j, o in plain if i < j and (s, o) == ("a", "b")
        ]
        want = sum(a_b) / (len(a_b) if normalize else 1)
        assert of_vectors[("a", "b")] == pytest.approx(want)


def test_long_and_brief_layouts_agree(spark, monkeypatch):
    words = "red green blue cyan pink gold grey lime".split()
    rows = [
        (c, t, "ab"[t % 2], ". ".join(" ".join(words[(c + t * k + m) % 8] for m in range(3)) for k in range(1, 4)))
        for c in range(3)
        for t in range(9)
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string")

    def results(brief):
        data = Conversations(turns, dense=True, stopwords=[])
        data.__dict__["brief"] = brief
        model = ConceptModel(data, key_terms=4, sentence_window_size=2)
        tables = {
            "vectors": model.concept_vectors(),
            "pairs": model.conversation_similarity(),
            "overlap": model.term_overlap(),
            "common": model.common_concepts(2),
        }
        return {n: {tuple(map(str, r[:-1])): r[-1] for r in t.collect()} for n, t in tables.items()}

    monkeypatch.setattr(pairs, "PAIR_BLOCK", 64)
    brief, long = results(True), results(False)
    for name in brief:
        assert brief[name].keys() == long[name].keys()
        for key, value in brief[name].items():
            assert long[name][key] == (pytest.approx(value) if isinstance(value, float) else value)
    assert brief["pairs"]


def test_all_terms_as_key_terms(spark, sherlock):
    turns = sherlock.selectExpr("0L AS conv_id", "text_id div 2 AS turn", "speaker", "text").filter("turn < 2")
    turns = turns.groupBy("conv_id", "turn").agg(F.max("speaker").alias("speaker"), F.concat_ws(" ", F.collect_list("text")).alias("text"))
    data = Conversations(turns, dense=True, stopwords=[])
    every = ConceptModel(data, "all", 1)
    vocabulary = [r["term"] for r in data.all_terms().collect()]
    listed = ConceptModel(data, vocabulary, 1)
    a = every.conversation_similarity().first()
    b = listed.conversation_similarity().first()
    assert a["similarity"] == pytest.approx(b["similarity"])
    with pytest.raises(ValueError, match="fixed length"):
        every.topic_recurrences()


def test_empty_turn_has_no_similarity(spark):
    rows = [(0, 0, "a", "red green. red blue"), (0, 1, "b", ""), (0, 2, "a", "green red")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string")
    model = ConceptModel(Conversations(turns, dense=True, stopwords=[]), 3, 1)
    assert model.total_windows().first()["n_windows"] == 4
    pairs_ = {(r["row_turn"], r["col_turn"]) for r in model.conversation_similarity(diagonal=True).collect()}
    assert pairs_ == {(0, 0), (0, 2), (2, 2)}
    assert model.topic_recurrences().filter("turn = 1").first()["long_forward_other"] == 0


def test_word_vectors(spark, monkeypatch):
    rows = [(0, 0, "a", "red red green"), (0, 1, "b", "blue"), (0, 2, "a", "green unknown")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string")
    known = [("red", [1.0, 0.0]), ("green", [1.0, 1.0]), ("blue", [0.0, 2.0])]
    vectors = spark.createDataFrame(known, "term string, vector array<double>")

    def results():
        data = Conversations(turns, dense=True, stopwords=[])
        model = VectorModel(data, vectors, ["red", "blue"])
        similarity = {(r["key"], r["term"]): r["similarity"] for r in model.term_similarity().collect()}
        assert similarity[("red", "green")] == pytest.approx(0.5**0.5)
        assert similarity[("red", "red")] == pytest.approx(1)
        features = {(r["turn"], r["term"]): r["value"] for r in model.feature_vectors().collect()}
        assert features[(0, "red")] == pytest.approx(1 + 0.5**0.5)
        assert features[(1, "blue")] == pytest.approx(1)
        means = {(r["row_turn"], r["col_turn"]): r["similarity"] for r in data.mean_vector_similarity(vectors).collect()}
        assert means[(0, 1)] == pytest.approx(1 / 10**0.5)
        assert means[(1, 1)] == 1
        return similarity, features

    broadcast = results()
    monkeypatch.setattr("turnwise.operators.vectors.BROADCAST_NUMBERS", 0)
    assert results() == broadcast


def test_more_key_terms_than_bits_in_a_number(spark):
    names = [f"t{i:03d}" for i in range(70)]
    items = [names[i : i + 5] for i in range(0, 66)]
    rows = [(0, i, [item]) for i, item in enumerate(items)]
    base = spark.createDataFrame(rows, "conv_id bigint, turn bigint, windows array<array<string>>")
    full = concepts.term_similarity(concepts.term_contingency(base)).collect()
    lists = concepts.key_term_lists(base, names)
    got = {
        (names[i], r["term"]): w
        for r in concepts.key_similarity(base, lists, 70).collect()
        for i, w in enumerate(r["weights"])
        if w
    }
    assert got == pytest.approx({(r["term_i"], r["term_j"]): r["similarity"] for r in full})


def sparse_turns(spark):
    return spark.createDataFrame(
        [(0, 3, "A", "x", "p"), (0, 5, "B", "y", "q"), (0, 9, "A", "z", "r")],
        "conv_id bigint, turn bigint, speaker string, text string, name string",
    )


def test_embeddings_meet_their_turns(spark):
    vectors = [(0, 3, "p", [1.0, 0.0]), (0, 5, "q", [1.0, 0.0]), (0, 9, "r", [0.0, 1.0])]
    rows = spark.createDataFrame(vectors, "conv_id bigint, turn bigint, text_id string, embedding array<double>")
    data = Conversations(sparse_turns(spark), id_column="name")
    for table, by in ((rows.drop("text_id"), "turn"), (rows.drop("turn"), "text_id")):
        model = EmbeddingModel(data, table, 2, by=by)
        got = {(r["initiated_by"], r["repeated_by"]): r["score"] for r in model.grouped_recurrence().collect()}
        assert got == {("A", "A"): 0.0, ("A", "B"): 1.0, ("B", "A"): 0.0, ("B", "B"): 0.0}
    stray = rows.drop("text_id").withColumn("turn", F.col("turn") + 1)
    with pytest.raises(Exception, match="no turn for turn"):
        EmbeddingModel(data, stray, 2).conversation_similarity().collect()


def test_similarity_from_outside(spark):
    data = Conversations(sparse_turns(spark), id_column="name")
    by_turn = spark.createDataFrame([(0, 5, 3, 0.5)], "conv_id bigint, row_turn bigint, col_turn bigint, similarity double")
    by_name = spark.createDataFrame([(0, "p", "q", 0.5)], "conv_id bigint, row_turn string, col_turn string, similarity double")
    for table, by in ((by_turn, "turn"), (by_name, "text_id")):
        got = {(r["initiated_by"], r["repeated_by"]): r["score"] for r in data.grouped_recurrence(table, by=by).collect()}
        assert got["A", "B"] == 0.5 and got["B", "A"] == 0.0


def test_a_turn_column_beside_another_one(spark):
    data = sparse_turns(spark).withColumn("idx", F.col("turn") * 2)
    with pytest.warns(UserWarning, match="turn_original"):
        turns = Conversations(data, turn_column="idx").turns
    assert [r["turn"] for r in turns.orderBy("idx_original").collect()] == [0, 1, 2]


def test_new_stop_words_reach_models(spark):
    rows = [(0, i, "A", "river stone river. stone moss.") for i in range(3)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string")
    data = Conversations(turns, dense=True, stopwords=[])
    model = ConceptModel(data, 2)
    before = {k["term"] for r in model.lists.collect() for k in r["key_terms"]}
    other = data.with_stopwords("moss")
    data.add_stopword("river")
    after = {k["term"] for r in model.lists.collect() for k in r["key_terms"]}
    assert "river" not in after and before != after
    assert other.stopwords == ["moss"]


@pytest.mark.parametrize("wrong", [0, -1, []])
def test_key_terms_must_be_some(spark, wrong, sherlock):
    with pytest.raises(ValueError, match="key terms"):
        ConceptModel(Conversations(sherlock.withColumns({"conv_id": F.lit(0), "turn": F.col("text_id")}), dense=True), wrong)


def test_known_counts_and_similarity_give_the_same(spark):
    rows = [(0, i, "A", t) for i, t in enumerate(["river stone. moss fern", "stone moss river", "fern river. moss"])]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string")
    model = ConceptModel(Conversations(turns, dense=True, stopwords=[]), 3)
    plain = sorted(map(tuple, model.term_similarity().collect()))
    assert sorted(map(tuple, model.term_similarity(model.cooccurrence()).collect())) == plain
    own = {(r["turn"], r["term"]): round(r["value"], 9) for r in model.concept_vectors().collect()}
    given = {(r["turn"], r["term"]): round(r["value"], 9) for r in model.concept_vectors(model.term_similarity()).collect()}
    assert own == given


@pytest.mark.parametrize("dims", [5, 70])
def test_wide_vectors_of_a_long_conversation(spark, dims):
    import numpy as np

    draw = np.random.default_rng(dims)
    vectors = draw.standard_normal((150, dims))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    speakers = ["ABC"[int(x)] for x in draw.integers(0, 3, 150)]
    turns = spark.createDataFrame(
        [(0, i, s, "") for i, s in enumerate(speakers)], "conv_id bigint, turn bigint, speaker string, text string"
    )
    rows = [(0, i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, embedding array<double>")
    model = EmbeddingModel(Conversations(turns, dense=True), table, dims)
    cosine = vectors @ vectors.T
    rate = model.recurrence_rate().first()["recurrence_rate"]
    assert abs(rate - cosine[np.triu_indices(150, 1)].mean()) < 1e-9
    same = np.array([[a == b for b in speakers] for a in speakers])
    wide = {r["turn"]: r for r in model.topic_recurrences().collect()}
    for t in (0, 40, 149):
        for kind, back, reach in (("long_backward", True, 150), ("medium_forward", False, 10)):
            others = range(max(0, t - reach), t) if back else range(t + 1, min(150, t + 1 + reach))
            for who in ("self", "other"):
                want = sum(cosine[t, o] for o in others if same[t, o] == (who == "self"))
                assert abs(wide[t][f"{kind}_{who}"] - want) < 1e-9
    grouped = {(r["initiated_by"], r["repeated_by"]): r["score"] for r in model.grouped_recurrence().collect()}
    for a, b in product("ABC", "ABC"):
        cells = [cosine[i, j] for i in range(150) for j in range(i + 1, 150) if (speakers[i], speakers[j]) == (a, b)]
        assert abs(grouped[a, b] - sum(cells) / len(cells)) < 1e-9


@pytest.mark.parametrize("width", [1, 2, 3, 20, 70])
def test_masks_count_as_windows_do(spark, width):
    """Against windows that are written out: short turns, turns of several stretches, empty turns and sentences."""
    random = Random(width)
    long = [[random.choice("abcdefg") for _ in range(random.randint(0, 3))] for _ in range(200)]
    turns = [[], [[]], [["a"]], [["a", "b"], ["c"]], [["b"]] * 90, long]
    turns = [[list(dict.fromkeys(s)) for s in turn] for turn in turns]
    rows = [(0, i // 3, i, turn) for i, turn in enumerate(turns)]
    terms = spark.createDataFrame(rows, "conv_id bigint, block bigint, turn bigint, sentences array<array<string>>")
    windows, pairs, occurs = 0, Counter(), Counter()
    for turn in turns:
        for start in range(max(len(turn) - width, 0) + 1):
            held = sorted({t for s in turn[start : start + width] for t in s})
            windows += 1
            occurs.update(held)
            pairs.update((a, b) for a in held for b in held if a != b)
    base = concepts.window_terms(terms, width)
    assert concepts.total_windows(base).first()["n_windows"] == windows
    assert {r["term"]: r["occurrence"] for r in concepts.term_occurrence(base).collect()} == occurs
    assert {(r["term_i"], r["term_j"]): r["n"] for r in concepts.term_cooccurrence(base).collect()} == pairs
    cells = {(r["term_i"], r["term_j"]): r for r in concepts.term_contingency(base).collect()}
    assert {k: r["i_j"] for k, r in cells.items()} == pairs
    assert all(r["i_j"] + r["i_not_j"] == occurs[i] for (i, _), r in cells.items())
    lists = concepts.key_term_lists(base, ["c", "nowhere", "a"])
    weights = {r["term"]: r["weights"] for r in concepts.key_similarity(base, lists, 3).collect()}
    full = {(r["term_i"], r["term_j"]): r["similarity"] for r in concepts.window_term_similarity(base).collect()}
    for term in occurs:
        assert weights[term] == pytest.approx([full.get(("c", term), 0), 0, full.get(("a", term), 0)])
    masks = concepts.window_masks(base).groupBy("turn", "stretch", "term").count()
    assert masks.filter("count > 1").isEmpty()
    assert masks.filter("turn = 4").count() <= 90 // 16 + 1  # a term that is in all windows: one row a stretch


def odd_terms(spark):
    """Conversations with turns that come twice or have no number, empty turns and sentences, and no conversation."""
    random = Random(5)
    some = [[random.sample("abcdefgh", random.randint(0, 4)) for _ in range(random.randint(0, 6))] for _ in range(40)]
    rows = [(i // 8 if i // 8 < 4 else None, 0, None if i % 8 == 7 else i % 8 // 2 * 2, turn) for i, turn in enumerate(some)]
    rows += [(7, 0, 0, []), (7, 0, 1, None), (8, 0, 0, [["q"]]), (9, 0, 3, [["a", "b"], ["b", "c"]] * 40)]
    return spark.createDataFrame(rows, "conv_id bigint, block bigint, turn bigint, sentences array<array<string>>")


@pytest.mark.parametrize(
    "key_terms, numbers", [(3, 1 << 22), (20, 1), (["c", "nowhere", "a", "c"], 1), ([chr(i) for i in range(60, 120)], 1 << 22)]
)
def test_concepts_of_a_conversation_at_once(spark, monkeypatch, key_terms, numbers):
    monkeypatch.setattr(near, "NUMBERS", numbers)
    base = concepts.window_terms(odd_terms(spark).drop("block"), 2)
    dims = concepts.key_term_count(key_terms)
    lists = concepts.key_term_lists(base, key_terms)
    arrays = concepts.concept_arrays(base, concepts.key_similarity(base, lists, dims), dims)
    found = near.key_concepts(base, key_terms, dims).collect()
    named = {r["conv_id"]: (r["key_terms"], r["n_windows"]) for r in found if r["key_terms"] is not None}
    assert named == {r["conv_id"]: (r["key_terms"], r["n_windows"]) for r in lists.collect()}
    rows = [r for r in found if r["turn"] is not None]
    got = {(r["conv_id"], r["turn"]): r["vector"] for r in rows}
    want = {(r["conv_id"], r["turn"]): r["vector"] for r in arrays.collect()}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_all_terms_have_no_ranking(spark):
    with pytest.raises(ValueError):
        near.key_concepts(concepts.window_terms(odd_terms(spark), 2), "all", 0)


@pytest.mark.parametrize("brief, most", [(True, 30), (False, 30), (False, 1 << 16)])
def test_long_conversations_go_by_stretches(spark, monkeypatch, brief, most):
    """The same key terms and vectors; where every conversation is short, no window of a term becomes a row."""
    monkeypatch.setattr(near, "PAIR_WORDS", most)
    rows = odd_terms(spark)
    if most == 1 << 16:
        monkeypatch.setattr(concepts, "window_masks", None)
    data = Conversations(rows.selectExpr("conv_id", "turn", "'A' AS speaker", "'' AS text"), dense=True)
    data.__dict__.update(brief=brief, sentence_terms=rows.drop("block") if brief else rows)
    model = ConceptModel(data, 4, 2)
    got = {(r["conv_id"], r["turn"]): r["vector"] for r in model.arrays.collect()}
    named = {r["conv_id"]: (r["key_terms"], r["n_windows"]) for r in model.lists.collect()}
    monkeypatch.undo()
    base = model.base
    lists = concepts.key_term_lists(base, 4)
    assert named == {r["conv_id"]: (r["key_terms"], r["n_windows"]) for r in lists.collect()}
    arrays = concepts.concept_arrays(base, concepts.key_similarity(base, lists, 4), 4)
    want = {(r["conv_id"], r["turn"]): r["vector"] for r in arrays.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_similar_turns_are_found_without_rows_of_windows(spark, monkeypatch):
    monkeypatch.setattr(concepts, "window_masks", None)
    rows = [(0, i, "A", "river stone river. stone moss." if i < 2 else "cloud rain. rain wind.") for i in range(4)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string")
    model = ConceptModel(Conversations(turns, dense=True, stopwords=[]), 6)
    cells = ModelPlot(model.conversations, model, threshold=0.9).long.filter("x_index < y_index").collect()
    assert sorted((r["x_index"], r["y_index"]) for r in cells) == [(0, 1), (2, 3)]
