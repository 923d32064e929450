"""Pairs counted in one place equal those counted by stretches and blocks."""

import random

import pytest

from turnwise.operators import concepts, near
from turnwise.plans.conversation import ConceptModel, Conversations

WORDS = [f"w{c}{d}" for c in "abcdefg" for d in "klmno"] + ["été", "漢字"]


@pytest.fixture(scope="module")
def talk(spark):
    draw = random.Random(3)
    rows = []
    for conv, n in ((0, 5), (1, 1), (2, 12), (None, 2), (7, 70)):
        for turn in [*range(n), *([None] if conv == 0 else [])]:
            text = ". ".join(" ".join(draw.choice(WORDS) for _ in range(draw.randrange(0, 5))) for _ in range(draw.randrange(0, 6)))
            rows.append((conv, turn, "A", text))
            if (conv, turn) in ((2, 1), (2, 3)):
                rows.append((conv, turn, "A", text if turn == 1 else "wak wbl. wcm"))
    rows += [(0, 9, "A", None), (3, 0, "A", None), (2, 2, None, None)]  # a text that is null is one window
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string")


def rows_of(df):
    def plain(v):
        return round(v, 8) + 0.0 if isinstance(v, float) else tuple(v) if isinstance(v, list) else v

    return sorted((tuple(plain(v) for v in row) for row in df.collect()), key=repr)


@pytest.mark.parametrize("numbers", [near.NUMBERS, 16])
def test_pairs_of_terms(spark, talk, monkeypatch, numbers):
    monkeypatch.setattr(near, "NUMBERS", numbers)
    rows = concepts.sentence_terms(talk, stopwords=[], brief=True)
    base = concepts.window_terms(rows, 3)
    want = rows_of(concepts._mirrored(concepts._cooccurrence_in_stretches(base), ["n"]))
    assert want and rows_of(concepts.term_cooccurrence(base)) == want
    names = ["conv_id", "term_i", "term_j", "n", "o_i", "o_j", "n_windows"]
    want = rows_of(concepts._pair_counts_in_stretches(base).select(names))
    assert rows_of(concepts._pair_counts(base).select(names)) == want
    monkeypatch.setattr(near, "PAIR_WORDS", 60)  # some near, some far
    assert rows_of(concepts._pair_counts(base).select(names)) == want


def test_pairs_of_near_conversations_are_not_shuffled(talk):
    base = concepts.window_terms(concepts.sentence_terms(talk, stopwords=[]), 3)
    plan = concepts.term_cooccurrence(base)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan.split("MapInArrow")[0]


def test_pairs_of_turns_by_all_terms(spark, talk, monkeypatch):
    def asked():
        model = ConceptModel(Conversations(talk, dense=True, stopwords=[]), "all", 3)
        return rows_of(model.conversation_similarity()), rows_of(model.common_concepts())

    found = asked()
    monkeypatch.setattr(near, "SQUARE_WORDS", 60)
    assert asked() == found
    monkeypatch.setattr(near, "SQUARE_WORDS", -1)
    assert asked() == found
    assert len(found[0]) > 1000 and len(found[1]) > 1000
