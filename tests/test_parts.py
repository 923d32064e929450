"""Words beside their vectors in parts equal the plain joins."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnwise.operators import parts, vectors
from turnwise.plans.conversation import Conversations, VectorModel

WORDS = [f"w{c}{d}" for c in "abcdefgh" for d in "klmnop"]


@pytest.fixture(scope="module")
def talk(spark):
    draw = random.Random(5)
    rows = []
    for conv, n in ((0, 5), (1, 1), (2, 12), (None, 3), (7, 90)):
        for turn in range(n):
            text = ". ".join(" ".join(draw.choice(WORDS) for _ in range(draw.randrange(0, 7))) for _ in range(3))
            rows += [(conv, turn, "A", text)] * (2 if (conv, turn) == (0, 1) else 1)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string")


@pytest.fixture(scope="module")
def given(spark):
    draw = random.Random(6)
    rows = [(w, [draw.uniform(-1, 1) for _ in range(40)]) for w in WORDS[:-6]]
    rows.append((WORDS[0], [0.0] * 40))  # no direction
    rows.append((WORDS[-6], None))
    return spark.createDataFrame(rows, "term string, vector array<float>")


def rounded(df):
    def plain(v):
        return round(v, 7) + 0.0 if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v

    return sorted((tuple(plain(v) for v in row) for row in df.collect()), key=repr)


ASKED = {
    "features": lambda d, v: VectorModel(d, v, 4).feature_vectors(),
    "similarity": lambda d, v: VectorModel(d, v, 4).conversation_similarity(),
    "terms": lambda d, v: VectorModel(d, v, 4).term_similarity(),
    "mean": lambda d, v: vectors.mean_vectors(d.turns, v),
}


@pytest.mark.parametrize("name", ASKED)
@pytest.mark.parametrize("brief", [True, False])
def test_many_vectors_give_what_few_give(spark, talk, given, monkeypatch, name, brief):
    data = talk if not brief else talk.where("turn < 64")
    known = given.where("vector IS NOT NULL")
    want = rounded(ASKED[name](Conversations(data, dense=True, stopwords=[]), known))
    assert want
    monkeypatch.setattr(vectors, "BROADCAST_NUMBERS", 0)
    found = ASKED[name](Conversations(data, dense=True, stopwords=[]), known)
    assert rounded(found.select(*found.columns)) == want


@pytest.mark.parametrize("limit", [1 << 20, 100, 0])
def test_all_terms_of_small_and_large_conversations(spark, talk, given, monkeypatch, limit):
    data = Conversations(talk, dense=True, stopwords=[])
    model = VectorModel(data, given, "all")
    want = rounded(vectors.features_in_blocks(model.words, model.dims))
    monkeypatch.setattr(vectors, "WIDE_WORDS", limit)
    assert rounded(VectorModel(data, given, "all").feature_vectors()) == want
    products = {}
    for conv, turn, term, value in want:
        products.setdefault(conv, {}).setdefault(turn, {})[term] = value
    got = VectorModel(data, given, "all").conversation_similarity().where("conv_id = 2").collect()
    assert len(got) == len(products[2]) * (len(products[2]) - 1) // 2
    for row in got:
        a, b = products[2][row.row_turn], products[2][row.col_turn]
        norm = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
        assert row.similarity == pytest.approx(sum(a[t] * b.get(t, 0.0) for t in a) / norm, abs=1e-6)


def test_a_vector_is_sent_to_a_part_once(talk, given):
    """However often its word is there: not once per row."""
    rows = talk.select("conv_id", "turn", F.explode(F.split(F.regexp_replace("text", "[.]", ""), " ")).alias("term"))

    def work(part):
        yield part.words.select(["conv_id"]).slice(0, 1).append_column("n", pa.array([len(part.vectors.values)]))

    found = parts.in_parts(rows, given, 40, rows.count(), ["conv_id"], work, "conv_id bigint, n bigint").collect()
    assert found and all(row.n <= len(WORDS) for row in found)
