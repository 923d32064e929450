import numpy as np
import pytest

from tests.llm.conftest import rows
from turnwise.llm import vector_blocks
from turnwise.llm.maxscore import maxscore_search
from turnwise.llm.prefix_forest import prefix_forest_search

SCHEMA = "vec_id bigint, embedding array<float>, extra string, id string, vector string, score string"


def vectors(spark, array, ids=None):
    ids = range(len(array)) if ids is None else ids
    data = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], "x", "id", "v", "s") for i, v in zip(ids, array)]
    return spark.createDataFrame(data, SCHEMA)


def exact(ids, scores, k):
    return sorted(zip(ids, scores), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_maxscore_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vector_blocks, "BLOCK_QUERIES", 4)
    draw = np.random.default_rng(0)
    array = (draw.standard_normal((300, 8)) * scale).astype(np.float32)
    array[100:110] = array[50]  # ties
    table = vectors(spark, array)
    found = maxscore_search(table, table.where("vec_id % 25 = 0"), k=5)
    whole = [[int(x) for x in np.floor(256 * v.astype(float))] for v in array]
    want = []
    for q in range(0, 300, 25):
        others = [i for i in range(300) if i != q]
        scores = [sum(a * b for a, b in zip(whole[q], whole[i])) for i in others]
        limit = 2**63 - 1
        best = exact(others, [max(-limit - 1, min(limit, s)) for s in scores], 5)
        if scale > 1:  # beyond a long the order is by the true score
            best = [(i, max(-limit - 1, min(limit, s))) for i, s in exact(others, scores, 5)]
        want += [(q, r + 1, i, s) for r, (i, s) in enumerate(best)]
    got = rows(found, "query_id", "rank", "vec_id", "score")
    if scale > 1:
        assert sorted(x[:1] + x[3:] for x in got) == sorted(x[:1] + x[3:] for x in want)
    else:
        assert got == sorted(want, key=repr)


@pytest.mark.parametrize("search", [maxscore_search, prefix_forest_search])
def test_odd_vectors(spark, search):
    array = [[1, 0], [1, 0], None, [float("nan"), 1], [float("inf"), 1], [None, 1], [], [0, 0], [0.5, 0.5], [-1, 0]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None]
    table = vectors(spark, array, ids)
    found = search(table, table, k=3)
    got = {}
    for query, rank, vec, _ in rows(found, "query_id", "rank", "vec_id", "score"):
        got.setdefault(query, {})[rank] = vec
    zero = search is maxscore_search
    known = [0, 1, 7, 8] if zero else [0, 1, 8]
    assert sorted(got) == known
    assert got[0][1] == 1 and got[1][1] == 0 and len(got[0]) == len(known) - 1
    empty = vectors(spark, [])
    assert search(empty, empty).count() == 0 and search(table, empty).count() == 0


def test_forest_finds_nine_tenths(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 1000)
    draw = np.random.default_rng(1)
    array = draw.standard_normal((3000, 64)).astype(np.float32)
    array *= draw.uniform(0.5, 1.5, 3000)[:, None]  # inner products are not angles
    table = vectors(spark, array)
    found = prefix_forest_search(table, table.where("vec_id % 50 = 0"))
    hit = 0
    exact_rows = array.astype(float)
    for query, rank, vec, score in rows(found, "query_id", "rank", "vec_id", "score"):
        scores = exact_rows @ exact_rows[query]
        scores[query] = -np.inf
        hit += vec in set(np.argsort(-scores)[:20].tolist())
        assert abs(score - scores[vec]) < 1e-9
    assert hit >= 0.9 * 60 * 20


def test_many_copies_of_a_vector_do_not_hide_others(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 4000)
    draw = np.random.default_rng(2)
    array = draw.standard_normal((2000, 32)).astype(np.float32)
    array[500:1500] = array[500]
    table = vectors(spark, array)
    found = prefix_forest_search(table, table.where("vec_id % 100 = 0"))
    got = {}
    for query, rank, vec, _ in rows(found, "query_id", "rank", "vec_id", "score"):
        got.setdefault(query, {})[rank] = vec
    whole = array.astype(float)
    hit = total = 0
    for query, ranked in got.items():
        scores = (whole * whole[query]).sum(axis=1)
        want = [i for _, i in sorted((-s, i) for i, s in enumerate(scores) if i != query)[:20]]
        hit += len(set(want) & set(ranked.values()))
        total += 20
    assert hit >= 0.9 * total
    assert [got[600][r] for r in range(1, 21)] == list(range(500, 520))


def test_a_query_among_few_near_rows_gets_all_its_neighbours(spark):
    """The query itself takes a place in every tree, but none in the result."""
    draw = np.random.default_rng(4)
    array = draw.standard_normal((420, 16)).astype(np.float32)
    array[:20] = array[0] + 1e-4 * draw.standard_normal((20, 16)).astype(np.float32)
    table = vectors(spark, array)
    found = prefix_forest_search(table, table.where("vec_id < 20"))
    assert {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()} == {i: 20 for i in range(20)}
