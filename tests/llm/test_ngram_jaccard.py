import itertools
import random

import numpy as np
import pytest

from tests.llm.conftest import clashing, random_text, rows
from turnwise.llm import ngram_jaccard as nj
from turnwise.llm.components import components
from turnwise.llm.words import U64, batch_words, text_words


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    root = {n: n for n in range(len(sets))}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    links = [0] * len(sets)
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return sorted(((i, len(s), least.get(find(n)), links[n]) for n, (i, s) in enumerate(sets)), key=repr)


def changed(text, seed, edits):
    draw = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


def test_groups_equal_brute_force(documents, monkeypatch):
    monkeypatch.setattr(nj, "FREQUENT", 3)
    monkeypatch.setattr(nj, "BLOCK_NODES", 8)
    base = [random_text(s, n) for s, n in ((1, 200), (2, 80), (3, 600), (4, 40))]
    passage = random_text(9, 60)
    texts = []
    for b, text in enumerate(base):
        texts += [text, text.upper()]
        texts += [changed(text, 100 * b + k, 1 + k % 7) for k in range(20)]
    texts += [random_text(50 + k, 30) + " " + passage for k in range(15)]
    texts += [random_text(80 + k, 100) for k in range(20)]
    texts += ["", None, "one", "One", "a b c d", "a b c d e", "a b c d e f g h", "b c d e f g h"]
    texts = list(enumerate(texts))
    random.Random(0).shuffle(texts)
    found = nj.ngram_jaccard_join(clashing(documents(texts)))
    assert rows(found, "doc_id", "n_shingles", "component_id", "n_links") == brute(texts)


def test_null_ids_repeated_rows_and_an_empty_table(documents):
    text = random_text(5, 30)
    given = [(3, text), (3, text), (None, text), (None, random_text(6, 30)), (7, None), (8, "")]
    found = nj.ngram_jaccard_join(documents(given))
    assert rows(found, "doc_id", "n_shingles", "component_id", "n_links") == brute(given)
    assert nj.ngram_jaccard_join(documents([])).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent, monkeypatch):
    monkeypatch.setattr(nj, "FREQUENT", 2)
    draw = np.random.default_rng(1)
    universe = draw.integers(1, 2**63, 400, dtype=np.uint64)
    counts = {int(t): int(c) for t, c in zip(universe, draw.integers(2, 9, 400))}
    hits = 0
    for _ in range(300):
        size = int(draw.integers(5, 200))
        x = draw.choice(universe, size, replace=False)
        y = np.unique(np.concatenate((x[int(draw.integers(0, size // 4 + 1)) :], draw.choice(universe, size // 12))))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        signed = []
        for s in (x, y):
            order = sorted(s.tolist(), key=lambda t: (counts[t], t))
            arrays = np.array([counts[t] for t in order]), np.array(order, dtype=U64)
            signed.append(nj.set_signatures(len(s), *arrays, percent))
        assert len(np.intersect1d(*signed))
        hits += 1
    assert hits > 20


def test_must_share_is_the_same_in_both_forms(spark):
    from pyspark.sql import functions as F

    n = spark.range(1, 3000).withColumn("m", nj._must_share_column(F.col("id"), 80))
    got = {r["id"]: r["m"] for r in n.collect()}
    sizes = np.arange(1, 3000)
    assert got == dict(zip(sizes.tolist(), nj.must_share(sizes, 80).tolist()))


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    random.Random(3).shuffle(edges)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    from turnwise.llm import words

    texts = ["The  cat\tsat", None, "", "cat", "a" * 300 + " THE " + "é" * 10, "\x1fx the"]
    plain, edges = batch_words(texts)
    for i, text in enumerate(texts):
        assert text_words(text).tolist() == plain[edges[i] : edges[i + 1]].tolist()
    assert plain[0] == plain[edges[4] + 1] == plain[edges[5] + 1] and plain[1] == plain[edges[3]]
    monkeypatch.setattr(words, "SLAB", 64)
    cut, cut_edges = batch_words(texts)
    assert cut_edges.tolist() == edges.tolist() and cut[0] == plain[0]


def test_frequent_shingles_link_sets_of_unlike_sizes():
    import numpy as np

    from turnwise.llm.ngram_jaccard import set_signatures
    from turnwise.llm.words import seeds

    large = np.sort(seeds(200, 9))
    for seed in range(20):  # half of the set is similar at 50 percent
        small = np.sort(np.random.default_rng(seed).permutation(large)[:100])
        found = [set_signatures(len(x), np.full(len(x), 1000), x, 50) for x in (small, large)]
        assert len(np.intersect1d(*found))


def test_a_pair_of_blocks_with_an_empty_side_links_nothing():
    import pyarrow as pa

    from turnwise.llm.ngram_jaccard import _compare

    rows = {"key": [1, 2], "copies": [1, 1], "tokens": [[1, 2, 3]] * 2}
    for side in (0, 1):
        assert _compare(pa.table({**rows, "side": [side] * 2, "i": [0, 0], "j": [1, 1]}), 80).num_rows == 0
    inside = _compare(pa.table({**rows, "side": [0, 0], "i": [0, 0], "j": [0, 0]}), 80).to_pylist()
    across = _compare(pa.table({**rows, "side": [0, 1], "i": [0, 0], "j": [1, 1]}), 80).to_pylist()
    assert inside == across and sum(r["links"] for r in inside) == 2


def test_python_is_handed_few_rows_in_every_step(documents, spark, monkeypatch):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, write = spark.conf.get(setting), {}, nj.written

    def noted(df, name):
        seen[name] = int(spark.conf.get(setting))
        return write(df, name)

    monkeypatch.setattr(nj, "written", noted)
    given = [(i, random_text(i % 3, 40)) for i in range(9)]
    found = nj.ngram_jaccard_join(documents(given))
    assert {"shingles", "sets", "signatures", "links"} <= set(seen)
    assert all(seen[name] <= 256 for name in ("shingles", "sets", "signatures", "links"))
    assert spark.conf.get(setting) == before
    assert rows(found, "doc_id", "n_shingles", "component_id", "n_links") == brute(given)


def test_signatures_of_several_batches(documents, spark):
    texts = [random_text(k % 12, 60) for k in range(40)]
    texts += [changed(texts[k], k, 1) for k in range(12)]
    given = list(enumerate(texts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = nj.ngram_jaccard_join(documents(given))
        assert rows(found, "doc_id", "n_shingles", "component_id", "n_links") == brute(given)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_words_are_hashed_in_groups_that_fit_a_cache(monkeypatch):
    from turnwise.llm import words

    sizes, hashed = [], words._slab_hashes
    monkeypatch.setattr(words, "_slab_hashes", lambda data, between: sizes.append(len(data)) or hashed(data, between))
    texts = ["", " ", "a", " a", "a ", "\tb  a\n", None, "\u00e9 \u00c9 A"] * 3 + ["some words of one text " * 90] * 200
    found, edges = batch_words(texts)
    assert len(sizes) > 4 and max(sizes) < 1 << 17
    assert np.diff(edges).tolist() == [len((t or "").split()) for t in texts]
    assert found.tolist() == np.concatenate([text_words(t) for t in texts]).tolist()
