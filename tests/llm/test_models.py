import math
import random
import zlib
from collections import Counter

import numpy as np

from tests.llm.conftest import clashing, random_text, rows
from turnwise.llm import suffix_tree_lm as lm
from turnwise.llm import toxicity as tox


def test_base_scores_equal_brute_force(documents, monkeypatch):
    monkeypatch.setattr(lm, "WORD_SHARE", 0.005)  # so that some words go through the join
    given = [(i, random_text(i, 40, 300)) for i in range(60)] + [(60, None), (61, ""), (62, "The the NEW"), (None, "w1 w2")]
    found = lm.score_texts(clashing(documents(given)))
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [((t or "").encode().lower().split() + [None]) for _, t in given]
    counts = Counter(w for (i, _), ws in zip(given, tokens) if not out(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in found.collect()}
    for (i, _), words in zip(given, tokens):
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out(i), len(words), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert abs(r["base_score"] - base) < 1e-9 * max(1, abs(base))
        assert r["score"] < 0


def test_contexts_that_matter_are_learned(documents):
    draw = random.Random(0)
    texts = []
    for _ in range(300):
        words = []
        while len(words) < 60:
            words += ["alpha", "beta", "gamma"] if draw.random() < 0.3 else [f"w{draw.randrange(40)}"]
        texts.append(" ".join(words))
    docs = documents(texts)
    tree, _, tokens, _ = lm.fit(docs)
    # One word before a token matters here (alpha, beta and gamma follow each other), a second one does not.
    assert len(tree.depths[0][0].keys) > 30 and tokens > 10_000
    assert len(tree.depths[1][0].keys) < 0.2 * len(tree.depths[0][0].keys)
    found = [r for r in lm.score_texts(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in found) > 0.85 * sum(r["base_score"] for r in found)


def test_probabilities_of_a_context_sum_to_one(documents):
    docs = documents([random_text(i, 200, 20).replace("w1 ", "w1 w2 ") for i in range(40)])
    tree, words, _, distinct = lm.fit(docs)
    symbols = np.array([r["symbol"] for r in words.collect()]).view(np.uint64)
    unknown = np.array([12345], dtype=np.uint64)
    every = np.concatenate((symbols, unknown))
    for contexts, _, _, _ in tree.depths[:1]:
        for key in [*contexts.keys[:5], np.uint64(7)]:
            histories = [np.full(len(every), key if d == 0 else 0, dtype=np.uint64) for d in range(len(tree.depths))]
            weight, stored = tree.score(histories, every)
            root = np.where(np.isnan(tree.root(every)), tree.unknown, tree.root(every))
            total = (10 ** np.where(np.isnan(stored), weight + root, stored)).sum()
            assert abs(total - 1) < 1e-9


def test_language_model_of_nothing(documents):
    assert lm.score_texts(documents([])).count() == 0
    only = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    held = lm.score_texts(documents([(i, "a b") for i in only])).collect()
    assert [(r["held_out"], r["train_tokens"], r["n_known"], r["base_score"]) for r in held] == [(True, 0, 0, 0.0)] * 2


def labelled(spark, documents, n=800):
    draw = random.Random(1)
    texts, toxic = [], []
    for i in range(n):
        words = random_text(i, draw.randint(5, 200), 3000).split()
        bad = i % 8 == 0
        for _ in range(3 if bad else 0):
            words.insert(draw.randrange(len(words) + 1), draw.choice(["idiot", "Scum!", "(trash)", "moron,"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int")
    return documents(texts), labels, toxic


def test_toxic_words_are_learned(spark, documents):
    docs, labels, toxic = labelled(spark, documents)
    found = {r["doc_id"]: r for r in tox.toxicity(clashing(docs), labels).collect()}
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i in found if found[i]["held_out"]]
    assert sum(found[i]["predicted"] == toxic[i] for i in held) >= 0.97 * len(held)
    assert sum(found[i]["predicted"] for i in held if toxic[i]) >= 0.9 * sum(toxic[i] for i in held)


def test_labels_of_held_out_rows_and_other_columns_do_not_count(spark, documents):
    docs, labels, _ = labelled(spark, documents, 200)
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    assert rows(tox.toxicity(docs, labels), "doc_id", "score") == rows(tox.toxicity(other, turned), "doc_id", "score")


def test_an_id_in_many_rows_is_learned_from_once(spark, documents):
    rows = [(i, "fine words" if i % 2 else "vile scum") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id bigint, toxic int")
    plain = sorted(map(tuple, tox.fit_toxicity(documents(rows), labels).collect()))
    often = documents(rows + [(1, "fine words"), (2, "wholly other words"), (2, None)] * 40)
    assert sorted(map(tuple, tox.fit_toxicity(often, labels).collect())) == plain
    few = tox.fit_toxicity(documents(rows), labels, sample_rows=5)
    assert few.count() <= len(plain)


def test_toxicity_of_odd_rows(spark, documents):
    docs, labels, _ = labelled(spark, documents, 100)
    odd = documents([(1000, None), (1001, ""), (None, "idiot"), (1002, "x " * 50_000), (3, "again"), (3, "again")])
    nulls = spark.createDataFrame([(None, 1, 1), (5, 1, None), (6, 1, 1), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = tox.toxicity(docs.union(odd), labels.union(nulls))
    assert found.count() == 106
    same = {r["score"] for r in found.where("doc_id IN (1000, 1001)").collect()}
    assert len(same) == 1
    none = tox.toxicity(docs, labels.where("false"))
    assert {(r["score"], r["predicted"]) for r in none.collect()} == {(0.0, 0)}
    assert tox.toxicity(documents([]), labels).count() == 0


def test_tree_grows_with_the_corpus_and_its_rare_part_counts_by_join(documents, monkeypatch):
    draw = random.Random(5)
    filler = [" ".join(f"f{draw.randrange(3000)}" for _ in range(400)) for _ in range(300)]
    pair = "seldom together "  # 7 to 9 of 120,000 tokens, less than a share of 1e-4
    docs = documents([(i, (pair if i % 37 == 0 else "") + t) for i, t in enumerate(filler)] + [(1000, "seldom together"), (1001, "together seldom")])
    whole = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    tree, _, tokens, _ = lm.fit(docs)
    assert tokens > 100_000
    # Each score is that of the tree, token by token.
    for i in (0, 7, 1000, 1001):
        text = docs.where(f"doc_id = {i}").first()["text"]
        symbols, edges = lm.sequences([text])
        weight, stored = tree.score(lm.histories(symbols, edges, lm.DEPTH), symbols)
        root = np.where(np.isnan(tree.root(symbols)), tree.unknown, tree.root(symbols))
        assert abs(np.where(np.isnan(stored), weight + root, stored).sum() - whole[i]["score"]) < 1e-9 * abs(whole[i]["score"])
    gain = lambda i: whole[i]["score"] - whole[i]["base_score"]
    assert gain(1000) > 2.5 and gain(1000) > gain(1001) + 2
    # What is broadcast does not decide what is known.
    monkeypatch.setattr(lm, "USUAL", 3)
    monkeypatch.setattr(lm, "WORD_SHARE", 0.01)
    joined = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    assert {i: r["n_known"] for i, r in joined.items()} == {i: r["n_known"] for i, r in whole.items()}
    assert all(abs(r["score"] - whole[i]["score"]) < 1e-9 * abs(r["score"]) for i, r in joined.items())


def test_grams_are_looked_up_in_order(monkeypatch):
    draw = np.random.default_rng(5)
    held = np.unique(draw.integers(0, 1 << 40, 5000, dtype=np.uint64))
    keys = np.concatenate((draw.integers(0, 1 << 41, 5000, dtype=np.uint64), held[::7], held[::7]))
    search, asked = np.searchsorted, []
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **kw: asked.append(v) or search(a, v, *more, **kw))
    found = lm._places(held, keys)
    assert len(asked) == 1 and (np.diff(asked[0].astype(np.int64)) >= 0).all()
    assert found.tolist() == search(held, keys).tolist()
    assert lm._places(held, keys[:0]).tolist() == []
    assert lm._places(held[:0], keys[:2]).tolist() == [0, 0]


def test_rows_of_rare_grams_do_not_grow_with_slices_times_ranges(documents, monkeypatch):
    docs = documents([random_text(i, 100, 400) for i in range(200)] + [None, ""]).coalesce(2)
    whole = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    seen, looked_up = [], lm._looked_up

    def counted(rare, looked, bits):
        rows = rare.where("grams IS NOT NULL").select("range", "first").collect()
        seen.append((len(rows), len({r["range"] for r in rows}), len({r["first"] for r in rows})))
        return looked_up(rare, looked, bits)

    monkeypatch.setattr(lm, "_looked_up", counted)
    monkeypatch.setattr(lm, "USUAL", 3)
    monkeypatch.setattr(lm, "WORD_SHARE", 0.1)
    monkeypatch.setattr(lm, "SLICE", 1 << 10)  # some sixty slices of a few texts
    monkeypatch.setattr(lm, "RANGE", 1 << 9)
    monkeypatch.setattr(lm, "SHARE", 100.0, raising=False)  # one round
    found = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    ((rows, ranges, firsts),) = seen
    assert ranges > 30 and firsts <= 2 and rows <= 2 * ranges
    for i, r in whole.items():
        assert (found[i]["n_tokens"], found[i]["n_known"]) == (r["n_tokens"], r["n_known"])
        assert abs(found[i]["score"] - r["score"]) < 1e-9 * abs(r["score"])
        assert abs(found[i]["base_score"] - r["base_score"]) < 1e-9 * abs(r["base_score"])


def test_scores_do_not_depend_on_rounds_or_full_bitmaps(documents, monkeypatch):
    texts = [(i // 2, random_text(i, 60, 100)) for i in range(120)] + [(None, "w1 w2"), (None, "w1 w2"), (7, None), (7, "")]
    docs = documents(texts)
    numbers = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    taken = lambda: sorted((str(r["doc_id"]), r["held_out"], *(round(r[n], 6) for n in numbers)) for r in lm.score_texts(docs).collect())
    whole = taken()
    assert len(whole) == len(texts)
    rounds, looked_up = [], lm._looked_up
    monkeypatch.setattr(lm, "_looked_up", lambda *given: rounds.append(1) or looked_up(*given))
    monkeypatch.setattr(lm, "USUAL", 3)
    monkeypatch.setattr(lm, "WORD_SHARE", 0.1)
    monkeypatch.setattr(lm, "BITS", 10)
    monkeypatch.setattr(lm, "SHARE", 0.5)
    assert taken() == whole
    assert len(rounds) > 1
