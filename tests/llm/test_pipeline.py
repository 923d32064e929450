import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.llm.conftest import random_text
from tests.llm.test_codes import check_packing
from tests.llm.test_ngram_jaccard import brute
from tools.compare import difference, open_oracle
from turnwise.llm.queries import QUERIES
from turnwise.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, documents, tmp_path):
    passage = random_text(500, 70, 50_000)
    texts = []
    for i in range(160):
        text = random_text(i, 60 + i % 50, 50_000)
        if i % 10 == 0:
            text += " scum idiot trash"
        texts.append((i, text))
    texts += [(200 + i, texts[i][1]) for i in range(1, 6)]  # copies
    texts += [(300 + i, " ".join(texts[i][1].split()[:-1])) for i in range(11, 16)]  # near copies
    texts += [(400 + i, random_text(900 + i, 80, 50_000) + " " + passage) for i in range(4)]
    texts += [(500, None), (501, ""), (None, "no id at all"), (3, texts[3][1])]
    docs = documents(texts)
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(160)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")

    scores = {r["doc_id"]: r["predicted"] for r in toxicity(docs, labels).collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, path)
    assert clean.columns == docs.columns
    kept = sorted((r["doc_id"] for r in clean.collect()), key=repr)
    assert kept == sorted((i for i, _ in texts if not scores[i]), key=repr)
    assert sum(scores[i] for i in range(160)) >= 12 and not any(scores[i] for i in range(160) if i % 10)

    one = corpus_pipeline.drop_near_duplicates(spark, docs, path)
    assert one.columns == docs.columns
    component = {i: c for i, _, c, _ in brute(texts)}
    want = sorted((i for i in component if i is None or component[i] == i), key=repr)
    assert sorted((r["doc_id"] for r in one.collect()), key=repr) == want

    cut = corpus_pipeline.drop_repeated_passages(spark, docs, path)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    lengths = {r["doc_id"]: r["n_chars"] for r in cut.collect()}
    assert all(lengths[400 + i] < 0.8 * len(texts[-8 + i][1]) for i in range(1, 4))
    assert lengths[400] == len(texts[-8][1]) and lengths[40] == len(texts[40][1])

    # The whole run is what the stages give one after the other.
    final = corpus_pipeline.run(spark, path).collect()
    after = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, after, path).write.parquet(f"{path}/{name}")
        after = spark.read.parquet(f"{path}/{name}")
    check_packing([(r["doc_id"], r["text"]) for r in after.collect()], final, 2048)


def test_an_id_with_several_texts_loses_only_the_copies(spark, documents):
    a, b, c = (random_text(70 + i, 60, 50_000) for i in range(3))
    near = " ".join(b.split()[:-1])
    given = [(3, a), (7, a), (7, b), (7, b), (9, near), (9, c), (7, near), (8, None), (8, ""), (8, ""), (8, a), (5, c), (None, a)]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(given), "")
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    want = [(3, a), (7, min(b, near)), (8, None), (8, ""), (5, c), (None, a)]
    assert rows == sorted(want, key=repr)
    # Two classes whose least id is the same keep a row each.
    both = corpus_pipeline.drop_near_duplicates(spark, documents([(7, a), (7, b), (8, a), (9, b)]), "")
    assert sorted(r["text"] for r in both.collect()) == sorted([a, b])


def test_own_columns_of_the_documents_stay(spark, documents, tmp_path):
    texts = [(i, random_text(i, 60, 50_000)) for i in range(40)] + [(3, random_text(3, 60, 50_000)), (50, None)]
    own = {"score": 7.5, "nth": 2, "Score_": 1}
    docs = documents(texts).withColumns({name: F.lit(value) for name, value in own.items()})
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(40)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    one = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert clean.columns == one.columns == docs.columns
    assert one.count() == 41 and clean.count() <= 42
    assert {(r["score"], r["nth"], r["Score_"]) for r in one.collect() + clean.collect()} == {(7.5, 2, 1)}


def test_an_empty_corpus(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in oracle_sql()])
def test_query_equals_sql(spark, name):
    assert difference(queries()[name](spark, SF), open_oracle(SF), oracle_sql()[name]) is None


def test_every_operator_has_a_query():
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES}
    assert numbers == set(range(1, 14)) and "pipeline" in queries()


def test_stages_hand_python_few_rows(spark, documents, tmp_path, monkeypatch):
    setting, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, corpus_pipeline.written

    def noted(df, name):
        seen[name] = int(spark.conf.get(setting))
        return write(df, name)

    monkeypatch.setattr(corpus_pipeline, "written", noted)
    before = spark.conf.get(setting)
    documents([(i, random_text(i % 7, 40)) for i in range(30)]).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    try:
        corpus_pipeline.run(spark, str(tmp_path))
    finally:
        spark.conf.set(setting, before)
    stages = [n for n in seen if n.startswith("stage_")]
    assert len(stages) == 4 and all(seen[n] <= 256 for n in stages)
