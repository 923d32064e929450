"""Many keywords, far pages and lines around hits against Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from turnwise.functions.keywords import Keywords
from turnwise.operators import concordance as kwic

TEXTS = [
    "The rest of the Forest. The the thethe!", "ſtraße STRASSE Straße", "İstanbul ıstanbul istanbul ISTANBUL", "K k K kelvin",
    "a-b a.b ab", "aaa aaaa aa", "", "ÉTÉ été été", "under_score score_ _score score", "x\ny\x00z", "σς ΣΣ",
]
WORDS = ["the", "rest", "forest", "thethe", "strasse", "straße", "istanbul", "k", "a.b", "aa", "été", "score", "_score", "y", "y\x00z",
         "Σ", "ss", "e", "t", "E"]


@pytest.mark.parametrize("ignore_case", [True, False])
@pytest.mark.parametrize("whole_word", [True, False])
def test_spans_are_those_of_re(ignore_case, whole_word):
    draw = random.Random(2)
    letters = "aAbB tTsſSσςΣkKİiıI.-é\n_"
    texts = TEXTS + ["".join(draw.choice(letters) for _ in range(60)) for _ in range(200)]
    words = WORDS + ["".join(draw.choice("aAbtTsSσkKiı.") for _ in range(draw.randrange(1, 4))) for _ in range(200)]
    words = list(dict.fromkeys(words))
    known = Keywords(words, ignore_case, whole_word)
    for text in texts:
        found = {}
        for number, start, end in known.spans(text):
            found.setdefault(words[number], []).append((start, end))
        for word in words:
            body = rf"\b{re.escape(word)}\b" if whole_word else re.escape(word)
            expected = [m.span() for m in re.finditer(body, text, re.IGNORECASE if ignore_case else 0)]
            assert found.get(word, []) == expected, (word, text)


def test_search_many_equals_single_searches(spark):
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None)]
    df = spark.createDataFrame(texts, "text_id bigint, text string").withColumn("keyword_", F.lit("x"))
    words = ["the", "Rest", "aa", "score"]
    many = kwic.search_many(df, [*words, "the"], whole_word=True, window_width=7)
    for word in words:
        one = kwic.search(df, word, whole_word=True, window_width=7)
        part = many.where(F.col("keyword") == word).select(one.columns)
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, one.collect()))


def test_plan_and_time_hardly_depend_on_the_number_of_keywords(spark):
    draw = random.Random(1)
    texts = [(i, " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(400))) for i in range(500)]
    df = spark.createDataFrame(texts, "text_id bigint, text string").repartition(4).cache()
    df.count()

    def run(n):
        words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
        found = kwic.search_many(df, words, whole_word=True)
        start = time.perf_counter()
        found.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start, found._jdf.queryExecution().optimizedPlan().toString().count("\n")

    run(50)
    (few, small), (many, large) = run(50), run(5000)
    assert small == large
    assert many < 3 * few + 2


@pytest.fixture(scope="module")
def hits(spark):
    """Results with few different contexts, so that many rows tie."""
    rows = spark.range(30000).select(
        (F.col("id") % 7001).alias("text_id"), F.col("id").alias("match_no"),
        F.concat(F.lit(" w"), (F.col("id") % 11).cast("string")).alias("left_context"), F.lit("m").alias("match"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("r"), (F.col("id") * 7919 % 30011).cast("string")))
        .alias("right_context"),
    )
    return rows.repartition(4)


@pytest.mark.parametrize("by", kwic.SORTS)
@pytest.mark.parametrize("page", [7, 600, 1500])
def test_far_pages(spark, hits, monkeypatch, by, page):
    monkeypatch.setattr(kwic, "NEAR_ROWS", 100)
    everything = [tuple(r) for r in kwic.sort_results(hits, by).collect()]
    found = [tuple(r) for r in kwic.result_page(hits, page, 20, by).collect()]
    assert found == everything[(page - 1) * 20 : page * 20]


def test_far_page_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(kwic, "NEAR_ROWS", 50)
    same = spark.range(2000).select(
        F.when(F.col("id") < 1500, 1).otherwise(F.col("id")).cast("bigint").alias("text_id"), F.lit(None).cast("bigint").alias("match_no"),
        F.lit("a").alias("left_context"), F.lit("b").alias("right_context"),
    )
    for page in (1, 50, 75, 76, 101):
        found = [r["text_id"] for r in kwic.result_page(same, page, 20).collect()]
        assert found == ([1] * 1500 + list(range(1500, 2000)))[(page - 1) * 20 : page * 20]


def test_positions(spark, hits):
    numbered = kwic.numbered_results(hits, "right_context").collect()
    expected = [r["match_no"] for r in kwic.sort_results(hits, "right_context").collect()]
    assert [r["match_no"] for r in sorted(numbered, key=lambda r: r["position"])] == expected
    assert sorted(r["position"] for r in numbered) == list(range(30000))
    assert kwic.numbered_results(hits.limit(0)).count() == 0


@pytest.mark.parametrize("context", [0, 1, 3, 40])
def test_lines_around_hits(spark, context):
    draw = random.Random(context)
    lines = [(s, n, "hit" if draw.random() < 0.05 else f"line {n}") for s in ("a", "b", None) for n in range(draw.randrange(100, 300))]
    df = spark.createDataFrame(lines, "source string, line_no int, text string").repartition(3)
    found = {
        (r["source"], r["line_no"]): (r["before"], r["after"])
        for r in kwic.line_context(df, "hit", context, keys=["source"], width=16).collect()
    }
    expected = {}
    for source, n, text in lines:
        if text == "hit":
            own = [t for s, _, t in lines if s == source]
            expected[source, n] = (own[max(n - context, 0) : n], own[n + 1 : n + 1 + context])
    assert found == expected


def test_a_word_that_is_nowhere_moves_no_line(spark):
    df = spark.range(20000).select(F.col("id").alias("line_no"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    near = kwic._near_hits(df.withColumnRenamed("text", "line"), df.where("false"), 2, [], "line_no")
    assert near.count() == 0
    one = kwic._near_hits(df.withColumnRenamed("text", "line"), df.where("line_no = 700"), 2, [], "line_no")
    assert {698, 699, 700, 701, 702} <= {r["line_no"] for r in one.collect()} and one.count() < 10
    assert kwic.line_context(df, "nowhere", 2).count() == 0


@pytest.mark.parametrize("ignore_case", [True, False])
def test_crowded_matches_are_cut_from_the_text(spark, ignore_case):
    draw = random.Random(5)
    texts = TEXTS + [None, *["".join(draw.choice("aAbTsſSKkİiı.é\n\U0001f600") for _ in range(80)) for _ in range(50)]]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    for word in ("a", "s", "k", "i", "aa", ".", "\U0001f600"):
        found = kwic.search(df, word, ignore_case=ignore_case, window_width=7, offsets=True)
        assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
        pattern = re.compile(re.escape(word), re.I if ignore_case else 0)
        expected = [
            (i, n, t[max(m.start() - 7, 0) : m.start()], m.group(), t[m.end() : m.end() + 7], m.start())
            for i, t in enumerate(texts)
            for n, m in enumerate(pattern.finditer(t or ""))
        ]
        assert sorted(map(tuple, found.collect())) == expected


def test_text_that_is_not_utf8(spark):
    df = spark.sql("SELECT 1 AS text_id, cast(X'61FF6261' AS string) AS text")
    assert [r["match_no"] for r in kwic.search(df, "a").collect()] == [0, 1]


def test_far_page_writes_columns_once_and_goes_on_in_the_range(spark, hits, monkeypatch):
    monkeypatch.setattr(kwic, "NEAR_ROWS", 100)
    kept, cut = [], kwic.cut_lineage

    def noted(df):
        kept.append((df.columns, (done := cut(df)).count()))
        return done

    monkeypatch.setattr(kwic, "cut_lineage", noted)
    kwic.result_page(hits, 600, 20, "right_context").collect()
    assert all(columns == ["__order"] for columns, _ in kept)
    sizes = [n for _, n in kept]
    assert len(sizes) > 1 and sizes[0] == 30000 and sizes == sorted(sizes, reverse=True) and sizes[1] < 30000 / 4
