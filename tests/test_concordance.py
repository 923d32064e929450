import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnwise import Concordance, TextLoader
from turnwise.functions.patterns import SearchPattern, pattern_error
from turnwise.operators import concordance as kwic
from turnwise.operators.prepare import chunk_rows


def ids(df):
    return [row["text_id"] for row in df.collect()]


def texts_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "text_id bigint, text string")


def expected(text_id, text, pattern, width):
    return [
        (text_id, n, text[max(m.start() - width, 0) : m.start()], m.group(), text[m.end() : m.end() + width], m.start())
        for n, m in enumerate(pattern.compiled.finditer(text))
    ]


def check(spark, texts, keyword, width=50, **options):
    pattern = SearchPattern(keyword, **options)
    want = [hit for i, text in enumerate(texts) for hit in expected(i, text, pattern, width)]
    found = kwic.search(texts_of(spark, *texts), keyword, window_width=width, offsets=True, **options)
    assert sorted(tuple(row) for row in found.collect()) == sorted(want)
    plain = kwic.search(texts_of(spark, *texts), keyword, window_width=width, **options)
    assert sorted(tuple(row) for row in plain.collect()) == sorted(hit[:-1] for hit in want)


def test_ignores_case_by_default(sherlock):
    assert sorted(ids(kwic.search(sherlock, "she"))) == [0, 0, 2]


def test_case_sensitive(sherlock):
    assert sorted(ids(kwic.search(sherlock, "she", ignore_case=False))) == [0, 2]


def test_regex(spark):
    dna = spark.createDataFrame(
        [(1, "AGGACTTA"), (2, "invalid AGGACTA"), (3, "XPOAGTC"), (4, "TACCA")], "text_id int, text string"
    )
    assert sorted(ids(kwic.search(dna, "^[ACGT]+$", regex=True))) == [1, 4]


@pytest.mark.parametrize(
    "by, order", [("text_id", [1, 2, 3]), ("left_context", [2, 1, 3]), ("right_context", [3, 2, 1])]
)
def test_sorting(spark, by, order):
    pens = spark.createDataFrame(
        [("The pen is red", 1), ("My pen is green", 2), ("Your pen is blue", 3)], "text string, text_id int"
    )
    assert ids(kwic.sort_results(kwic.search(pens, "pen"), by)) == order
    assert ids(Concordance(pens, "pen", sort=by).results()) == order
    assert ids(Concordance(pens, "pen", sort=by, results_per_page=2).page(2)) == order[2:]


def test_left_sort_looks_at_words_from_the_right(spark):
    texts = ["b a x", "a b x", "A  a x", "x"]
    found = kwic.sort_results(kwic.search(texts_of(spark, *texts), "x"), "left_context")
    assert ids(found) == [3, 2, 0, 1]


def test_invalid_sort(sherlock):
    with pytest.raises(ValueError, match="invalid sort"):
        kwic.sort_results(kwic.search(sherlock, "she"), "speaker")


TEXTS = ["", "aaaa", "ab\nab.ab", "x.y*z\\E[q]", "Élan élan ÉLAN", "the then\tthe", "日本語の日本", "aXbXXc" * 40]


@pytest.mark.parametrize("keyword", ["a", "ab", ".", "*", "\\E", "[q]", "é", "the", "日本", "X", "zzz"])
@pytest.mark.parametrize("width", [0, 2, 1000])
def test_literals_match_python(spark, keyword, width):
    check(spark, TEXTS, keyword, width)


@pytest.mark.parametrize("keyword", ["the", "élan", "日本"])
def test_whole_words_match_python(spark, keyword):
    check(spark, TEXTS, keyword, 5, whole_word=True)


@pytest.mark.parametrize(
    "keyword", ["a+", "a|b", "^a", "b$", r"\w+", "x*", r"\b", "^", "(?P<n>a)b", r"(a)\1", "a(?=b)", "[^a]b"]
)
def test_regular_expressions_match_python(spark, keyword):
    check(spark, TEXTS, keyword, 3, regex=True)


def test_whole_word_binds_loosely(spark):
    check(spark, ["cat dog catalog bulldog"], "cat|dog", 3, regex=True, whole_word=True)


def test_only_shared_syntax_runs_in_the_jvm():
    assert SearchPattern("a+b?c", regex=True).in_jvm
    assert not SearchPattern("a*", regex=True).in_jvm
    assert not SearchPattern("(?P<n>a)", regex=True).in_jvm
    assert SearchPattern("a*").in_jvm


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abé .\n", max_size=30), min_size=1, max_size=8), st.text("abé. ", min_size=1, max_size=2), st.integers(0, 5))
def test_any_text_matches_python(spark, texts, keyword, width):
    check(spark, texts, keyword, width)


def test_many_matches_in_one_text(spark):
    check(spark, ["ab " * 5000], "b", 7)


def test_no_match_gives_an_empty_table(sherlock):
    found = kwic.search(sherlock, "zebra")
    assert found.count() == 0
    assert kwic.total_matches(kwic.count_matches(sherlock, "zebra")).first() == (0, 1)


def test_bad_patterns_fail_before_planning(sherlock):
    with pytest.raises(ValueError, match="invalid regular expression"):
        kwic.search(sherlock, "(", regex=True)
    with pytest.raises(ValueError, match="empty"):
        kwic.search(sherlock, "")
    assert pattern_error("(") and pattern_error("a+") is None
    assert not Concordance(sherlock, "(", regex=True).is_valid()


def test_counts_and_pages(spark):
    texts = texts_of(spark, *["a b a"] * 21, "b")
    counts = kwic.count_matches(texts, "a")
    assert {row["n_matches"] for row in counts.collect()} == {2}
    assert kwic.total_matches(counts, 20).first() == (42, 3)
    shown = [Concordance(texts, "a").page(n).count() for n in (1, 2, 3, 4)]
    assert shown == [20, 20, 2, 0]


def test_many_keywords_in_one_pass(spark):
    found = kwic.search_many(texts_of(spark, "red and blue", "green", "Blue blue"), ["blue", "red"])
    got = sorted((row["text_id"], row["keyword"], row["match_no"]) for row in found.collect())
    assert got == [(0, "blue", 0), (0, "red", 0), (2, "blue", 0), (2, "blue", 1)]


# ---------------------------------------------------------------- chunks


def rows_of(spark, *lines, chunk=2):
    rows = spark.createDataFrame(list(enumerate(lines)), "row bigint, text string")
    return chunk_rows(rows.withColumn("speaker", F.concat(F.lit("s"), "row")), chunk)


def test_context_crosses_lines(spark):
    found = kwic.search_chunks(rows_of(spark, "one two", "three four"), "three", window_width=20)
    row = found.first()
    assert (row["left_context"], row["match"], row["right_context"]) == ("one two", "three", " four")
    assert (row["row"], row["text_id"]) == (1, 1)


def test_tags_can_stay(spark):
    rows = rows_of(spark, "one two", "three four")
    row = kwic.search_chunks(rows, "three", window_width=20, tag_lines=True).first()
    assert row["left_context"] == "0--one two1--"


def test_row_of_a_match_after_a_line_ending_in_digits(spark):
    rows = rows_of(spark, "in 2022", "pen one", "pen two", chunk=3)
    found = kwic.search_chunks(rows, "pen", window_width=50)
    assert sorted(row["row"] for row in found.collect()) == [1, 2]


def test_untagged_search_keeps_user_text(spark):
    rows = rows_of(spark, "1990--1995 war", "pen")
    row = kwic.search_chunks(rows, "pen", window_width=50, clean=True).first()
    assert row["left_context"] == "1990--1995 war"
    row = kwic.search_chunks(rows, "pen", window_width=50).first()
    assert row["left_context"] == "1995 war"


def test_metadata_and_sorting_of_chunks(spark):
    rows = rows_of(spark, "b pen", "a pen", "c", "pen d")
    found = kwic.search_chunks(rows, "pen", metadata=["speaker"], sort="left_context", window_width=4)
    got = [(row["row"], row["speaker"]) for row in found.collect()]
    assert sorted(got) == [(0, "s0"), (1, "s1"), (3, "s3")]


def test_metadata_is_deduplicated(spark):
    rows = rows_of(spark, "pen", "x")
    doubled = rows.unionByName(rows)
    hits = kwic.search_chunks(rows, "pen")
    assert kwic.add_metadata(hits.drop("text_id"), doubled, ["speaker"]).count() == 1


def test_loader_on_a_table(spark, sherlock):
    loader = TextLoader(spark, type="dataframe", df=sherlock, order="text_id", chunk=1)
    first = loader.chunks().orderBy("chunk").first()
    assert first["chunk"] == 0 and first["text"].startswith("0--To Sherlock")
    assert loader.columns() == ["text_id", "text", "speaker"]
    found = loader.search("she", metadata=["speaker"], sort="text_id")
    assert [(row["text_id"], row["speaker"]) for row in found.collect()] == [(0, "A"), (0, "A"), (2, "A")]
    with pytest.raises(ValueError, match="missing"):
        TextLoader(spark, type="dataframe")


@pytest.mark.parametrize("width", [2, 3, 4096])
def test_line_context(spark, width):
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(12)], "line_no bigint, text string")
    found = kwic.line_context(lines, "1", 2, width=width).orderBy("line_no").collect()
    assert [row["line_no"] for row in found] == [1, 10, 11]
    assert found[0]["before"] == ["line 0"] and found[0]["after"] == ["line 2", "line 3"]
    assert found[1]["before"] == ["line 8", "line 9"] and found[1]["after"] == ["line 11"]
    assert found[2]["before"] == ["line 9", "line 10"] and found[2]["after"] == []


def test_contexts_are_part_of_the_text(spark):
    texts = ["The cat sat on the mat, the end."]
    for row in kwic.search(texts_of(spark, *texts), "the", window_width=4).collect():
        assert row["left_context"] + row["match"] + row["right_context"] in texts[0]
        assert re.fullmatch("the", row["match"], re.IGNORECASE)


MARKS = ["कि का कि", "e\u0301te\u0301 été", "a_b a-b", "x\x1cy\x1fz", "ing, king_ singing", "٣٤ 12 ²"]


@pytest.mark.parametrize(
    "keyword, options",
    [
        ("क", {"whole_word": True}),
        ("e", {"whole_word": True}),
        (r"\w+", {"regex": True}),
        (r"\w+ing", {"regex": True}),
        (r"[\w-]+\s", {"regex": True}),
        (r"[^\s]+", {"regex": True}),
        (r"\Bi\w", {"regex": True}),
        (r"\d+", {"regex": True}),
        (r"\W+(?=\w)", {"regex": True}),
        (r"a(?!_)", {"regex": True}),
    ],
)
def test_words_are_those_of_python(spark, keyword, options):
    assert SearchPattern(keyword, **options).in_jvm
    check(spark, MARKS, keyword, 3, **options)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    text=st.text(alphabet="ab_ क\u093f\u0301é9٣²\x1c\x1d\x1e\x1f\x85\u2028.", min_size=1, max_size=20),
    keyword=st.sampled_from([r"\w+", r"\s", r"\S+", r"\bक", r"a\b", r"\B.", r"\D"]),
)
def test_classes_of_random_text(spark, text, keyword):
    check(spark, [text], keyword, 2, regex=True)


def test_many_takes_any_pattern(spark):
    found = kwic.search_many(texts_of(spark, "abab", "b"), ["b*", "(?P<n>a)b"], regex=True, window_width=1)
    counts = {(r["keyword"], r["text_id"]): r["n"] for r in found.groupBy("keyword", "text_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {("b*", 0): 5, ("b*", 1): 2, ("(?P<n>a)b", 0): 2}


def test_chunks_carry_rows_and_metadata_but_no_text(spark):
    rows = spark.createDataFrame(
        [(i, f"line {i} the", "xyz"[i % 3], None if i == 4 else i * 2) for i in range(40)],
        "row bigint, text string, tag string, extra int",
    )
    found = kwic.search_chunks(chunk_rows(rows, 7), "the", metadata=["tag", "extra"], clean=True)
    got = {(r["row"], r["tag"], r["extra"], r["chunk"]) for r in found.collect()}
    assert got == {(i, "xyz"[i % 3], None if i == 4 else i * 2, i // 7) for i in range(40)}
    assert not {"lines", "text"} & set(found.columns)
    alone = kwic.search_chunks(chunk_rows(rows, 1), "the", whole_rows=True, clean=True)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert {r["row"] for r in alone.collect()} == set(range(40))
