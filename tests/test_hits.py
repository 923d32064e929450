"""Matches of patterns that only Python reads: streamed in bounded batches, equal to ``re``."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from turnwise.functions.keywords import Keywords
from turnwise.operators import concordance as kwic
from turnwise.operators import hits

TEXTS = ["", "axxb été xé", "Ünï x\nx 漢字xx", "plain", None, "🙂x🙂" * 5]


def expected(pattern, text, width):
    return [
        (i, text[max(m.start() - width, 0) : m.start()], m.group(), text[m.end() : m.end() + width], m.start())
        for i, m in enumerate(re.finditer(pattern, text, re.IGNORECASE))
    ]


def test_matches_that_only_python_finds(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "text_id bigint, text string")
    found = kwic.search(df, "x*", regex=True, window_width=3, offsets=True, columns=("text_id", "text"))
    assert found.columns == ["text_id", "text", "match_no", "left_context", "match", "right_context", "start"]
    want = [(i, t, *row) for i, t in enumerate(TEXTS) if t is not None for row in expected("x*", t, 3)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    many = kwic.search_many(df, ["x*", "[aé]", "(?<=x)."], regex=True, window_width=2)
    for word in ("x*", "[aé]", "(?<=x)."):
        part = many.where(F.col("keyword") == word).drop("keyword")
        want = [(i, *row[:-1]) for i, t in enumerate(TEXTS) if t is not None for row in expected(word, t, 2)]
        assert sorted(map(tuple, part.collect())) == sorted(want)


def test_a_task_never_holds_the_matches_of_a_batch():
    text = pa.array(["a" * 50_000, None, "", "b" * 30_000] * 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), text], names=["text_id", "text"])
    names = ["text_id", "match_no", "left_context", "match", "right_context"]
    got = list(
        hits._found([batch], spans=hits.searched(re.compile("x*")), keywords=None, width=5, names=names, offsets=False, lines=False)
    )
    assert max(b.num_rows for b in got) <= 2 * hits.ROWS
    assert sum(b.num_rows for b in got) == 3 * (50_001 + 1 + 30_001)
    # What the matches carry counts, too.
    wide = pa.RecordBatch.from_arrays([text, text], names=["text_id", "text"])
    for b in hits._found([wide], spans=hits.searched(re.compile("x*")), keywords=None, width=5, names=names, offsets=False, lines=False):
        assert b.nbytes < 4 * hits.BYTES
        break


def test_keywords_are_streamed_too():
    known = Keywords(["a", "aa"], True, False)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a" * 100_000])], names=["text_id", "text"])
    names = ["text_id", "keyword", "match_no", "left_context", "match", "right_context"]
    got = list(hits._found([batch], spans=known.numbered, keywords=known.keywords, width=5, names=names, offsets=False, lines=False))
    assert sum(b.num_rows for b in got) == 150_000
    assert max(b.num_rows for b in got) <= 2 * hits.ROWS


def test_lines_of_chunks_found_by_python(spark):
    rows = [(i, i // 3, t, f"m{i}") for i, t in enumerate(["one x", "", "xx é", "x", "two", "🙂xx x"])]
    df = spark.createDataFrame(rows, "row bigint, chunk bigint, text string, tag string")
    by_python = kwic.search_chunks(df, "(?<=)x+", regex=True, window_width=4, clean=True, metadata=["tag"])
    by_spark = kwic.search_chunks(df, "x+", regex=True, window_width=4, clean=True, metadata=["tag"])
    assert by_python.columns == by_spark.columns
    assert sorted(map(tuple, by_python.collect())) == sorted(map(tuple, by_spark.collect()))
