import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import clashing, rows
from turnwise.llm import source_divergence as module
from turnwise.llm.source_divergence import source_divergence, term_counts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(table, least=10, top=10):
    """Dense counts on Python's integers: rows of (lang, source, text)."""
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in table:
        found = TERM.findall((text or "").translate(UPPER))
        count[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (x, s), c in count.items() if x == lang}

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        share = {s: shares(c) for s, c in groups.items()}
        whole = shares(sum(groups.values(), Counter()))
        for s, p in share.items():
            pairs = [
                (-sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept), o.encode(), o)
                for o, q in share.items() if o != s
            ]
            terms = [
                (-((p[t] - whole[t]) ** 2 // (p[t] + whole[t])), t.encode(), t)
                for t in kept if groups[s][t] and p[t] > whole[t]
            ]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(items, 1)]
    return sorted(out, key=repr)


def table(spark, given):
    listed = [(i, text, lang, source) for i, (lang, source, text) in enumerate(given)]
    return spark.createDataFrame(listed, "doc_id bigint, text string, lang string, source string")


def result(found):
    return rows(found, "lang", "source", "part", "item", "value", "rank")


def mixture(seed, n=160, sources=9):
    draw = random.Random(seed)
    words = ["The", "the", "été", "été2x", "ÉTÉ", "don't", "水", "a_b", *(f"w{chr(97 + i)}" for i in range(20))]
    given = []
    for _ in range(n):
        source = f"s{min(draw.randrange(sources), draw.randrange(sources))}"
        text = " ".join(draw.choice(words) for _ in range(draw.randrange(12)))
        given.append((draw.choice(["en", "en", "fr"]), source, text))
    return given


ODD = [
    (None, None, None), (None, "x", "a " * 12), ("", None, "b"), ("en", "empty", ""), ("en", "void", None),
    ("en", "s0", "the\x00the \x7f^the[the`the"), ("xx", "alone", "word"), ("xx", "other", "—"),
    *[("yy", "copies", "same text")] * 30, *[("yy", "more", "same, text!")] * 3, ("yy", "é", "né"), ("yy", "z", "né"),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    given = mixture(seed) + ODD
    assert result(source_divergence(table(spark, given))) == brute(given)


def test_many_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 2)
    monkeypatch.setattr(module, "CELL", 5)
    given = mixture(3, sources=14) + ODD
    assert result(source_divergence(table(spark, given))) == brute(given)


def test_parameters(spark):
    given = mixture(4)
    found = source_divergence(table(spark, given), least_documents=3, top_terms=2)
    assert result(found) == brute(given, 3, 2)


def test_clashing_columns_repeats_and_order_of_arrival(spark):
    given = mixture(5) + ODD
    df = clashing(table(spark, given)).withColumns({c: F.lit("x") for c in ("term", "p", "bucket", "docs", "i")})
    assert result(source_divergence(df.repartition(3))) == brute(given)
    assert result(source_divergence(table(spark, given + given))) == brute(given + given)


def test_empty_table(spark):
    found = source_divergence(table(spark, []))
    assert found.count() == 0
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_long_text_is_counted_in_parts():
    text = "One two\x00three4four é " * 450_000
    batch = pa.record_batch({"lang": ["en"], "source": ["s"], "text": [text]})
    assert len(text) > module.SLICE
    (out,) = module._count_terms([batch])
    counts = {r["term"]: (r["n"], r["docs"]) for r in out.to_pylist()}
    assert counts == {t: (450_000, 1) for t in ("one", "two", "three", "four", "é")} | {None: (0, 0)}


def test_counts(spark):
    given = [("en", "a", "x X y"), ("en", "a", "x"), ("en", "b", "")]
    found = rows(term_counts(table(spark, given)), "lang", "source", "term", "n", "docs")
    assert found == [("en", "a", "x", 3, 2), ("en", "a", "y", 1, 1), ("en", "a", None, 0, 0), ("en", "b", None, 0, 0)]


def test_shares_of_huge_counts_are_exact(spark):
    big = 3 * 10**17
    df = spark.createDataFrame([(big, 10**18, 7)], "n bigint, total bigint, terms bigint")
    share = df.select(module._share(F.col("n"), "total")).first()[0]
    assert share == 1 + 10**9 * (big + 2) // (10**18 + 14)
