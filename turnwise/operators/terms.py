"""Terms and their frequencies, per conversation or any other grouping column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import TextFunction, drop_stopwords, tokens
from turnwise.operators.ordering import top_rows

METHODS = ("overall", "n_turns")


def turn_terms(
    texts: DataFrame,
    columns: Sequence[str],
    *,
    stopwords: Sequence[str] | None = None,
    tokenizer: TextFunction = tokens,
    distinct: bool = False,
) -> DataFrame:
    """One row per word of a text (or per different word), without stop words."""
    words = drop_stopwords("__words", stopwords)
    split = texts.select(*columns, tokenizer(F.col("text")).alias("__words"))
    return split.select(*columns, F.explode(F.array_distinct(words) if distinct else words).alias("term"))


def term_frequencies(
    texts: DataFrame,
    method: str = "overall",
    *,
    keys: Sequence[str] = ("conv_id",),
    stopwords: Sequence[str] | None = None,
    tokenizer: TextFunction = tokens,
) -> DataFrame:
    """``keys, term, frequency``: occurrences of a term, or number of turns it occurs in."""
    if method not in METHODS:
        raise ValueError(f"invalid method {method!r}: should be one of {METHODS}")
    terms = turn_terms(
        texts, keys, stopwords=stopwords, tokenizer=tokenizer, distinct=method == "n_turns"
    )
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("frequency"))


def all_terms(texts: DataFrame, *, keys: Sequence[str] = ("conv_id",), **options) -> DataFrame:
    """Vocabulary: the different terms of each group."""
    return turn_terms(texts, keys, distinct=True, **options).distinct()


def top_terms(
    texts: DataFrame,
    n: int = 10,
    method: str = "overall",
    *,
    keys: Sequence[str] = ("conv_id",),
    **options,
) -> DataFrame:
    """The ``n`` most frequent terms of each group, with ``rank``; ties in term order."""
    frequencies = term_frequencies(texts, method, keys=keys, **options)
    return top_rows(frequencies, keys, [F.desc("frequency"), F.asc("term")], n)


def key_terms(
    texts: DataFrame,
    terms: str | int | Sequence[str] = 20,
    *,
    keys: Sequence[str] = ("conv_id",),
    **options,
) -> DataFrame:
    """``keys, term``: all terms, the top terms by number of turns, or the given ones that occur."""
    check_key_terms(terms)
    if isinstance(terms, int):
        return top_terms(texts, terms, "n_turns", keys=keys, **options).select(*keys, "term")
    vocabulary = all_terms(texts, keys=keys, **options)
    if terms == "all":
        return vocabulary
    return vocabulary.filter(F.col("term").isin([t for t in terms]))


def check_key_terms(terms: object) -> None:
    if terms == "all" or (isinstance(terms, int) and not isinstance(terms, bool) and terms > 0):
        return
    if isinstance(terms, Sequence) and not isinstance(terms, str) and len(terms):
        return
    raise ValueError(f"key terms must be 'all', a number from 1 or a sequence of terms, not {terms!r}")


def doc_term(
    texts: DataFrame, columns: Sequence[str] = ("conv_id", "turn"), **options
) -> DataFrame:
    """Which term occurs in which turn: one row per pair."""
    return turn_terms(texts, columns, distinct=True, **options)
