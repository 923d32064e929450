"""Text expressions: tokens, sentences, stop words. Each returns a Column and stays in the JVM.

Wherever an operator takes ``tokenizer`` or ``splitter`` it wants a ``Column -> Column`` function
like :func:`tokens` and :func:`sentences`; a pandas UDF wrapping a language model fits as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

TextFunction = Callable[[Column], Column]

# What counts as a word, as a mark of its own, and as a sentence.
WORD = r"[\p{L}\p{N}]+"
WORD_OR_MARK = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SENTENCE = r"[^.!?]+[.!?]*"
ROW_TAG = r"\d+--"
STOPWORD_LANGUAGES = ("english", "french", "german", "spanish")


def binding(value: Column, body: TextFunction) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    An expression written inside a higher-order function is evaluated for every element; bound
    this way it is not.
    """
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Lower-cased words of a text, in order, without punctuation or spaces."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of words and punctuation marks."""
    return F.regexp_count(text, F.lit(WORD_OR_MARK)).cast("bigint")


def sentences(text: Column) -> Column:
    """Sentences of a text, in order."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def default_stopwords(languages: Iterable[str] = STOPWORD_LANGUAGES) -> list[str]:
    """Spark's own stop lists, split into words the way :func:`tokens` splits text."""
    words: set[str] = set()
    for language in languages:
        for entry in StopWordsRemover.loadDefaultStopWords(language):
            spaced = "".join(c if c.isalnum() else " " for c in entry.lower())
            words.update(spaced.split())
    return sorted(words)


def drop_stopwords(
    words: str, stopwords: Sequence[str] | None = None, *, nested: bool = False
) -> Column:
    """Remove stop words from a column of arrays of words (``nested``: arrays of such arrays).

    ``None`` stands for :func:`default_stopwords`. Written as SQL text: the list becomes one hash set
    and costs one call, however long it is.
    """
    stop = default_stopwords() if stopwords is None else sorted({w.lower() for w in stopwords})
    if not stop:
        return F.col(words)
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in stop)
    keep = f"w -> w NOT IN ({quoted})"
    if nested:
        return F.expr(f"transform(`{words}`, list -> filter(list, {keep}))")
    return F.expr(f"filter(`{words}`, {keep})")


def strip_spaces(text: Column) -> Column:
    """Remove white space (any kind, not only blanks) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_tags(text: Column) -> Column:
    """Remove ``12--`` row tags."""
    return F.regexp_replace(text, ROW_TAG, "")
