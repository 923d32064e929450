from turnwise.functions.patterns import SearchPattern, pattern_error
from turnwise.functions.text import (
    binding,
    default_stopwords,
    drop_stopwords,
    sentences,
    strip_spaces,
    strip_tags,
    token_count,
    tokens,
)

__all__ = [
    "SearchPattern",
    "binding",
    "default_stopwords",
    "drop_stopwords",
    "pattern_error",
    "sentences",
    "strip_spaces",
    "strip_tags",
    "token_count",
    "tokens",
]
