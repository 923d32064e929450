"""Searching and tokenising texts as they arrive.

The text operators are projections without state, so they take a streaming DataFrame as it is.
"""

from turnwise.streaming.search import search_stream, terms_stream

__all__ = ["search_stream", "terms_stream"]
