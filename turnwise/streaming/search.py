"""Streams of matches and of terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from turnwise.operators.concordance import search
from turnwise.operators.terms import turn_terms


def _write(rows: DataFrame, path: str, checkpoint: str | None) -> StreamingQuery:
    progress = checkpoint or path.rstrip("/") + "_progress"
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def search_stream(
    texts: DataFrame, keyword: str, path: str, *, checkpoint: str | None = None, **settings
) -> StreamingQuery:
    """Append the matches in new texts to a Parquet folder. Takes what has arrived and stops.

    Started again with the same ``path`` it goes on where it stopped: progress is kept in ``checkpoint``, by
    default a folder beside the results.
    """
    return _write(search(texts, keyword, **settings), path, checkpoint)


def terms_stream(
    texts: DataFrame,
    path: str,
    *,
    columns: Sequence[str] = ("text_id",),
    checkpoint: str | None = None,
    **options,
) -> StreamingQuery:
    """Append the words of new texts, without stop words, to a Parquet folder, like :func:`search_stream`."""
    return _write(turn_terms(texts, columns, **options), path, checkpoint)
