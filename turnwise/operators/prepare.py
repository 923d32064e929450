"""Bring texts and conversations into the standard columns, number rows, form chunks."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import TextFunction, tokens
from turnwise.operators.ordering import TURN_BLOCK, block_of, number_rows

# Columns the engine adds; everything else belongs to the user.
ENGINE_COLUMNS = ("row", "chunk", "tokens")


def _rename(df: DataFrame, column: str, wanted: str) -> DataFrame:
    if column == wanted:
        return df
    if wanted in df.columns:
        warnings.warn(
            f"the data already has a column {wanted!r}; it becomes {wanted + '_original'!r} "
            f"because {column!r} is used instead",
            stacklevel=3,
        )
        df = df.withColumnRenamed(wanted, f"{wanted}_original")
    return df.withColumnRenamed(column, wanted)


def prepare_texts(
    df: DataFrame,
    text_column: str = "text",
    id_column: str | None = None,
    *,
    order: str | None = None,
    tokenizer: TextFunction | None = tokens,
) -> DataFrame:
    """Standard text table: ``text_id``, ``text``, the other columns, and ``tokens``.

    Without ``id_column`` the texts are numbered from 0 by the integral column ``order``.
    """
    if id_column is None:
        if order is None:
            raise ValueError("give id_column, or an order column to number the texts by")
        df = number_rows(df.drop("text_id") if order != "text_id" else df, order)
    else:
        df = _rename(df, id_column, "text_id")
    df = _rename(df, text_column, "text")
    return df if tokenizer is None else df.withColumn("tokens", tokenizer(F.col("text")))


def prepare_turns(
    df: DataFrame,
    text_column: str = "text",
    speaker_column: str = "speaker",
    id_column: str | None = None,
    *,
    conversation_column: str = "conv_id",
    turn_column: str = "turn",
    dense: bool = False,
) -> DataFrame:
    """Standard conversation table: ``conv_id``, ``turn``, ``text_id``, ``speaker``, ``text``, extras.

    ``turn`` counts the turns of a conversation from 0, without gaps. Pass ``dense=True`` where the
    column already does; otherwise it is computed from the integral ``turn_column``, which stays as
    ``<name>_original``.
    A column in the way of a renamed one is kept as ``<name>_original``, with a warning.
    """
    df = _rename(df, text_column, "text")
    df = _rename(df, speaker_column, "speaker")
    df = _rename(df, conversation_column, "conv_id")
    if not dense:
        df = number_rows(df, turn_column, keys=["conv_id"], name="__turn")
        df = df.withColumnRenamed(turn_column, f"{turn_column}_original")
        df = _rename(df, "__turn", "turn")
    else:
        df = _rename(df, turn_column, "turn")
    if id_column is None:
        return df.withColumn("text_id", F.col("turn").cast("bigint"))
    return _rename(df, id_column, "text_id")


def with_block(turns: DataFrame, brief: bool = False, width: int = TURN_BLOCK) -> DataFrame:
    """Add ``block``, the unit in which a long conversation is worked on.

    Where all conversations are ``brief`` there is nothing to cut and no column is added.
    """
    return turns if brief else turns.withColumn("block", block_of("turn", width))


def chunk_rows(df: DataFrame, chunk: int = 1, row: str = "row") -> DataFrame:
    """Add ``chunk``: every ``chunk`` consecutive rows share a number."""
    if chunk < 1:
        raise ValueError("chunk must be at least 1")
    return df.withColumn("chunk", block_of(row, chunk))


def tag_rows(df: DataFrame, row: str = "row", text: str = "text") -> DataFrame:
    """Put the row number in front of the text: ``12--text``."""
    return df.withColumn(text, F.concat(F.col(row).cast("string"), F.lit("--"), F.col(text)))


def concat_chunks(tagged: DataFrame, *, keys: Sequence[str] = (), row: str = "row") -> DataFrame:
    """One text per chunk: its tagged rows joined without separator, in row order."""
    lines = F.sort_array(F.collect_list(F.struct(row, "text")))
    grouped = tagged.groupBy(*keys, "chunk").agg(lines.alias("lines"))
    return grouped.select(*keys, "chunk", F.array_join("lines.text", "").alias("text"))


def largest_text_length(texts: DataFrame, text: str = "text") -> DataFrame:
    """Length of the longest text."""
    return texts.agg(F.max(F.length(text)).cast("bigint").alias("largest_text_length"))


def metadata_columns(df: DataFrame, extra: Sequence[str] = ()) -> list[str]:
    """Columns a user may show next to a match: all but the engine's own."""
    return [c for c in df.columns if c not in {*ENGINE_COLUMNS, *extra}]


def metadata(df: DataFrame) -> DataFrame:
    """The table reduced to :func:`metadata_columns`."""
    return df.select(*metadata_columns(df))


def stack_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Append tables by column name; a column missing in one becomes null there."""
    if not tables:
        raise ValueError("no tables given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
