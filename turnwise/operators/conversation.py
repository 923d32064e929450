"""Descriptors of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.ordering import number_rows


def n_utterances(turns: DataFrame) -> DataFrame:
    """Turns per conversation."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_utterances"))


def n_speakers(turns: DataFrame) -> DataFrame:
    """Different speakers per conversation; unknown (null) speakers do not count.

    Written as two aggregations, so a huge conversation is first reduced to its speakers.
    """
    speakers = turns.select("conv_id", "speaker").distinct()
    return speakers.groupBy("conv_id").agg(F.count("speaker").alias("n_speakers"))


def speaker_names(turns: DataFrame) -> DataFrame:
    """``conv_id, speaker, first_turn, position``: speakers in order of their first turn."""
    first = turns.groupBy("conv_id", "speaker").agg(F.min("turn").alias("first_turn"))
    return number_rows(first, "first_turn", keys=["conv_id"], name="position")


def conversation_facts(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_speakers``."""
    speakers = turns.groupBy("conv_id", "speaker").agg(F.count("*").alias("__turns"))
    return speakers.groupBy("conv_id").agg(
        F.sum("__turns").alias("n_turns"), F.count("speaker").alias("n_speakers")
    )
