"""Texts that are already in a table: whole texts, or texts to be cut into lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import strip_spaces


def from_dataframe(df: DataFrame | None) -> DataFrame:
    """A table given by the caller, unchanged."""
    if df is None:
        raise ValueError("the table is missing: pass a DataFrame")
    return df


def deal_out(df: DataFrame) -> DataFrame:
    """Spread a table that comes in fewer pieces than there are cores; leave any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def split_lines(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Cut every text at its line ends: ``keys, line_no, text``."""
    lines = F.split(F.col(text), "\n", -1)
    cut = df.select(*keys, F.posexplode(lines).alias("line_no", "text"))
    return cut.withColumn("line_no", F.col("line_no").cast("bigint"))


def plain_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Strip every line and drop the ones of at most one character."""
    return lines.withColumn(text, strip_spaces(F.col(text))).filter(F.length(text) > 1)


def key_and_rest(line: Column, symbol: str) -> tuple[Column, Column]:
    """What precedes the first symbol, and all that follows it."""
    mark = F.lit(symbol)
    rest = F.substring(
        line, F.instr(line, mark) + F.lit(len(symbol)), F.length(line)
    )
    return F.substring_index(line, symbol, 1), rest


def keyed_lines(lines: DataFrame, symbol: str, text: str = "text") -> DataFrame:
    """Split ``key<symbol>text`` lines at the first symbol; lines without one are dropped."""
    if not symbol:
        raise ValueError("the symbol is empty")
    stripped = lines.withColumn(text, strip_spaces(F.col(text)))
    kept = stripped.filter(F.contains(text, F.lit(symbol)))
    key, rest = key_and_rest(F.col(text), symbol)
    return kept.withColumn("key", key).withColumn(text, rest)
