"""Intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from turnwise.session import configure, scratch_path

BATCH_ROWS = 2000
FEW_ROWS = 256  # where several steps share the memory of an executor
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder that all executors share, and go on from the written rows.

    The lineage ends there: when an executor is lost, later steps read the table again instead of
    computing it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries made inside the block delete the files of their shuffles when they end, not at some later collection.

    A DataFrame that is handed out is better made outside, as whoever runs it again would need these files.
    """
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


def passing(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`written` for a large table that is soon deleted: the written rows and their folder. What was shuffled to make them
    is deleted at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries run inside the block hand Python at most ``rows`` rows at a time."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def prepared(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """The session with the settings that the operators want.

    Python is handed few rows at a time, ``rows`` at most: texts are long, and a batch lies in memory on both sides.
    """
    configure(spark).conf.set(_BATCH, str(rows))
    return spark
