"""Text and CSV files, numbered in file order without giving up parallel reading.

Rows of a file split come in order, so a row's number is the number of rows in the earlier splits of
its file plus its place in its own split. Only the per-split counts are ever moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.sources import quoted
from turnwise.sources.tables import keyed_lines, plain_lines

# Up to this many rows of per-split or per-file facts (about 200 bytes each) go to every executor.
BROADCAST_ROWS = 200_000
_WHERE = ["source_file", "__split"]


# The size units of Spark settings.
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(spark: SparkSession, name: str) -> int:
    value = spark.conf.get(name).strip().lower()
    digits = value.rstrip("bkmgt")
    return int(digits) * _UNITS[value[len(digits) :][:1]]


def split_bound(spark: SparkSession, path: str) -> int:
    """Most splits Spark can cut the files into; reads file lengths, not contents."""
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    opening = _bytes(spark, "spark.sql.files.openCostInBytes")
    largest = _bytes(spark, "spark.sql.files.maxPartitionBytes")
    files, total = sizes.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    per_core = (total + files * opening) // spark.sparkContext.defaultParallelism
    return files + total // max(1, min(largest, max(opening, per_core)))


def _located(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("__split"),
    )


def number_file_rows(
    located: DataFrame, *, small: bool, name: str = "row", place: str | None = None
) -> DataFrame:
    """Number rows per file from 0. ``small``: the per-split counts may be broadcast.

    Without ``place`` the rows must still lie as they were scanned.
    """
    if place is None:
        placed = located.withColumn("__place", F.monotonically_increasing_id())
    else:
        placed = located.withColumnRenamed(place, "__place")
    before = Window.partitionBy("source_file").orderBy("__split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        placed.groupBy(*_WHERE)
        .agg(F.count("*").alias("__rows"), F.min("__place").alias("__first"))
        .withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .drop("__rows")
    )
    joined = placed.join(F.broadcast(starts) if small else starts, _WHERE)
    if place is None:
        position = F.col("__place") - F.col("__first")
    else:
        position = F.row_number().over(Window.partitionBy(*_WHERE).orderBy("__place")) - 1
    return joined.withColumn(name, (F.col("__start") + position).cast("bigint")).drop(
        "__split", "__place", "__first", "__start"
    )


def read_csv(
    spark: SparkSession, path: str, *, schema: str | None = None, multi_line: bool = True
) -> DataFrame:
    """A CSV file with header, plus ``source_file`` and ``row``.

    Quoted fields may hold line breaks; a file is read by many tasks all the same (:mod:`turnwise.sources.quoted`).
    With files that have none, ``multi_line=False`` leaves it all to Spark's reader. Giving the ``schema`` saves a pass.
    """
    small = split_bound(spark, path) <= BROADCAST_ROWS
    if multi_line:
        lines = _located(spark.read.option("lineSep", "\n").text(path))
        records = quoted.quoted_records(lines, small=small)
        return number_file_rows(quoted.parsed(records, schema, small=small), small=small, place="__place")
    reader = spark.read.option("header", True).option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return number_file_rows(_located(reader.csv(path)), small=small)


def decode_with_fallback(content: Column, is_utf8: Column | None = None) -> Column:
    """Bytes as UTF-8 text where they are valid UTF-8, else as Latin-1."""
    valid = F.is_valid_utf8(content.cast("string")) if is_utf8 is None else is_utf8
    return F.when(valid, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``source_file, is_utf8`` for every file: one bad line makes the whole file Latin-1."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.is_valid_utf8("value").alias("ok")
    )
    return lines.groupBy("source_file").agg(F.bool_and("ok").alias("is_utf8"))


def _raw_lines(spark: SparkSession, path: str, encoding: str) -> tuple[DataFrame, bool, str | None]:
    lines = _located(spark.read.text(path).withColumnRenamed("value", "text"))
    small = split_bound(spark, path) <= BROADCAST_ROWS
    if encoding != "fallback":
        decoded = F.decode(F.col("text").cast("binary"), encoding)
        plain = encoding.lower().replace("-", "") == "utf8"
        return (lines if plain else lines.withColumn("text", decoded)), small, None
    known = file_encodings(spark, path)
    if small:
        known = F.broadcast(known)
    else:
        lines = lines.withColumn("__at", F.monotonically_increasing_id())
    decoded = decode_with_fallback(F.col("text").cast("binary"), F.col("is_utf8"))
    joined = lines.join(known, "source_file").withColumn("text", decoded).drop("is_utf8")
    return joined, small, None if small else "__at"


def _as_one(numbered: DataFrame) -> DataFrame:
    """Rows of the files of a folder, numbered per file, numbered on over all of them in the order of their names."""
    sizes = numbered.groupBy("source_file").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source_file", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    joined = numbered.join(starts, "source_file")
    return joined.withColumn("row", (F.col("__start") + F.col("row")).cast("bigint")).drop("__start")


def read_lines(spark: SparkSession, path: str, *, encoding: str = "fallback", as_one: bool = False) -> DataFrame:
    """Text files, one text per line: ``source_file, text, row``.

    Lines are stripped, those of at most one character dropped, the rest numbered per file.
    ``encoding="fallback"`` reads a file as UTF-8 if all of it is valid, else as Latin-1; naming
    the encoding saves that pass. With ``as_one`` the path is a folder that holds one text in several files, in the order of
    their names (as Spark writes a sorted table), and rows are numbered on from file to file.
    """
    lines, small, place = _raw_lines(spark, path, encoding)
    numbered = number_file_rows(plain_lines(lines), small=small, place=place)
    return _as_one(numbered) if as_one else numbered


def read_keyed_lines(
    spark: SparkSession, path: str, symbol: str, *, encoding: str = "fallback"
) -> DataFrame:
    """Text files of ``key<symbol>text`` lines: ``source_file, text, key, row``."""
    lines, small, place = _raw_lines(spark, path, encoding)
    return number_file_rows(keyed_lines(lines, symbol), small=small, place=place)
