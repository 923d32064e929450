"""CSV files whose quoted fields hold line breaks, read by many tasks however large a file is.

Where a record starts depends on whether the line before ended inside quotes, and that on everything before it. A line turns
each of the two states it can start in into one it ends in, so every split of a file is summed up by two answers in
a first pass; chained over the splits of the file, they give each split its true state, and in a second pass every split
cuts its own records. Records that cross a border are put together from their fragments, a few per split.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = pa.schema(
    [("source_file", pa.string()), ("__split", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_())]
)
RECORDS = pa.schema(
    [("source_file", pa.string()), ("__split", pa.int64()), ("__place", pa.int64()), ("__record", pa.string()),
     ("__starts", pa.bool_()), ("__ends", pa.bool_())]
)
# Records given back at a time, in characters.
HELD = 1 << 22


def ends_inside(line: str, inside: bool) -> bool:
    """Does a line that starts inside (or outside) a quoted field end inside one? Quotes are doubled inside quotes.

    Outside, a quote opens a field only where the field starts; elsewhere it is a character like any other.
    """
    if '"' not in line:
        return inside
    at, end = 0, len(line)
    while True:
        if not inside:
            while at < end and line[at] != '"':  # at the start of a field that is not quoted
                comma = line.find(",", at)
                if comma < 0:
                    return False
                at = comma + 1
            if at >= end:
                return False
            at += 1
        while True:  # inside quotes
            quote = line.find('"', at)
            if quote < 0:
                return True
            at = quote + 1
            if line[at : at + 1] != '"':
                break
            at += 1
        comma = line.find(",", at)
        if comma < 0:
            return False
        at, inside = comma + 1, False


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, list]]:
    """Lines of one split at a time, as they lie in the file: the split, and the rows of a batch."""
    for batch in batches:
        rows = batch.to_pylist()
        start = 0
        for at in range(1, len(rows) + 1):
            here = (rows[start]["source_file"], rows[start]["__split"])
            if at == len(rows) or (rows[at]["source_file"], rows[at]["__split"]) != here:
                yield here, rows[start:at]
                start = at


def _sum_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, states = None, (False, True)
    for split, rows in _runs(batches):
        if split != current:
            if current is not None:
                yield _answer(current, states)
            current, states = split, (False, True)
        for row in rows:
            states = tuple(ends_inside(row["value"], s) for s in states)
    if current is not None:
        yield _answer(current, states)


def _answer(split: tuple[str, int], states: tuple[bool, bool]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*split, *states)], schema=STATES)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split; the first and the last may be fragments."""
    out: list[tuple] = []
    size = 0
    current, held, first, inside, starts = None, [], 0, False, True

    def flush(ends: bool) -> None:
        nonlocal held, size
        if held:
            text = "\n".join(held)
            out.append((*current, first, text, starts, ends))
            size += len(text)
        held = []

    for split, rows in _runs(batches):
        if split != current:
            flush(False)
            current, inside = split, rows[0]["__inside"]
            starts, first = not inside, rows[0]["__place"]
        for row in rows:
            if not held:
                first = row["__place"]
            held.append(row["value"])
            inside = ends_inside(row["value"], inside)
            if not inside:
                flush(True)
                starts = True
        if size > HELD:
            yield _table(out)
            out, size = [], 0
    flush(False)
    if out:
        yield _table(out)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORDS)], schema=RECORDS)


def _start_states(lines: DataFrame) -> DataFrame:
    """``source_file, __split, __inside``: does a split start inside quotes?"""
    kind = "source_file string, __split bigint, from_outside boolean, from_inside boolean"
    answers = lines.select("source_file", "__split", "value").mapInArrow(_sum_up, kind)
    # The last split before that gives the same answer for both states settles it; from there on every split that swaps
    # the two answers turns the state over.
    earlier = Window.partitionBy("source_file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("from_outside") == F.col("from_inside")
    turns = F.when(~settles & F.col("from_outside"), 1).otherwise(0)
    counted = answers.select("source_file", "__split", "from_outside", settles.alias("settles"), turns.alias("turns"))
    running = counted.withColumn("so_far", F.sum("turns").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    settled = F.struct(F.col("from_outside").cast("int").alias("state"), "so_far")
    last = F.last(F.when(F.col("settles"), settled), ignorenulls=True).over(earlier)
    before = F.coalesce(F.sum("turns").over(earlier), F.lit(0))
    since = before - F.coalesce(last["so_far"], F.lit(0)) + F.coalesce(last["state"], F.lit(0))
    return running.select("source_file", "__split", (since % 2 == 1).alias("__inside"))


def quoted_records(lines: DataFrame, *, small: bool) -> DataFrame:
    """``source_file, __split, __place, __record`` from the lines of CSV files, ``source_file, __split, value``.

    The lines must still lie as they were scanned, cut at ``\\n``. ``small``: the per-split states may be broadcast.
    """
    placed = lines.withColumn("__place", F.monotonically_increasing_id())
    states = _start_states(lines)
    keys = ["source_file", "__split"]
    known = placed.join(F.broadcast(states) if small else states, keys)
    if not small:
        known = known.repartition(*keys).sortWithinPartitions(*keys, "__place")
    columns = ["source_file", "__split", "__place", "value", "__inside"]
    kind = "source_file string, __split bigint, __place bigint, __record string, __starts boolean, __ends boolean"
    pieces = known.select(*columns).mapInArrow(_cut, kind)
    whole = pieces.where("__starts AND __ends").drop("__starts", "__ends")
    parts = pieces.where("NOT (__starts AND __ends)")
    order = Window.partitionBy("source_file").orderBy("__split", "__place")
    parts = parts.withColumn("__number", F.sum(F.col("__starts").cast("int")).over(order))
    piece = F.struct("__split", "__place", F.col("__record").alias("text"))
    joined = parts.groupBy("source_file", "__number").agg(F.sort_array(F.collect_list(piece)).alias("parts"))
    first = F.col("parts")[0]
    crossing = joined.select(
        "source_file", first["__split"].alias("__split"), first["__place"].alias("__place"),
        F.array_join(F.col("parts.text"), "\n").alias("__record"),
    )
    return whole.unionByName(crossing)


# Types that are tried on a column of text, in this order, as Spark's own reader does.
_TRIED = ("int", "bigint", "double", "date", "timestamp", "boolean")


def inferred(values: DataFrame) -> str:
    """The schema of columns of text: the first type that all values of a column have, in one pass."""
    fits = [
        F.bool_and(F.col(f"`{c}`").isNull() | F.expr(f"try_cast(`{c}` AS {kind}) IS NOT NULL")).alias(f"{i}_{kind}")
        for i, c in enumerate(values.columns)
        for kind in _TRIED
    ]
    found = values.agg(*[F.count(f"`{c}`").alias(f"{i}_n") for i, c in enumerate(values.columns)], *fits).first()
    kinds = [
        next((k for k in _TRIED if found[f"{i}_n"] and found[f"{i}_{k}"]), "string") for i in range(len(values.columns))
    ]
    return ", ".join(f"`{c}` {k}" for c, k in zip(values.columns, kinds))


def parsed(records: DataFrame, schema: str | None, *, small: bool) -> DataFrame:
    """The columns of the records; the first record of each file is its header."""
    keys = ["source_file", "__split", "__place"]
    full = records.where(~F.col("__record").isin("", "\r"))
    heads = full.groupBy("source_file").agg(F.min(F.struct("__split", "__place", "__record")).alias("head"))
    options = {"escape": '"'}
    if schema is None:
        names = _header(heads)
        text = ", ".join(f"`{n}` string" for n in names)
        schema = inferred(_body(full, heads, text, options, small).select(*[f"`{n}`" for n in names]))
    return _body(full, heads, schema, options, small, keys)


def _header(heads: DataFrame) -> list[str]:
    row = heads.orderBy("source_file").select("head.__record").first()
    if row is None:
        return []
    return [name or f"_c{i}" for i, name in enumerate(next(csv.reader([row[0]])))]


def _body(
    full: DataFrame, heads: DataFrame, schema: str, options: dict, small: bool, keys: Sequence[str] = ()
) -> DataFrame:
    head = heads.select("source_file", F.col("head.__split").alias("__s"), F.col("head.__place").alias("__p"))
    body = full.join(F.broadcast(head) if small else head, "source_file").where("__split <> __s OR __place <> __p")
    fields = F.from_csv(F.rtrim("__record", F.lit("\r")), schema, options)
    return body.select(*keys, fields.alias("__fields")).select(*keys, "__fields.*")
