"""Substring dedup with content-defined chunks.

A gear hash rolls over the bytes of a text; where its upper bits are zero a chunk may end. The cut is
taken if no other place in the ``MIN_CHUNK`` bytes before qualifies, so that a cut depends on the few bytes before
it and on nothing else: two texts that share a passage are cut alike inside it, however much was inserted
before. Chunks are compared by digest; of equal chunks the first one, by ``doc_id`` and place, stays. Neighbouring
chunks that are repeats form a run, and runs of ``min_chars`` characters or more are removed.

Chunks are short beside the runs looked for, so that a passage loses little at its ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import words
from turnwise.llm.words import U64, mix, pieces, seeds

WINDOW = 16  # bytes in the rolling hash: as many as it has bits
ZERO_BITS = 4
MIN_CHUNK = 10
MAX_CHUNK = 256
MIN_CHARS = 80

_GEAR = (seeds(256, 911) >> U64(48)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: ``h = (h << 1) + GEAR[byte]``, 16 bits, by doubling the window."""
    value = _GEAR[data]
    width = 1
    while width < WINDOW:
        value[width:] += value[:-width] << np.uint16(width)  # right side is taken before the sum is stored
        width *= 2
    return value


def cuts(data: np.ndarray) -> np.ndarray:
    """The ends of all chunks of a text, its own end last. No chunk ends inside a character."""
    size = len(data)
    found = np.flatnonzero(gear(data) >> np.uint16(16 - ZERO_BITS) == 0) + 1
    found = found[found >= WINDOW]
    if len(found):
        apart = np.concatenate(([True], np.diff(found) > MIN_CHUNK))
        found = found[apart]
    found = np.append(found[found < size], size)
    gaps = np.diff(found, prepend=0)
    if (gaps > MAX_CHUNK).any():
        more = [
            np.arange(end - gap + MAX_CHUNK, end, MAX_CHUNK)
            for end, gap in zip(found[gaps > MAX_CHUNK].tolist(), gaps[gaps > MAX_CHUNK].tolist())
        ]
        found = np.unique(np.concatenate([found, *more]))
    inside = np.append((data & 0xC0) == 0x80, False)
    while inside[found].any():
        found = found + inside[found]
    return np.unique(found)


def _digests(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk."""
    words.Tables.make()
    out = []
    starts = np.concatenate(([0], ends[:-1]))
    first = 0
    while first < len(ends):  # a slab at a time
        base = starts[first]
        last = int(np.searchsorted(ends, base + words.SLAB, side="right"))
        last = max(last, first + 1)
        part = data[base : ends[last - 1]]
        total = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(words.Tables.byte[part] * words.Tables.power[: len(part)], out=total[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        out.append(mix((total[b] - total[a]) * words.Tables.inverse[a] + (b - a).astype(U64)))
        first = last
    return np.concatenate(out)


def text_chunks(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths (in characters) and digests of the chunks of a text. An empty text has none."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    ends = cuts(data)
    digests = _digests(data, ends).view(np.int64)
    if len(data) != len(text):
        ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[ends]
    starts = np.concatenate(([0], ends[:-1]))
    return starts, ends - starts, digests


def _row_key():
    """Tells rows apart, also those that share an id or have none; repeated rows are one."""
    return F.xxhash64("doc_id", "text")


def chunk_table(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row_key``, ``start``, ``length``, ``digest`` of every chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=2 << 20):
            found = [text_chunks(x) for x in batch.column(2).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            starts, lengths, digests = (np.concatenate([x[i] for x in found]) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    batch.column(1).take(pa.array(rows)),
                    pa.array(starts.astype(np.int32)),
                    pa.array(lengths.astype(np.int32)),
                    pa.array(digests.astype(np.int64)),
                ],
                ["doc_id", "row_key", "start", "length", "digest"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.select("doc_id", _row_key().alias("row_key"), "text").mapInArrow(
        run, "doc_id long, row_key long, start int, length int, digest long"
    )


def _runs(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, keys, lists = batch.columns
            rows, starts, lengths, firsts = [], [], [], []
            for i in range(batch.num_rows):
                chunks = lists[i].values
                start, length, first = (chunks.field(n).to_numpy(zero_copy_only=False) for n in (0, 1, 2))
                new = np.append(True, start[1:] != start[:-1] + length[:-1])
                begins = np.flatnonzero(new)
                ends = np.append(begins[1:], len(start)) - 1
                total = start[ends] + length[ends] - start[begins]
                for b, size in zip(begins[total >= min_chars], total[total >= min_chars]):
                    rows.append(i)
                    starts.append(start[b])
                    lengths.append(size)
                    firsts.append(first[b])
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.take(pa.array(rows, pa.int32())),
                    keys.take(pa.array(rows, pa.int32())),
                    pa.array(starts, pa.int32()),
                    pa.array(lengths, pa.int32()),
                    pa.array([None if x != x else int(x) for x in firsts], pa.int64()),
                ],
                ["doc_id", "row_key", "start", "length", "first_doc_id"],
            )

    return run


def repeated_spans(docs: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """The passages that occur earlier in the corpus too: ``doc_id``, ``row_key``, ``start``, ``length`` (characters) and
    ``first_doc_id``, the document in which the passage begins to be kept.

    The occurrence with the least ``doc_id`` and place is not listed. Case and white space count. Null and empty texts have
    no passages. Rows that repeat id and text are one document. A null ``doc_id`` comes before all others. Extra columns
    are not looked at; an empty table gives an empty result.
    """
    chunks = chunk_table(docs)
    first = chunks.groupBy("digest").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "row_key", "start")).alias("first")
    )
    first = first.where("times > 1").select(
        "digest",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.row_key").alias("first_key"),
        F.col("first.start").alias("first_start"),
    )
    later = chunks.join(first, "digest").where("row_key <> first_key OR start <> first_start")
    listed = later.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "length", "first_doc_id"))).alias("chunks")
    )
    return listed.mapInArrow(
        _runs(min_chars), "doc_id long, row_key long, start int, length int, first_doc_id long"
    )


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the passages of ``spans``; ``n_chars``, if there is one, is counted again."""
    listed = spans.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("cut_spans"))
    text = F.col("text").cast("string")
    keyed = docs.withColumn(
        "cut_key", F.xxhash64(F.col("doc_id").cast("long"), text)
    ).join(listed.withColumnRenamed("row_key", "cut_key"), "cut_key", "left")
    # Between two spans the text stays: from the end of one to the start of the next.
    ends = F.transform("cut_spans", lambda s: s["start"] + s["length"])
    starts = F.transform("cut_spans", lambda s: s["start"])
    left = F.zip_with(
        F.concat(F.array(F.lit(0)), ends),
        F.concat(starts, F.array(F.lit(2147483647))),
        lambda a, b: F.substring(F.col("text"), a + 1, b - a),
    )
    cleaned = F.when(F.col("cut_spans").isNull(), text).otherwise(F.array_join(left, ""))
    out = keyed.withColumn("text", cleaned)
    if "n_chars" in docs.columns:
        size = F.length("text").cast("long")
        out = out.withColumn("n_chars", F.when(F.col("cut_spans").isNull(), F.col("n_chars")).otherwise(size))
    return out.select(*docs.columns)
