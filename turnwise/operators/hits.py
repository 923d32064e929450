"""Matches found in Python, as a stream of rows: a task holds one text and a bounded number of matches, never those of a batch.

Spans come from ``re.finditer`` or an automaton; the strings around them are cut from the bytes of the text, all at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Matches, and about so many bytes of them with what they carry, per batch of results.
ROWS = 1 << 14
BYTES = 1 << 23
# Texts that are Python strings at a time.
TEXTS = 64

#: Number of the keyword, number of the match of that keyword, start and end of every match of a text.
Spans = Callable[[str], Iterator[tuple[int, int, int, int]]]


def regex_spans(pattern: re.Pattern[str], text: str) -> Iterator[tuple[int, int, int, int]]:
    for number, m in enumerate(pattern.finditer(text)):
        yield 0, number, m.start(), m.end()


def patterns_spans(patterns: Sequence[re.Pattern[str]], text: str) -> Iterator[tuple[int, int, int, int]]:
    """The same for several expressions, one after the other."""
    for at, pattern in enumerate(patterns):
        for _, number, start, end in regex_spans(pattern, text):
            yield at, number, start, end


class _Bytes:
    """A text as bytes; cuts many pieces given by characters."""

    def __init__(self, text: str) -> None:
        self.data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        self.n = len(text)
        self.place = None
        if len(self.data) != self.n:
            self.place = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))

    def cut(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        if self.place is not None:
            start, end = self.place[start], self.place[end]
        length = end - start
        edges = np.concatenate([[0], np.cumsum(length)])
        index = np.arange(edges[-1]) + np.repeat(start - edges[:-1], length)
        buffers = [pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(self.data[index])]
        return pa.StringArray.from_buffers(len(start), *buffers)


def _found(
    batches: Iterable[pa.RecordBatch], *, spans: Spans, keywords: Sequence[str] | None, width: int, names: Sequence[str],
    offsets: bool, lines: bool,
) -> Iterator[pa.RecordBatch]:
    words = None if keywords is None else pa.array(keywords, pa.string())
    for batch in batches:
        kept, texts = batch.columns[:-1], batch.column(batch.num_columns - 1)
        if lines:
            *kept, sources, starts = kept
            firsts = sources.offsets.to_numpy()
        held: list[tuple[np.ndarray, list[pa.Array]]] = []
        rows = size = 0

        def flush(kept: list[pa.Array]) -> pa.RecordBatch:
            index = pa.array(np.concatenate([at for at, _ in held]))
            own = [pa.concat_arrays(parts) for parts in zip(*(columns for _, columns in held))]
            if lines:
                own[-1] = sources.values.take(own[-1])
            return pa.RecordBatch.from_arrays([*[c.take(index) for c in kept], *own], names=list(names))

        for first in range(0, len(texts), TEXTS):
            for at, text in enumerate(texts.slice(first, TEXTS).to_pylist(), first):
                if text is None:
                    continue
                found = spans(text)
                cutter = None
                carried = 64 + 8 * width + sum(c.slice(at, 1).nbytes for c in kept)
                while some := [*islice(found, max(1, min(ROWS, BYTES // carried)))]:
                    some = np.array(some, dtype=np.int64)
                    cutter = cutter or _Bytes(text)
                    number, match_no, start, end = some.T
                    columns = [
                        pa.array(match_no),
                        cutter.cut(np.maximum(start - width, 0), start),
                        cutter.cut(start, end),
                        cutter.cut(end, np.minimum(end + width, cutter.n)),
                    ]
                    if words is not None:
                        columns = [words.take(pa.array(number)), *columns]
                    if offsets:
                        columns.append(pa.array(start))
                    if lines:
                        line = np.searchsorted(starts[at].values.to_numpy(), start, side="right") - 1
                        columns.append(pa.array(firsts[at] + line))
                    held.append((np.full(len(some), at), columns))
                    rows += len(some)
                    size += len(some) * carried + int((end - start).sum())
                    if rows >= ROWS or size >= BYTES:
                        yield flush(kept)
                        held, rows, size = [], 0, 0
        if held:
            yield flush(kept)


def found_rows(
    df: DataFrame, columns: Sequence[str], text: str, spans: Spans, width: int, *, keywords: Sequence[str] | None = None,
    offsets: bool = False, lines: tuple[str, str] | None = None,
) -> DataFrame:
    """``columns, [keyword,] match_no, left_context, match, right_context[, start]``: a row per match, in the order of ``spans``.

    ``lines`` names two lists, of the lines of a text and of where they start: the line of a match comes along as ``__source``.
    """
    placed = df.select(*columns, *(lines or ()), F.col(text).alias("__text"))
    fields = [T.StructField(f.name, f.dataType, True) for f in placed.schema.fields[: len(columns)]]
    if keywords is not None:
        fields.append(T.StructField("keyword", T.StringType()))
    fields += [T.StructField("match_no", T.LongType())]
    fields += [T.StructField(name, T.StringType()) for name in ("left_context", "match", "right_context")]
    if offsets:
        fields.append(T.StructField("start", T.LongType()))
    if lines is not None:
        fields.append(T.StructField("__source", df.schema[lines[0]].dataType.elementType))
    names = [f.name for f in fields]
    work = partial(
        _found, spans=spans, keywords=keywords, width=width, names=names, offsets=offsets, lines=lines is not None
    )
    return placed.mapInArrow(work, T.StructType(fields))


def searched(pattern: re.Pattern[str]) -> Spans:
    return partial(regex_spans, pattern)


def searched_all(patterns: Sequence[re.Pattern[str]]) -> Spans:
    return partial(patterns_spans, tuple(patterns))
