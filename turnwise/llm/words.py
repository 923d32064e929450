"""Hashes of the words of many texts at once, with numpy.

A word is a run of bytes other than space and ``\\x09`` to ``\\x0D``, or than a given set that holds these; A to Z
count as a to z. Bytes are hashed as a polynomial modulo 2**64 over running sums, so that no Python code runs
per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLAB = 1 << 20  # bytes hashed at a time: bounds the memory, whatever the length of a text
GROUP = 1 << 16  # bytes of short texts hashed at a time: the numbers made of them fit the cache of a core
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64

SPACES = b"\t\n\x0b\x0c\r "
#: White space, punctuation and other signs of ASCII: only letters, digits and what is beyond ASCII is left.
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values, one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(count: int, start: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, count + 1, dtype=U64) * U64(BASE) + U64(start))


def _powers(base: int) -> np.ndarray:
    out = np.full(SLAB, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Tables:
    """Tables of a worker, made at first use."""

    ready = False

    @classmethod
    def make(cls) -> None:
        if not cls.ready:
            cls.byte = seeds(256, 7)
            cls.power = _powers(BASE)
            cls.inverse = _powers(pow(BASE, -1, 1 << 64))
            cls.ready = True


def _inside(buffer: np.ndarray, between: bytes) -> np.ndarray:
    outside = np.zeros(256, dtype=bool)
    outside[np.frombuffer(between, dtype=np.uint8)] = True
    return np.take(~outside, buffer)


def _slab_hashes(data: bytes, between: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the place of every word."""
    buffer = np.frombuffer(data, dtype=np.uint8)
    inside = _inside(buffer, between)
    if not len(buffer):
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate((np.zeros(int(inside[0]), dtype=np.int64), edges, np.full(int(inside[-1]), len(buffer))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=U64), starts
    total = np.zeros(len(buffer) + 1, dtype=U64)
    terms = np.take(Tables.byte, buffer, mode="clip")  # a byte is never out of range
    terms *= Tables.power[: len(buffer)]
    np.cumsum(terms, out=total[1:])
    value = (total[ends] - total[starts]) * Tables.inverse[starts]
    return mix(value + (ends - starts).astype(U64)), starts


def _slabs(data: bytes, between: bytes) -> Iterator[bytes]:
    """``data`` in pieces of at most ``SLAB`` bytes, cut between words. A longer word is given as it is."""
    start = 0
    while len(data) - start > SLAB:
        cut = max(data.rfind(c, start, start + SLAB) for c in between)
        if cut <= start:
            cut = min((p for c in between if (p := data.find(c, start + 1)) > 0), default=len(data))
        yield data[start:cut]
        start = cut
    yield data[start:]


def _long_word(data: bytes) -> np.ndarray:
    """The hash of one word longer than a slab: a fold over its pieces."""
    value = np.array([len(data)], dtype=U64)
    for start in range(0, len(data), SLAB):
        piece = data[start : start + SLAB]
        part = np.frombuffer(piece, dtype=np.uint8)
        total = (Tables.byte[part] * Tables.power[: len(part)]).sum(dtype=U64, keepdims=True)
        value = mix(value * U64(31) + total)
    return value


def lowered(text: str | None) -> bytes:
    """The bytes of a text, A to Z as a to z. A null text is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def text_words(text: str | None, between: bytes = SPACES) -> np.ndarray:
    """The hash of every word of one text, in order."""
    Tables.make()
    found = []
    for piece in _slabs(lowered(text), between):
        word = piece.strip(between)
        found.append(_long_word(word) if len(word) > SLAB else _slab_hashes(word, between)[0])
    return np.concatenate(found)


def batch_words(texts: Sequence[str | None], between: bytes = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, one after the other, and where each text starts and ends."""
    Tables.make()
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    group: list[bytes] = []
    first = size = 0

    def flush(stop: int) -> None:
        nonlocal group, size
        if group:
            value, starts = _slab_hashes(b"\n".join(group), between)
            hashes.append(value)
            edges = np.cumsum([0] + [len(x) + 1 for x in group])
            counts[first:stop] = np.diff(np.searchsorted(starts, edges))
        group, size = [], 0

    for i, text in enumerate(texts):
        data = lowered(text)
        if len(data) + 1 > SLAB:
            flush(i)
            long = text_words(text, between)
            hashes.append(long)
            counts[i] = len(long)
            first = i + 1
            continue
        if size + len(data) + 1 > min(GROUP, SLAB):
            flush(i)
            first = i
        group.append(data)
        size += len(data) + 1
    flush(len(texts))
    edges = np.concatenate(([0], np.cumsum(counts)))
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64)), edges


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``limit`` bytes of text, to bound the memory of a task."""
    try:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
                yield batch.slice(start, stop - start)
                start = stop
    finally:
        release()


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and waits beside the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
