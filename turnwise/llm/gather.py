"""Texts put together from the codes of their distinct parts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Codes(NamedTuple):
    """Runs of numbers, each somewhere in ``flat``."""

    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def distinct(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct values of a list column, the number of each value in order, and where each row starts."""
    values = lists.flatten()
    edges = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, dtype=np.int32)
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), edges.astype(np.int64)


def listed(values: pa.Array) -> list:
    """The values as Python objects; for strings and bytes much faster than ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


def distinct_parts(lists: pa.ListArray) -> tuple[list, np.ndarray, np.ndarray]:
    """:func:`distinct` with the values as a list."""
    values, parts, edges = distinct(lists)
    return listed(values), parts, edges


def coded(codes: Sequence[bytes], kind: np.dtype) -> Codes:
    flat = np.frombuffer(b"".join(codes), dtype=kind)
    lengths = np.fromiter(map(len, codes), dtype=np.int32, count=len(codes)) // kind.itemsize
    return Codes(flat, np.cumsum(lengths, dtype=np.int32) - lengths, lengths)


def joined(codes: Codes, parts: np.ndarray, edges: np.ndarray) -> Codes:
    """Run i is the codes of ``parts[edges[i]:edges[i + 1]]``, one after the other; they follow each other in ``flat``."""
    each = codes.lengths[parts]
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum(each, out=ends[1:])
    places = np.repeat(codes.starts[parts] - ends[:-1], each)
    places += np.arange(len(places), dtype=np.int32)
    bounds = ends[edges]
    return Codes(codes.flat[places], bounds[:-1], np.diff(bounds))


def binary(codes: Codes) -> pa.BinaryArray:
    """The runs as bytes, if they follow each other in ``flat``; less than 2 GB in all."""
    offsets = np.append(codes.starts, len(codes.flat)).astype(np.int32) * np.int32(codes.flat.itemsize)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(codes.lengths), [None, pa.py_buffer(offsets), pa.py_buffer(codes.flat)]
    )


def gathered(codes: Sequence[bytes], parts: np.ndarray, edges: np.ndarray, kind: np.dtype) -> pa.BinaryArray:
    """Rows of bytes: row i is the codes of ``parts[edges[i]:edges[i + 1]]``, one after the other; less than 2 GB in all."""
    return binary(joined(coded(codes, kind), parts, edges))


def shorten(known: dict, most: int) -> None:
    """Halve a table of codes that has more than ``most`` entries. The older half stays: frequent parts come early."""
    if len(known) > most:
        for key in list(islice(known, most // 2, None)):
            del known[key]


def filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return pc.fill_null(texts, "")
