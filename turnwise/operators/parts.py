"""Words beside their vectors without a vector per word in any shuffle.

Conversations (or their blocks) are dealt into parts of a bounded number of words. A part is sent the vectors of its different
words once, and what is asked of its words, sums or products, is computed there: what moves is the words, and
a vector per part and different word, however often words repeat inside a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.cells import _changes, _run, lists, matrix

# Words of a part, about.
PART_WORDS = 1 << 18
# Numbers of results at a time, and rows of a batch.
NUMBERS = 1 << 20

#: What is done with a part: its words, vectors of words and keys (or none).
PartFunction = Callable[["Part"], Iterator[pa.Table]]


class Vectors:
    """The vectors of a part; a word may have several."""

    def __init__(self, rows: pa.Table, dims: int, unit: bool) -> None:
        held = rows["vector"].combine_chunks()
        flat = pc.list_flatten(held)
        self.ok = None if not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims)
        self.values = matrix(pa.chunked_array([held]) if self.ok is None else _without_nulls(held), dims)
        terms = rows["term"].combine_chunks()
        if unit:
            norm = np.sqrt((self.values * self.values).sum(axis=1))
            good = ~(norm <= 0)
            if self.ok is not None:
                good &= self.ok.all(axis=1)
                self.ok = None
            self.values = self.values[good] / norm[good, None]
            terms = terms.filter(pa.array(good))
        self.terms = pc.unique(terms)
        code = pc.index_in(terms, value_set=self.terms).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.values = self.values[order]
        self.ok = None if self.ok is None else self.ok[order]
        self.start = np.searchsorted(code[order], np.arange(len(self.terms) + 1))

    def codes(self, terms: pa.ChunkedArray) -> np.ndarray:
        """Number of each term, -1 without a vector."""
        found = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1)
        return found.to_numpy().astype(np.int64)

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have vectors and where these stand: a row may come with several."""
        known = np.flatnonzero(codes >= 0)
        first = self.start[codes[known]]
        n = self.start[codes[known] + 1] - first
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
        return np.repeat(known, n), at


def _without_nulls(held: pa.ListArray) -> pa.ChunkedArray:
    filled = pc.fill_null(held.flatten(), 0)
    return pa.chunked_array([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(held))]), pa.int32()), filled)])


def runs(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Where rows with equal values in ``names`` begin, and the number of rows."""
    changed = np.zeros(max(len(rows) - 1, 0), dtype=bool)
    for name in names:
        changed |= _changes(rows[name].combine_chunks())
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [len(rows)]]) if len(rows) else np.zeros(1, dtype=np.int64)


class Part:
    """The words of a part in the order of ``place`` and turn, their vectors, and the keys of its conversations."""

    def __init__(self, cell: pa.Table, place: Sequence[str], dims: int, unit: bool) -> None:
        kind = cell["kind"].to_numpy()
        first, second = np.searchsorted(kind, [1, 2])
        self.place, self.dims = list(place), dims
        self.vectors = Vectors(cell.slice(0, first), dims, unit)
        self.keys = cell.slice(first, second - first)
        self.words = cell.slice(second)
        self.codes = self.vectors.codes(self.words["term"])

    def turn_sums(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows ``first`` to ``last``: where each turn with a vector begins, sums of its vectors and how many were added."""
        starts = runs(self.words.slice(first, last - first), [*self.place, "turn"])[:-1]
        row, at = self.vectors.places(self.codes[first:last])
        turn = np.searchsorted(starts, row, side="right") - 1
        used, begin = np.unique(turn, return_index=True)
        sums = np.zeros((len(used), self.dims))
        counts = np.zeros((len(used), self.dims))
        step = max(1, NUMBERS // self.dims)
        for low in range(0, len(at), step):
            some = at[low : low + step]
            _, own = np.unique(turn[low : low + step], return_index=True)
            where = np.searchsorted(used, turn[low : low + step][own])
            sums[where] += np.add.reduceat(self.vectors.values[some], own, axis=0)
            if self.vectors.ok is None:
                counts[where] += np.diff(np.append(own, len(some)))[:, None]
            else:
                counts[where] += np.add.reduceat(self.vectors.ok[some].astype(np.float64), own, axis=0)
        return first + starts[used], sums, counts

    def groups(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """First and last row of every group of ``place``, and where its keys stand."""
        edges = runs(self.words, self.place)
        ends = runs(self.keys, self.place)
        name = lambda rows, at: tuple(rows[c][int(at)].as_py() for c in self.place)
        keyed = {name(self.keys, a): np.arange(a, b) for a, b in zip(ends, ends[1:])}
        for a, b in zip(edges, edges[1:]):
            yield a, b, keyed.get(name(self.words, a), np.zeros(0, dtype=np.int64)) if keyed else np.zeros(0, dtype=np.int64)


def _gathered(tables: Iterator[pa.Table], rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Small tables put together."""
    held: list[pa.Table] = []
    n = 0
    for table in tables:
        held.append(table)
        n += len(table)
        if n >= rows:
            yield pa.concat_tables(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _part(cell: pa.Table, *, place: Sequence[str], dims: int, unit: bool, work: PartFunction) -> Iterator[pa.Table]:
    part = Part(cell, place, dims, unit)
    if len(part.words):
        yield from _gathered(work(part))


def in_parts(
    words: DataFrame,
    word_vectors: DataFrame,
    dims: int,
    n_words: int,
    place: Sequence[str],
    work: PartFunction,
    schema: str,
    *,
    keys: DataFrame | None = None,
    unit: bool = True,
    spread: Column | None = None,
) -> DataFrame:
    """Apply ``work`` to parts of the words (``place, turn, term``) beside the vectors of their terms.

    ``keys`` (``place, rank, term``) come into the part of their place. ``spread`` deals out otherwise than by place.
    """
    place = list(place)
    spark = words.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // PART_WORDS + 1)
    part = F.pmod(F.xxhash64(*place), F.lit(n)) if spread is None else F.pmod(spread, F.lit(n))
    where = [part.cast("bigint").alias("part")]
    turn = F.col("turn") if "turn" in words.columns else F.lit(None).cast("bigint").alias("turn")
    kinds = {f.name: f.dataType for f in words.schema.fields}
    vector = word_vectors.schema["vector"].dataType
    none = F.lit(None)
    no_vector, no_rank = none.cast(vector).alias("vector"), none.cast("int").alias("rank")
    asked = words.select(*where, F.lit(2).alias("kind"), *place, turn, no_rank, "term", no_vector)
    needed = words.select(*where, "term")
    if keys is not None:
        own = keys.select(*where, F.lit(1).alias("kind"), *place, none.cast(asked.schema["turn"].dataType).alias("turn"), F.col("rank").cast("int").alias("rank"), "term", no_vector)
        asked, needed = asked.unionByName(own), needed.unionByName(keys.select(*where, "term"))
    # A term comes once per part at most: it is no hot key, however common.
    known = needed.distinct().join(word_vectors.select("term", "vector").where("vector IS NOT NULL").hint("merge"), "term")
    sent = known.select(
        "part", F.lit(0).alias("kind"), *[none.cast(kinds[c]).alias(c) for c in place],
        none.cast(asked.schema["turn"].dataType).alias("turn"), no_rank, "term", "vector",
    )
    both = sent.unionByName(asked)
    placed = both.repartition(n, "part").sortWithinPartitions("part", "kind", *place, "turn", "rank")
    function = partial(_part, place=place, dims=dims, unit=unit, work=work)
    return placed.mapInArrow(partial(_run, keys=("part",), function=function), schema)


# ---------------------------------------------------------------- what is asked of a part


def sums(part: Part, *, mean: bool) -> Iterator[pa.Table]:
    """``place, turn, vector``: sums of the vectors of a turn, or their means."""
    at, total, counts = part.turn_sums(0, len(part.words))
    step = max(1, NUMBERS // part.dims)
    for low in range(0, len(at), step):
        some, value, n = at[low : low + step], total[low : low + step], counts[low : low + step]
        if mean:
            empty = n == 0
            flat = pa.array((value / np.where(empty, 1.0, n)).ravel(), mask=empty.ravel() if empty.any() else None)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * part.dims, pa.int32()), flat)
        else:
            vector = lists(value)
        yield part.words.select([*part.place, "turn"]).take(pa.array(some)).append_column("vector", vector)


def key_units(part: Part, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that have a vector, and their vectors."""
    if not len(keys):
        return keys, np.zeros((0, part.dims))
    row, at = part.vectors.places(part.vectors.codes(part.keys["term"].take(pa.array(keys))))
    return keys[row], part.vectors.values[at]


def key_features(part: Part, *, n_terms: int) -> Iterator[pa.Table]:
    """``conv_id, turn, vector``: per key term, the summed similarity with the words of the turn."""
    ranks = part.keys["rank"].to_numpy() if len(part.keys) else np.zeros(0, dtype=np.int64)
    for first, last, keys in part.groups():
        known, units = key_units(part, keys)
        if not len(known):
            continue
        at, total, _ = part.turn_sums(first, last)
        if not len(at):
            continue
        by_rank = np.zeros((n_terms, part.dims))
        by_rank[ranks[known] - 1] = units
        yield part.words.select(["conv_id", "turn"]).take(pa.array(at)).append_column("vector", lists(total @ by_rank.T))


def key_cosines(part: Part) -> Iterator[pa.Table]:
    """``conv_id, key, term, similarity`` of the keys and words of a conversation."""
    for first, last, keys in part.groups():
        known, units = key_units(part, keys)
        row, at = part.vectors.places(part.codes[first:last])
        step = max(1, NUMBERS // max(1, len(known)))
        for low in range(0, len(at) if len(known) else 0, step):
            some = row[low : low + step]
            values = part.vectors.values[at[low : low + step]] @ units.T
            words = part.words.select(["conv_id", "term"]).take(pa.array(first + np.repeat(some, len(known))))
            names = part.keys["term"].take(pa.array(np.tile(known, len(some))))
            yield pa.table(
                [words["conv_id"], names, words["term"], pa.array(values.ravel())], names=["conv_id", "key", "term", "similarity"]
            )


def _vocabulary(part: Part, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The different terms with a vector, as numbers, and one vector of each."""
    codes = np.unique(part.codes[first:last])
    codes = codes[codes >= 0]
    return codes, part.vectors.values[part.vectors.start[codes]]


def all_features(part: Part) -> Iterator[pa.Table]:
    """``conv_id, turn, term, value``: the feature vectors with every term as a key term; zero cells are absent."""
    for first, last, _ in part.groups():
        at, total, _ = part.turn_sums(first, last)
        codes, units = _vocabulary(part, first, last)
        terms = part.vectors.terms.take(pa.array(codes))
        step = max(1, NUMBERS // max(1, len(codes)))
        for low in range(0, len(at), step):
            values = total[low : low + step] @ units.T
            a, b = np.nonzero(values)
            turns = part.words.select(["conv_id", "turn"]).take(pa.array(at[low + a]))
            yield turns.append_column("term", terms.take(pa.array(b))).append_column("value", pa.array(values[a, b]))


def root_of(gram: np.ndarray) -> np.ndarray:
    size, axes = np.linalg.eigh(gram)
    return (axes * np.sqrt(np.maximum(size, 0.0))) @ axes.T


def all_roots(part: Part) -> Iterator[pa.Table]:
    """``conv_id, turn, vector``: short vectors with the products of :func:`all_features`, see ``vectors.arrays_all``."""
    for first, last, _ in part.groups():
        at, total, _ = part.turn_sums(first, last)
        if len(at):
            _, units = _vocabulary(part, first, last)
            turned = total @ root_of(units.T @ units)
            yield part.words.select(["conv_id", "turn"]).take(pa.array(at)).append_column("vector", lists(turned))
