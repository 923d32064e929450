"""Conversations that a task may hold: pairs of terms, of turns by all terms, and concept vectors, counted in one place.

What is quadratic in the terms of a conversation, and every window of a term, is never shuffled: a conversation's sentences are
sent to one task, one conversation after the other, and only results leave it. Larger conversations go by stretches and blocks (``concepts``, ``products``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.cells import _changes, _run, lists

# Words of the sentences of a conversation that is near, and of those whose terms are squared at once.
PAIR_WORDS = 1 << 16
SQUARE_WORDS = 1 << 11
# Words of a window of a near conversation.
WINDOW_WORDS = 1 << 12
# Windows times terms, and pairs, at a time.
NUMBERS = 1 << 22


def split(base: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of conversations of one block and at most ``most`` words, and those of the others (or none)."""
    block = F.coalesce(F.max("block"), F.lit(0)) if "block" in base.columns else F.lit(0)
    words = F.expr("aggregate(sentences, 0L, (a, s) -> a + size(s))")
    widest = F.expr("aggregate(sentences, 0, (a, s) -> greatest(a, size(s))) * cast(width AS bigint)")
    far = (F.sum(words) > most) | (F.max(widest) > WINDOW_WORDS) | (block > 0)
    facts = base.groupBy("conv_id").agg(far.alias("far"))
    if not facts.agg(F.bool_or("far")).first()[0]:
        return base, None
    ids = facts.where("far").select("conv_id")
    return base.join(ids, "conv_id", "left_anti"), base.join(ids, "conv_id", "left_semi")


class Talk:
    """The terms of a conversation and the windows they are in; rows come by turn."""

    def __init__(self, cell: pa.Table) -> None:
        width = cell["width"][0].as_py()
        held = cell["sentences"].combine_chunks()
        n = pc.fill_null(pc.list_value_length(held), 0).to_numpy()
        lists = held.flatten()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        words = lists.flatten()
        known = pc.unique(words)
        self.terms = known.take(pc.sort_indices(known))
        code = pc.index_in(words, value_set=self.terms).to_numpy().astype(np.int64)
        changed = np.concatenate([[False], _changes(cell["turn"].combine_chunks())])
        self.turn = np.cumsum(changed)  # number of the turn of each row
        self.first_row = np.concatenate([[0], np.flatnonzero(changed)])
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        end = np.maximum(n - width, 0)
        self.n_windows = int((end + 1).sum())
        # Rows of one turn share their windows.
        longest = np.zeros(self.turn[-1] + 1, dtype=np.int64)
        np.maximum.at(longest, self.turn, end + 1)
        start = (np.cumsum(longest) - longest)[self.turn[row]]
        first, last = np.maximum(at - width + 1, 0), np.minimum(at, end[row])
        reach = np.repeat(last - first + 1, sizes)
        window = np.repeat(np.repeat(start + first, sizes), reach) + (np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach))
        t = max(len(self.terms), 1)
        met = np.unique(window * t + np.repeat(code, reach))
        self.window, self.term = met // t, met % t
        self.occurrence = np.bincount(self.term, minlength=len(self.terms))
        # Terms of every row, once each.
        held_by = np.unique(np.repeat(row, sizes) * t + code)
        self.row_of, self.term_of = held_by // t, held_by % t

    def square(self) -> np.ndarray:
        """Windows with both terms, for all pairs of terms."""
        t = len(self.terms)
        total = np.zeros((t, t))
        step = max(1, NUMBERS // max(t, 1))
        n = int(self.window[-1]) + 1 if len(self.window) else 0
        for low in range(0, n, step):
            a, b = np.searchsorted(self.window, [low, low + step])
            held = np.zeros((min(step, n - low), t), dtype=np.float32)
            held[self.window[a:b] - low, self.term[a:b]] = 1
            total += held.T @ held
        return total

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms ``i < j`` that share a window, and how many they share."""
        t = len(self.terms)
        if t * t <= NUMBERS:
            both = np.triu(self.square(), 1)
            i, j = np.nonzero(both)
            return i, j, both[i, j].astype(np.int64)
        codes, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(self.window)) + 1, [len(self.window)]])
        held: list[np.ndarray] = []
        n = 0
        for at, (a, b) in enumerate(zip(edges, edges[1:]), 2):
            i, j = np.triu_indices(b - a, 1)
            held.append(self.term[a:b][i] * t + self.term[a:b][j])
            n += len(i)
            if n >= max(NUMBERS, len(codes)) or at == len(edges):
                new, number = np.unique(np.concatenate(held), return_counts=True)
                codes, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([counts, number]), minlength=len(codes)).astype(np.int64)
                held, n = [], 0
        return codes // t, codes % t, counts


def _term_pairs(cell: pa.Table) -> Iterator[pa.Table]:
    talk = Talk(cell)
    i, j, n = talk.pairs()
    conv = cell["conv_id"].combine_chunks().slice(0, 1)
    step = NUMBERS // 4
    for low in range(0, len(i), step):
        a, b = i[low : low + step], j[low : low + step]
        yield pa.table(
            [
                conv.take(pa.array(np.zeros(len(a), dtype=np.int64))), talk.terms.take(pa.array(a)), talk.terms.take(pa.array(b)),
                pa.array(n[low : low + step]), pa.array(talk.occurrence[a]), pa.array(talk.occurrence[b]),
                pa.array(np.full(len(a), talk.n_windows)),
            ],
            names=["conv_id", "term_i", "term_j", "n", "o_i", "o_j", "n_windows"],
        )


def similarity(talk: Talk) -> np.ndarray:
    """``concepts.similarity_score`` of all pairs of terms; 0 for those that never meet, and for a term with itself."""
    n, o, total = talk.square(), talk.occurrence.astype(np.float64), float(talk.n_windows)
    np.fill_diagonal(n, 0.0)

    def counted(count: np.ndarray) -> np.ndarray:
        return np.where(count == 0, total, count)

    score = n * counted(total - (o[:, None] + o[None, :] - n))
    score /= counted(o[None, :] - n) * counted(o[:, None] - n)
    return score


def _turn_pairs(cell: pa.Table, n: int) -> Iterator[pa.Table]:
    """Pairs of turns by all terms: ``value``, and the ``n`` terms of the largest positive products."""
    talk = Talk(cell)
    if not len(talk.terms):
        return
    held = np.zeros((int(talk.turn[-1]) + 1, len(talk.terms)))
    np.add.at(held, (talk.turn[talk.row_of], talk.term_of), 1.0)
    units = held @ similarity(talk)
    norm = np.sqrt((units * units).sum(axis=1))
    turns = cell["turn"].combine_chunks().take(pa.array(talk.first_row))
    known = np.flatnonzero((norm > 0) & turns.is_valid().to_numpy(zero_copy_only=False))
    units = units[known] / norm[known, None]
    values = units @ units.T
    rows, columns, tops = [], [], []
    for a in range(len(known)):
        for b in range(a + 1, len(known)):
            product = units[a] * units[b]
            shared = np.flatnonzero(product > 0)
            if len(shared):
                rows.append(a)
                columns.append(b)
                if n:
                    tops.append(shared[np.lexsort((shared, -np.round(product[shared], 9)))[:n]])
    if not rows:
        return
    sizes = [len(x) for x in tops] if n else [0] * len(rows)
    flat = np.concatenate(tops) if n else np.zeros(0, dtype=np.int64)
    top = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), talk.terms.take(pa.array(flat)))
    conv = cell["conv_id"].combine_chunks().slice(0, 1).cast(pa.int64()).take(pa.array(np.zeros(len(rows), dtype=np.int64)))
    where = [turns.cast(pa.int64()).take(pa.array(known[x])) for x in (rows, columns)]
    yield pa.table([conv, *where, pa.array(values[rows, columns]), top], names=["conv_id", "row_turn", "col_turn", "value", "top"])


def _key_terms(talk: Talk, key_terms: int | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The key terms as numbers of terms, and their ranks from 1, as of ``concepts.ranked_key_terms``."""
    if not isinstance(key_terms, int):
        code = pc.index_in(pa.array(list(dict.fromkeys(key_terms)), talk.terms.type), value_set=talk.terms)
        known = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        return code.drop_null().to_numpy().astype(np.int64), known + 1
    t = len(talk.terms)
    held = np.unique(talk.turn[talk.row_of] * t + talk.term_of)
    n_turns = np.bincount(held % t, minlength=t)
    found = np.argsort(-n_turns, kind="stable")[:key_terms]
    return found, np.arange(1, len(found) + 1)


def _key_weights(talk: Talk, keys: np.ndarray) -> np.ndarray:
    """``concepts.similarity_score`` of every term with some terms; 0 where they never meet, and for a term with itself."""
    column = np.full(len(talk.terms), -1)
    column[keys] = np.arange(len(keys))
    at = column[talk.term]
    held = np.zeros((int(talk.window[-1]) + 1, len(keys)), dtype=np.int32)
    held[talk.window[at >= 0], at[at >= 0]] = 1
    order = np.argsort(talk.term, kind="stable")
    starts = np.cumsum(talk.occurrence) - talk.occurrence
    n = np.add.reduceat(held[talk.window[order]], starts, axis=0).astype(np.float64)
    n[keys, np.arange(len(keys))] = 0
    o_term, o_key, total = talk.occurrence[:, None].astype(np.float64), talk.occurrence[keys].astype(np.float64), float(talk.n_windows)

    def counted(count: np.ndarray) -> np.ndarray:
        return np.where(count == 0, total, count)

    score = n * counted(total - (o_key + o_term - n)) / (counted(o_term - n) * counted(o_key - n))
    return np.where(n == 0, 0.0, score)


def _key_concepts(cell: pa.Table, key_terms: int | Sequence[str], dims: int) -> Iterator[pa.Table]:
    talk = Talk(cell)
    if not len(talk.terms):
        return
    keys, ranks = _key_terms(talk, key_terms)
    if not len(keys):
        return
    turn = talk.turn[talk.row_of]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(turn)) + 1])
    vectors = np.zeros((len(starts), dims))
    step = max(1, NUMBERS // len(talk.window))
    for low in range(0, len(keys), step):
        weights = _key_weights(talk, keys[low : low + step])
        vectors[:, ranks[low : low + step] - 1] = np.add.reduceat(weights[talk.term_of], starts, axis=0)
    first = np.arange(len(starts)) == 0
    named = pa.StructArray.from_arrays(
        [pa.array(ranks, pa.int32()), talk.terms.take(pa.array(keys)).cast(pa.string()), pa.array(talk.occurrence[keys], pa.int64())],
        names=["rank", "term", "occurrence"],
    )
    ends = pa.array(np.concatenate([[0], np.full(len(first), len(keys))]), pa.int32())
    yield pa.table(
        [
            cell["conv_id"].combine_chunks().take(pa.array(np.zeros(len(first), dtype=np.int64))),
            cell["turn"].combine_chunks().take(pa.array(talk.first_row[turn[starts]])),
            lists(vectors),
            pa.ListArray.from_arrays(ends, named, mask=pa.array(~first)),
            pa.array(np.full(len(first), talk.n_windows), pa.int64(), mask=~first),
        ],
        names=["conv_id", "turn", "vector", "key_terms", "n_windows"],
    )


def _by_conversation(base: DataFrame, work, schema: str) -> DataFrame:
    rows = base.select("conv_id", "turn", "sentences", F.col("width").cast("int").alias("width"))
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return placed.mapInArrow(partial(_batched, work=work), schema)


def _batched(batches, work) -> Iterator[pa.RecordBatch]:
    """Results of small conversations put together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for out in _run(batches, ("conv_id",), work):
        held.append(out)
        n += out.num_rows
        if n >= 1 << 14:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def term_pairs(base: DataFrame) -> DataFrame:
    """``conv_id, term_i, term_j, n, o_i, o_j, n_windows`` for every pair that occurs together, ``term_i < term_j``."""
    kind = base.schema["conv_id"].dataType.simpleString()
    return _by_conversation(
        base, _term_pairs,
        f"conv_id {kind}, term_i string, term_j string, n bigint, o_i bigint, o_j bigint, n_windows bigint",
    )


def turn_pairs(base: DataFrame, n: int = 0) -> DataFrame:
    """``conv_id, row_turn, col_turn, value, top`` as of ``products.sparse_products`` over the vectors of all terms."""
    return _by_conversation(
        base.where("conv_id IS NOT NULL"), partial(_turn_pairs, n=n),
        "conv_id bigint, row_turn bigint, col_turn bigint, value double, top array<string>",
    )


def key_concepts(base: DataFrame, key_terms: int | Sequence[str], dims: int) -> DataFrame:
    """``conv_id, turn, vector, key_terms, n_windows``: the rows of ``concepts.concept_arrays``, one per turn with terms.

    The first row of each conversation also carries its row of ``concepts.key_term_lists``; in the others that is null. A null
    turn, which has no concept vector, may have a row for that.
    """
    if key_terms == "all":
        raise ValueError("all terms have no ranking")
    conv, turn = (base.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    return _by_conversation(
        base.where("conv_id IS NOT NULL"), partial(_key_concepts, key_terms=key_terms, dims=dims),
        f"conv_id {conv}, turn {turn}, vector array<double>, key_terms array<struct<rank: int, term: string, occurrence: bigint>>, n_windows bigint",
    )
