"""Language-model scores from a probabilistic suffix tree over words.

The tree holds contexts, the last words before a token, of variable length. A context enters if a divergence test
says so: the gain in log-likelihood of its next-symbol distribution over that of its parent, the context without the
oldest word, must pay for the symbols it stores. Symbols are stored if they follow the context ``LEAST`` times,
whatever the size of the corpus. The distribution is smoothed with that of the parent, down to the smoothed word
frequencies at the root:

    P(w | s) = c(s w) / (c(s) + PRIOR) + rest(s) * P(w | parent(s))

A token is scored in the longest suffix of its history that is in the tree.

The model grows with the corpus and is a set of written tables, a row for every sequence of words (gram) that occurs
``LEAST`` times. A gram is counted if its two shorter grams are frequent, which a bitmap of bounded size may err
about on one side only; counts are made per task and travel packed by ranges of keys (``blobs``), each range summed for
itself. The tests are groupings of these tables.

The logarithm of a score is a sum over the grams of a text. A gram ``s w`` has the value

    log P(w | s) - log P(w | parent(s)) - log rest(s) + log rest(s w)

where ``rest`` is 1 outside the tree: what was added for the shorter gram and for ``s`` as a context is taken back. So
the grams of a text are looked up one by one: words of a share of ``WORD_SHARE`` or more and the ``USUAL`` most frequent
longer grams in a broadcast table, all others packed by range, next to the values of that range. A longer gram goes there if
bitmaps say that it may have a value and that its two shorter grams may be frequent. What is found goes back packed by texts, so
the rows on both ways depend on the grams and not on how many slices of text meet how many ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.blobs import ROWS, cuts, dealt, handed, lengths, packed, range_of, runs, unpacked
from turnwise.llm.words import U64, batch_words, mix, pieces, seeds
from turnwise.llm.written import passing, tidy
from turnwise.session import delete_scratch

FOLDS = 10  # rows of fold 0 are held out
DEPTH = 3
WORD_SHARE = 1e-6
USUAL = 1 << 21  # grams of two and more words that are broadcast, at most
LEAST = 4  # occurrences of anything the tree stores
PRIOR = 5.0  # occurrences that the parent counts for
ADD = 0.1
SLICE = 2 << 20
HELD = 3 << 19  # keys a task counts before it hands them on
PASSED = 1 << 17  # of them at a time
PLACE = np.uint16  # of a text in a slice
WORD_BITS = 10  # of the number of a range of words that are counted
RANGE = 1 << 19  # training tokens for which there is one more range of grams
BITS = 27  # of a place in the largest bitmap
SHARE = 0.5  # of grams that are looked up at a time in the training tokens, about
ROUNDS = 8  # at most

_STEP = seeds(1, 303)[0]
END = seeds(1, 404)[0]  # the symbol after the last word


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts with an end after each text, and where each begins."""
    hashes, edges = batch_words(texts)
    return np.insert(hashes, edges[1:], END), edges + np.arange(len(edges))


def joint(context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The key of a gram, from that of all but its last symbol and that of all but its first."""
    return mix(context * _STEP + lower)


def grams(symbols: np.ndarray, edges: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length up to ``longest`` the key of the gram that ends with every symbol; 0 where the text is too short."""
    place = np.arange(len(symbols)) - np.repeat(edges[:-1], np.diff(edges))
    out = [symbols]
    for length in range(2, longest + 1):
        key = np.zeros(len(symbols), dtype=U64)
        key[1:] = joint(out[-1][:-1], out[-1][1:])
        out.append(np.where(place >= length - 1, key, U64(0)))
    return out


def histories(symbols: np.ndarray, edges: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each length up to ``depth`` the key of the context before every symbol; 0 where the text is too short."""
    out = []
    for key in grams(symbols, edges, depth):
        before = np.zeros(len(symbols), dtype=U64)
        before[1:] = key[:-1]
        before[edges[:-1]] = 0
        out.append(before)
    return out


def held_out(doc_id, folds: int = FOLDS):
    """Whether a row is kept from training: the remainder of the CRC-32 of its id as text is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


class Table:
    """A sorted map from keys to places."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


class Bitmap:
    """Tells which keys are surely not in a table."""

    def __init__(self, keys: DataFrame):
        """``keys`` has one column, ``gram``."""
        self.rows = keys.count()
        self.bits = min(BITS, max(10, (16 * self.rows).bit_length()))
        placed = keys.select(F.shiftrightunsigned("gram", 64 - self.bits).alias("place"))
        bit = placed.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        found = _columns(bit.groupBy("word").agg(F.bit_or("bit").alias("bit")))
        self.words = np.zeros(1 << (self.bits - 6), dtype=U64)
        self.words[found["word"].astype(np.int64)] = found["bit"]

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the table."""
        place = keys >> U64(64 - self.bits)
        return (self.words[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) > 0


def _words(texts: DataFrame) -> DataFrame:
    """``symbol``, ``times`` of all words of the training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def rows() -> Iterator[pa.RecordBatch]:
            if not held.parts:
                return
            symbols, times = held.merged()
            place = range_of(symbols, WORD_BITS)
            edges = cuts(place)
            yield from handed(["range", "symbol", "times"], [pa.array(place[edges[:-1]]), packed(symbols, edges), packed(times, edges)])

        for batch in pieces(batches, limit=SLICE):
            symbols, _ = sequences(batch.column(0).to_pylist())
            held.add(symbols)
            if held.full():
                yield from rows()
        yield from rows()

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Held(), None

        def rows() -> Iterator[pa.RecordBatch]:
            if held.parts:
                symbols, times = held.merged()
                yield from handed(["symbol", "times"], [pa.array(symbols.view(np.int64)), pa.array(times)], PASSED)

        for place, found in runs(batches, "range"):
            if place != now:
                yield from rows()
                now = place
            n = found.num_rows
            held.add(unpacked(found.column("symbol"), 0, n, U64), times=unpacked(found.column("times"), 0, n, np.int64))
            if held.size > HELD:
                held.full()
        yield from rows()

    counted = texts.mapInArrow(run, "range long, symbol binary, times binary")
    return dealt(counted, "range").mapInArrow(summed, "symbol long, times long")


class Held:
    """Keys that a task has seen, each with numbers that the key decides, and how often."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray, times: np.ndarray | None = None) -> None:
        self.parts.append((*columns, np.ones(len(columns[0]), dtype=np.int64) if times is None else times))
        self.size += len(columns[0])

    def full(self) -> bool:
        """Whether it is time to hand them on; repeats are put together before."""
        if self.size > HELD:
            self.parts = [self._united()]
            self.size = len(self.parts[0][0])
        return self.size > HELD // 2 and len(self.parts) == 1

    def _united(self) -> tuple[np.ndarray, ...]:
        *columns, times = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(columns[0])
        key = columns[0][order]
        fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        times = np.add.reduceat(times[order], fresh) if len(fresh) else times
        return (key[fresh], *(c[order[fresh]] for c in columns[1:]), times)

    def merged(self) -> tuple[np.ndarray, ...]:
        """All of them, in order; none are left. Nothing held gives a key and its times without rows."""
        out = self._united() if self.parts else (np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))
        self.parts, self.size = [], 0
        return out


_COUNTED = "range long, context binary, lower binary, times binary"


def _frequent(texts: DataFrame, shared, length: int, bits: int) -> DataFrame:
    """``gram``, ``context``, ``lower``, ``times`` of the grams of a length that occur ``LEAST`` times in the training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def rows() -> Iterator[pa.RecordBatch]:
            if not held.parts:
                return
            key, context, lower, times = held.merged()
            place = range_of(key, bits)
            edges = cuts(place)
            first = pa.array(place[edges[:-1]])
            yield from handed(["range", "context", "lower", "times"], [first, *(packed(x, edges) for x in (context, lower, times))])

        for batch in pieces(batches, limit=SLICE):
            symbols, edges = sequences(batch.column(0).to_pylist())
            keys = grams(symbols, edges, length)
            some = np.flatnonzero(keys[-1])
            likely = shared.value.maybe(keys[-2])
            some = some[likely[some] & likely[some - 1]]
            held.add(keys[-1][some], keys[-2][some - 1], keys[-2][some])
            if held.full():
                yield from rows()
        yield from rows()

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Held(), None

        def rows() -> Iterator[pa.RecordBatch]:
            if held.parts:
                key, context, lower, times = held.merged()
                often = np.flatnonzero(times >= LEAST)
                arrays = [pa.array(x[often].view(np.int64)) for x in (key, context, lower, times)]
                yield from handed(["gram", "context", "lower", "times"], arrays, PASSED)

        for place, found in runs(batches, "range"):
            if place != now:
                yield from rows()
                now = place
            n = found.num_rows
            context, lower = (unpacked(found.column(c), 0, n, U64) for c in ("context", "lower"))
            held.add(joint(context, lower), context, lower, times=unpacked(found.column("times"), 0, n, np.int64))
            if held.size > HELD:
                held.full()
        yield from rows()

    return dealt(texts.mapInArrow(run, _COUNTED), "range").mapInArrow(summed, "gram long, context long, lower long, times long")


class Tree:
    """Contexts by depth, with the log10 probabilities of their stored symbols and what is left for the parent."""

    def __init__(self, words: np.ndarray, word_logs: np.ndarray, rest: float):
        self.words, self.word_logs, self.unknown = Table(words), word_logs, rest
        self.depths: list[tuple[Table, np.ndarray, Table, np.ndarray]] = []

    def score(self, histories_at: list[np.ndarray], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol the log10 factor before its frequency at the root, and the whole log10 probability if it is
        stored in a context (else NaN)."""
        total = np.zeros(len(symbols))
        open_ = np.ones(len(symbols), dtype=bool)
        log = np.full(len(symbols), np.nan)
        keys = [symbols]
        for history in histories_at:
            keys.append(joint(history, keys[-1]))
        for d in range(len(self.depths) - 1, -1, -1):
            contexts, rests, stored, logs = self.depths[d]
            found = contexts.find(histories_at[d])
            inside = np.flatnonzero(open_ & (found >= 0))
            place = stored.find(keys[d + 1][inside])
            hit = place >= 0
            log[inside[hit]] = total[inside[hit]] + logs[place[hit]]
            open_[inside[hit]] = False
            total[inside[~hit]] += rests[found[inside[~hit]]]
        return total, log

    def root(self, symbols: np.ndarray) -> np.ndarray:
        """log10 of the smoothed frequencies of the words here, else NaN."""
        place = self.words.find(symbols)
        return np.where(place >= 0, self.word_logs[place] if len(self.word_logs) else np.nan, np.nan)


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    """A bounded table of longs and doubles on the driver."""
    table = df.toArrow()
    out = {n: table.column(n).to_numpy() for n in table.column_names}
    return {n: x.view(U64) if x.dtype == np.int64 and n != "times" else x for n, x in out.items()}


class Model(NamedTuple):
    """``words``: ``symbol``, ``times``; the number of training tokens and of distinct ones. For each length from 2,
    ``stored``: ``gram``, ``context``, ``times``, ``log``, ``own`` (log10 of the value without the last term), ``kept``; and
    ``contexts`` in the tree: ``context``, ``rest``, ``own``; and ``frequent``, the grams of
    each but the last of these lengths, that occur ``LEAST`` times."""

    words: DataFrame
    tokens: int
    distinct: int
    stored: list[DataFrame]
    contexts: list[DataFrame]
    folders: list[str]  # of all these tables
    frequent: list[Bitmap]

    @property
    def bits(self) -> int:
        """Of the number of a range of grams: a range has about ``RANGE`` grams of a length at most."""
        return max(4, (self.tokens // RANGE).bit_length())

    @property
    def base(self) -> float:
        return self.tokens + ADD * (self.distinct + 1)

    @property
    def often(self) -> float:
        """The occurrences from which a word is broadcast."""
        return max(1.0, WORD_SHARE * self.tokens)


def learn(docs: DataFrame) -> Model:
    """Count the rows that are not held out, and test all contexts of up to ``DEPTH`` words."""
    with tidy(docs.sparkSession):
        return _learned(docs)


def _learned(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    texts = docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text"))
    words, kept_words = passing(_words(texts), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    model = Model(words, tokens, distinct, [], [], [kept_words], [])
    last = words.where(F.col("times") >= LEAST).select(
        F.col("symbol").alias("gram"), "times", F.log10((F.col("times") + ADD) / model.base).alias("log")
    )
    cost = 0.5 * float(np.log10(max(tokens, 10)))
    for length in range(2, DEPTH + 2):
        known = Bitmap(last.select("gram"))
        if not known.rows:
            break
        shared = spark.sparkContext.broadcast(known)
        found, counted = passing(_frequent(texts, shared, length, model.bits), "grams")
        above = last.select(F.col("gram").alias("context"), F.col("times").alias("size"))
        below = last.select(F.col("gram").alias("lower"), F.col("log").alias("parent"))
        joined, folder = passing(found.join(above, "context").join(below, "lower").drop("lower"), "joined")
        delete_scratch(spark, counted)
        tested = joined.groupBy("context").agg(
            F.first("size").alias("size"),
            F.sum("times").alias("held"),
            F.sum(F.col("times") * (F.log10(F.col("times") / F.col("size")) - F.col("parent"))).alias("gain"),
            F.count("*").alias("symbols"),
        )
        kept = tested.where(F.col("gain") >= cost * F.col("symbols"))
        rest = F.log10(1 - F.col("held") / (F.col("size") + PRIOR))
        contexts, kept_contexts = passing(kept.select("context", "size", rest.alias("rest")), "contexts")
        smooth = F.log10(F.col("times") / (F.col("size") + PRIOR) + F.pow(F.lit(10.0), F.col("rest") + F.col("parent")))
        stored = joined.join(contexts.drop("size"), "context", "left").withColumn("kept", F.col("rest").isNotNull())
        stored = stored.withColumn("log", F.when(F.col("kept"), smooth).otherwise(F.col("parent")))
        own = F.when(F.col("kept"), F.col("log") - F.col("parent") - F.col("rest")).otherwise(0.0)
        stored, place = passing(stored.select("gram", "context", "times", "log", own.alias("own"), "kept"), "stored")
        delete_scratch(spark, folder)
        shared.unpersist()
        model.folders.extend((place, kept_contexts))
        model.stored.append(stored)
        model.contexts.append(contexts)
        if length > 2:
            model.frequent.append(known)
        last = stored
    return model


def fit(docs: DataFrame) -> tuple[Tree, DataFrame, int, int]:
    """The usual part of the tree, the words with their counts (``symbol``, ``times``), the number of training tokens and of
    distinct ones. The tree is the whole one if no length has more than ``USUAL`` grams."""
    model = learn(docs)
    tree = Tree(*_usual_words(model), float(np.log10(ADD / model.base)))
    for stored, contexts in zip(model.stored, model.contexts):
        often = _usual_from(stored)
        heads = _columns(contexts.where(F.col("size") >= often).select("context", "rest"))
        logs = _columns(stored.where(F.col("kept") & (F.col("times") >= often)).select("gram", "log"))
        tree.depths.append((Table(heads["context"]), heads["rest"], Table(logs["gram"]), logs["log"]))
    return tree, model.words, model.tokens, model.distinct


def _usual_from(grams: DataFrame) -> int:
    """The least ``times`` of which there are at most ``USUAL`` rows or more frequent ones."""
    times = _columns(grams.groupBy("times").agg(F.count("*").alias("rows")).orderBy(F.desc("times")))
    fit = int((np.cumsum(times["rows"].astype(np.int64)) <= USUAL).sum())
    if fit:
        return int(times["times"][fit - 1])
    return int(times["times"].max(initial=0)) + 1


def _usual_words(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The words that are broadcast and the log10 of their frequencies."""
    usual = _columns(model.words.where(F.col("times") >= model.often))
    return usual["symbol"], np.log10((usual["times"] + ADD) / model.base)


def values(model: Model) -> tuple[DataFrame, str]:
    """``gram``, ``length``, ``times``, ``base`` (of words) and ``value`` of every gram that adds to a score, and their folder."""
    base = F.log10((F.col("times") + ADD) / model.base)
    words = model.words.select(F.col("symbol").alias("gram"), "times", base.alias("base"), base.alias("own"))
    longer = [s.select("gram", "times", F.lit(0.0).alias("base"), "own") for s in model.stored]
    parts = []
    for length, (part, contexts) in enumerate(zip([words, *longer], [*model.contexts, None]), 1):  # those one longer
        value = F.col("own")
        if contexts is not None:
            part = part.join(contexts.select(F.col("context").alias("gram"), "rest"), "gram", "left")
            value = value + F.coalesce("rest", F.lit(0.0))
        parts.append(part.select("gram", F.lit(length).alias("length"), "times", "base", value.alias("value")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part.where("value <> 0"))
    return passing(whole, "values")


class Usual(NamedTuple):
    """What is broadcast to score: for each length from 2 a bitmap of the grams with a value, for each but the last one of the
    frequent grams, and the usual grams. Nearly all words are known and frequent, so they have no bitmap."""

    known: list[Bitmap]
    frequent: list[Bitmap]
    words: np.ndarray  # in order, as grams are
    word_bases: np.ndarray
    word_values: np.ndarray
    grams: np.ndarray
    gram_values: np.ndarray


#: A row of a text, and a row of grams or of what was found of them: ``rows`` counts the texts from ``first`` on.
_TEXT = "row_id long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
_SENT = f"range long, first long, grams binary, rows binary, {_TEXT}"
_MET = f"first long, range long, rows binary, bases binary, values binary, {_TEXT}"
_TEXT_NAMES = [x.split()[0] for x in _TEXT.split(", ")]
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def _filled(columns: str, **arrays: pa.Array) -> pa.RecordBatch:
    """Rows of ``columns``, with nulls in those that are not given."""
    schema = pa.schema([(n, _KINDS[kind]) for n, kind in (x.split() for x in columns.split(", "))])
    n = len(next(iter(arrays.values())))
    return pa.RecordBatch.from_arrays([arrays.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def _few(rows: pa.RecordBatch, most: int = ROWS) -> Iterator[pa.RecordBatch]:
    return (rows.slice(start, most) for start in range(0, rows.num_rows, most))


def _places(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``np.searchsorted``, with keys in order: one and the next then meet in the same few lines of a large table."""
    order = np.argsort(keys)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.searchsorted(held, keys[order])
    return place


def _met(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is held, and where those are that are."""
    place = _places(held, keys)
    hit = place < len(held)
    hit[hit] = held[place[hit]] == keys[hit]
    return hit, place[hit]


def _scored(texts: DataFrame, shared, bits: int) -> DataFrame:
    """Rows of texts with the part of the score that the broadcast grams give, and rows of the other grams that may be known, by
    range (``_SENT``). A task puts the grams of many slices together. Texts stand in the range of their slice, before the
    grams there: their ``first`` is inverted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = shared.value
        first, texts_, size = 0, 0, 0
        rare: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            who, gram = (np.concatenate(x) for x in zip(*rare))
            rare.clear()
            order = np.argsort(gram)
            who, gram = who[order], gram[order]
            place = range_of(gram, bits)
            at = cuts(place)
            arrays = {"range": pa.array(place[at[:-1]]), "first": pa.array(np.full(len(at) - 1, first))}
            yield from _few(_filled(_SENT, **arrays, grams=packed(gram, at), rows=packed(who, at)))

        for batch in (few for piece in pieces(batches, limit=SLICE) for few in _few(piece, 1 << 16)):
            n = batch.num_rows
            if texts_ + n > 1 << 16 or size > HELD or not texts_:
                if rare:
                    yield from rows()
                first, texts_, size = batch.column("row_id")[0].as_py(), 0, 0
            symbols, edges = sequences(batch.column("text").to_pylist())
            owner = np.repeat(np.arange(n, dtype=PLACE), np.diff(edges))
            some = np.arange(len(symbols))
            base, score = np.zeros(n), np.zeros(n)
            for length, keys in enumerate(grams(symbols, edges, len(usual.known) + 1), 1):
                if length == 1:
                    hit, place = _met(usual.words, keys)
                    who = owner[hit]
                    known = np.bincount(who, minlength=n)
                    base += np.bincount(who, weights=usual.word_bases[place], minlength=n)
                    score += np.bincount(who, weights=usual.word_values[place], minlength=n)
                    left = np.flatnonzero(~hit)
                else:
                    some = some[keys[some] != 0]
                    if length > 2:
                        some = some[likely[some] & likely[some - 1]]
                    left = some[usual.known[length - 2].maybe(keys[some])]
                    hit, place = _met(usual.grams, keys[left])
                    score += np.bincount(owner[left[hit]], weights=usual.gram_values[place], minlength=n)
                    left = left[~hit]
                if len(left):
                    rare.append((owner[left] + PLACE(texts_), keys[left]))
                    size += len(left)
                if 1 < length <= len(usual.frequent) + 1:
                    likely = np.zeros(len(symbols), dtype=bool)
                    likely[some] = usual.frequent[length - 2].maybe(keys[some])
            spread = range_of(mix(np.array([batch.column("row_id")[0].as_py()], dtype=U64)), bits)
            yield _filled(
                _SENT,
                range=pa.array(np.repeat(spread, n)),
                first=pa.array(np.full(n, ~first)),
                **{c: batch.column(c) for c in ("row_id", "doc_id", "held_out")},
                n_tokens=pa.array(np.diff(edges)),
                known=pa.array(known.astype(np.int64)),
                base=pa.array(base),
                score=pa.array(score),
            )
            texts_ += n
        if rare:
            yield from rows()

    return texts.mapInArrow(run, _SENT)


def _by_range(looked: DataFrame, bits: int) -> DataFrame:
    """Rows of values in the shape of ``_SENT``: ``first`` is null, and ``rows`` holds base and value of each gram."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            gram, base, value = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(gram)
            place = range_of(gram[order], bits)
            at = cuts(place)
            both = np.stack((base[order], value[order]), axis=1)
            held.clear()
            return _few(
                _filled(_SENT, range=pa.array(place[at[:-1]]), grams=packed(gram[order], at), rows=packed(both.ravel(), at * 2))
            )

        for batch in batches:
            if batch.num_rows:
                gram = batch.column("gram").to_numpy().view(U64)
                held.append((gram, batch.column("base").to_numpy(), batch.column("value").to_numpy()))
            if sum(len(x[0]) for x in held) > HELD // 2:
                yield from rows()
        if held:
            yield from rows()

    return looked.select("gram", "base", "value").mapInArrow(run, _SENT)


def _looked_up(scored: DataFrame, looked: DataFrame, bits: int) -> DataFrame:
    """Rows of texts (``_TEXT``), with what the grams that are not broadcast add to each.

    In a range the values come first, then the texts, then the grams of one slice of texts after the other. All grams of a
    batch are looked up at once, and what a task finds goes on by slices of texts, whatever the ranges.
    """

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table, numbers = None, [], None, None
        hits: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            first, who, both = (np.concatenate(x) for x in zip(*hits))
            hits.clear()
            word = both[:, 0] < 0  # a word has a base below 0, a longer gram none
            for kind in (word, ~word):
                some = np.flatnonzero(kind)
                some = some[np.argsort(first[some], kind="stable")]
                at = cuts(first[some])
                given = {"bases": packed(both[some, 0], at)} if kind is word else {}
                arrays = {"first": pa.array(first[some[at[:-1]]]), "range": pa.array(np.full(len(at) - 1, now))}
                yield from _few(_filled(_MET, **arrays, rows=packed(who[some], at), values=packed(both[some, 1], at), **given))

        for place, found in runs(batches, "range"):
            if place != now:
                if size > HELD // 2:
                    yield from rows()
                    size = 0
                now, parts, table, numbers = place, [], None, np.zeros((0, 2))
            values = found.column("first").null_count  # they stand before all others
            if values:
                numbers_of = unpacked(found.column("rows"), 0, values, np.float64).reshape(-1, 2)
                parts.append((unpacked(found.column("grams"), 0, values, U64), numbers_of))
            found = found.slice(values)
            texts = int((found.column("first").to_numpy() < 0).sum())
            if texts:
                first = pa.array(~found.column("first").to_numpy()[:texts])
                yield _filled(_MET, first=first, **{c: found.column(c).slice(0, texts) for c in _TEXT_NAMES})
            found = found.slice(texts)
            n = found.num_rows
            if not n:
                continue
            if table is None:
                table = Table(np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, dtype=U64))
                numbers = np.concatenate([numbers, *(y for _, y in parts)])
                parts = []
            at = table.find(unpacked(found.column("grams"), 0, n, U64))
            hit = np.flatnonzero(at >= 0)
            if len(hit):
                first = np.repeat(found.column("first").to_numpy(), lengths(found.column("grams"), U64))
                hits.append((first[hit], unpacked(found.column("rows"), 0, n, PLACE)[hit], numbers[at[hit]]))
                size += len(hit)
            if size > HELD:
                yield from rows()
                size = 0
        if hits:
            yield from rows()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, sums, held, size = None, [], np.zeros((0, 3)), [], 0

        def summed() -> None:
            if held:
                who, base, value, seen = (np.concatenate(x) for x in zip(*held))
                for k, weights in enumerate((base, value, seen)):
                    sums[:, k] += np.bincount(who, weights=weights, minlength=len(sums))
                held.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            summed()
            for some in texts:
                at = some.column("row_id").to_numpy() - now
                added = {
                    "known": some.column("known").to_numpy() + sums[at, 2].astype(np.int64),
                    "base": some.column("base").to_numpy() + sums[at, 0],
                    "score": some.column("score").to_numpy() + sums[at, 1],
                }
                arrays = [pa.array(added[c]) if c in added else some.column(c) for c in _TEXT_NAMES]
                yield pa.RecordBatch.from_arrays(arrays, _TEXT_NAMES)

        for first, found in runs(batches, "first"):
            if first != now:
                if now is not None:
                    yield from rows()
                now, texts, sums, size = first, [], np.zeros((1 << 16, 3)), 0
            n = found.column("range").null_count  # the texts stand before what was found of them
            if n:
                texts.append(found.slice(0, n).select(_TEXT_NAMES).take(pa.array(np.arange(n))))  # without the rest of the batch
            found = found.slice(n)
            n = found.num_rows
            if n:
                who, value = unpacked(found.column("rows"), 0, n, PLACE), unpacked(found.column("values"), 0, n, np.float64)
                word = np.repeat(found.column("bases").is_valid().to_numpy(zero_copy_only=False), lengths(found.column("rows"), PLACE))
                base = np.zeros(len(who))
                base[word] = unpacked(found.column("bases"), 0, n, np.float64)
                held.append((who, base, value, word))
                size += len(who)
            if size > HELD:
                summed()
                size = 0
        if now is not None:
            yield from rows()

    both = dealt(_by_range(looked, bits).unionByName(scored), "range", "first")
    return dealt(both.mapInArrow(find, _MET), "first", "range").mapInArrow(add, _TEXT)


def _parts(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and what the grams known to it add to the scores (``_TEXT``)."""
    spark = docs.sparkSession
    model = learn(docs)
    whole, place = values(model)
    for folder in model.folders:
        delete_scratch(spark, folder)
    is_word = F.col("length") == 1
    least = _usual_from(whole.where(~is_word))
    often = F.col("times") >= F.when(is_word, model.often).otherwise(least)
    words = _columns(whole.where(is_word & often).select("gram", "base", "value"))
    grams_ = _columns(whole.where(~is_word & often).select("gram", "value"))
    order, order_ = np.argsort(words["gram"]), np.argsort(grams_["gram"])
    tables = [words[n][order] for n in ("gram", "base", "value")] + [grams_[n][order_] for n in ("gram", "value")]
    known = [Bitmap(whole.where(F.col("length") == n + 2).select("gram")) for n in range(len(model.stored))]
    shared = spark.sparkContext.broadcast(Usual(known, model.frequent, *tables))
    looked = whole.where(~often)
    # As many rounds over some of the texts each as keep the grams on their way in proportion to the texts.
    met = looked.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    rounds = min(ROUNDS, max(1, math.ceil(met / max(1.0, SHARE * model.tokens))))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    paths = []
    for turn in range(rounds):
        some = texts if rounds == 1 else texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == turn)
        some = some.withColumn("row_id", F.monotonically_increasing_id())  # consecutive in a task
        found = _looked_up(_scored(some, shared, model.bits), looked, model.bits)
        paths.append(passing(found, "scores")[1])
    shared.unpersist()
    delete_scratch(spark, place)
    return model, spark.read.schema(_TEXT).parquet(*paths)


def score_texts(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, and score every row.

    Returns ``doc_id``, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (seen in training), ``train_tokens``, ``base_score`` (word
    frequencies, ``ADD`` added to each count) and ``score``, both log10 of a probability of the text.

    Null and empty texts are an end alone. Repeated rows are counted and scored each. A null ``doc_id`` is not held out.
    Without training rows every token has probability 1 at the root. Other columns are not looked at; an empty table gives an
    empty result.
    """
    with tidy(docs.sparkSession):
        model, part = _parts(docs)
    unknown = (F.col("n_tokens") - F.col("known")) * float(np.log10(ADD / model.base))
    return part.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + unknown).alias("base_score"),
        (F.col("score") + unknown).alias("score"),
    )
