"""Toxicity scores: logistic regression by FTRL-proximal over hashed words, word pairs and skip-grams.

A text is the set of its features: words (without signs), pairs of neighbours, and pairs with one word between, hashed into a
fixed number of places. Every coordinate has its own learning rate, and L1 keeps all but few weights
at zero, so the model is a short list, broadcast to the tasks (its size is bounded by ``2 ** BITS``).

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, those with the least hash of their id: a documented
bound, so that the fit is one small task at every size. Scoring reads all texts once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.words import SIGNS, U64, batch_words, mix, pieces, release, seeds

BITS = 20
TRAIN_ROWS = 16384
EPOCHS = 8
SLICE = 1 << 20  # bytes of text whose features are held at a time
# Steps and L1 are large beside the usual: most features of a toxic text are harmless words that occur once, and a text
# has thousands, so a weight has to be earned in several texts.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1
FOLDS = 5  # rows of fold 0 are held out

_FACTOR = seeds(4, 55)


def text_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all features of all texts, and the number of the text of each; with repeats."""
    hashes, edges = batch_words(texts, SIGNS)
    owner = np.repeat(np.arange(len(texts)), np.diff(edges))
    shift = U64(64 - BITS)
    places, owners = [mix(hashes * _FACTOR[0]) >> shift], [owner]
    for gap in (1, 2):
        if len(hashes) > gap:
            same = owner[gap:] == owner[:-gap]
            pair = hashes[:-gap] * _FACTOR[1] + mix(hashes[gap:] + _FACTOR[1 + gap])
            places.append((mix(pair) >> shift)[same])
            owners.append(owner[gap:][same])
    return np.concatenate(places).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal for a set of active places; place ``2 ** BITS`` is always active and free of L1."""

    def __init__(self) -> None:
        size = (1 << BITS) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.l1 = np.full(size, L1)
        self.l1[-1] = 0.0

    def weights(self, places) -> np.ndarray:
        z, l1 = self.z[places], self.l1[places]
        step = (BETA + np.sqrt(self.n[places])) / ALPHA + L2
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / step)

    def learn(self, places: np.ndarray, label: float) -> None:
        w = self.weights(places)
        gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[places]
        more = n + gradient * gradient
        self.z[places] += gradient - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[places] = more


def _fit(table: pa.Table) -> pa.Table:
    """The non-zero weights, from the features and labels of the training rows."""
    order = np.lexsort((table.column("doc_id").to_numpy(), table.column("hash").to_numpy()))
    labels = table.column("label").to_numpy()
    lists = [x.values.to_numpy() for x in table.column("places")]
    model = Ftrl()
    for _ in range(EPOCHS):
        for i in order.tolist():
            model.learn(np.append(lists[i], 1 << BITS), float(labels[i]))
    weights = model.weights(slice(None))
    some = np.flatnonzero(weights)
    del model, lists
    release()
    return pa.table({"place": pa.array(some, pa.int64()), "weight": pa.array(weights[some])})


def held_out(doc_id, folds: int = FOLDS):
    """Whether a row is kept from training: the remainder of the CRC-32 of its id as text is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = TRAIN_ROWS) -> DataFrame:
    """``place``, ``weight``: the model, learned from the labelled rows that are not held out, at most ``sample_rows`` of them.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``toxic``; a document with several labels is toxic if one
    of them says so. Null ids and labels are not learned from. Of an id with several rows the least text is learned from.
    """
    given = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    given = given.where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    sample = (
        given.agg((F.max("toxic") > 0).cast("int").alias("label"))
        .withColumn("hash", F.xxhash64("doc_id"))
        .orderBy("hash", "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = texts.join(F.broadcast(sample), "doc_id")  # at most sample_rows ids
    rows = labelled.groupBy("doc_id", "hash", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=SLICE):
            places, owners = text_features(batch.column(3).to_pylist())
            edges = np.searchsorted(np.sort(owners), np.arange(batch.num_rows + 1))
            places = places[np.argsort(owners, kind="stable")].astype(np.int32)
            sets = [np.unique(places[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            lists = pa.array(sets, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["doc_id", "hash", "label", "places"])

    schema = "doc_id long, hash long, label int, places array<int>"
    featured = rows.mapInArrow(run, schema)
    return featured.groupBy(F.lit(0).alias("all")).applyInArrow(_fit, "place long, weight double")


def score_toxicity(docs: DataFrame, model: DataFrame, column: str = "score") -> DataFrame:
    """``docs`` with one column more, which must not be there yet. The model has at most ``2 ** BITS + 1`` rows and is broadcast.

    Null and empty texts get the score of a text without features; without a model (no labels) every score is 0.
    """
    rows = model.toArrow()
    known = np.zeros((1 << BITS) + 1)
    known[rows.column("place").to_numpy()] = rows.column("weight").to_numpy()
    if not rows.num_rows:
        known[-1] = -np.inf
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in pieces(batches, limit=SLICE):
            places, owners = text_features(batch.column(at).to_pylist())
            some = weights[places] != 0
            both = np.unique(owners[some] * (1 << BITS) + places[some])
            total = np.bincount(both >> BITS, weights=weights[both & ((1 << BITS) - 1)], minlength=batch.num_rows)
            score = 1.0 / (1.0 + np.exp(-np.clip(total + weights[-1], -700, 700)))
            if weights[-1] == -np.inf:
                score = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, column])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add(column, DoubleType())
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every row of ``docs``.

    Inputs of a score are the words of the text alone. Repeated rows score alike; a null ``doc_id`` is kept, not held
    out and not learned from. An empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score_toxicity(plain, fit_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
