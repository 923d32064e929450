"""Word-vector models: turns compared through the vectors of their words.

A sum of similarities with one key term is the dot product of the key's unit vector with the sum of
the words' unit vectors, so words are summed first and no term-by-term table is needed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import TextFunction, tokens
from turnwise.operators import parts
from turnwise.operators.cells import WIDTH, in_cells, lists, matrix, meet
from turnwise.operators.concepts import in_sentences
from turnwise.operators.ordering import TURN_BLOCK, attach, block_of, place
from turnwise.operators.pairs import dot, dot_arrays, unit_vectors

# A vector table of at most this many numbers (64 MB as floats) goes to every executor.
BROADCAST_NUMBERS = 16_000_000
# A conversation of more words, or of more than one block of turns, is worked on in blocks of its vocabulary.
WIDE_WORDS = 1 << 20


def vector_shape(word_vectors: DataFrame) -> tuple[int, int]:
    """Number of vectors and numbers per vector."""
    row = word_vectors.agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dims")
    ).first()
    return row["n"], row["dims"]


def look_up(rows: DataFrame, word_vectors: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Join the columns of ``word_vectors`` to rows with a ``term``; unknown words fall out.

    The table is broadcast where its size allows. Beyond, the rows are joined as they are, so they should be few or narrow
    (see :mod:`turnwise.operators.parts` for the words of turns); a common word's rows are split by adaptive execution.
    """
    if not _many(shape):
        return rows.join(F.broadcast(word_vectors), "term")
    return rows.join(word_vectors.hint("merge"), "term")


def _many(shape: tuple[int, int]) -> bool:
    return shape[0] * shape[1] > BROADCAST_NUMBERS


def _size_of_words() -> Column:
    return F.expr("aggregate(sentences, 0L, (a, s) -> a + size(s))")


def _count_words(base: DataFrame) -> int:
    return in_sentences(base).agg(F.sum(_size_of_words())).first()[0] or 0


def _kind(df: DataFrame, column: str) -> str:
    return f"{column} {df.schema[column].dataType.simpleString()}"


def _summed(rows: DataFrame, column: str, dims: int) -> DataFrame:
    """Sum of the vectors of each turn: ``conv_id, [block,] turn, vector``."""
    keys = [*place(rows), "turn"]
    sums = [F.expr(f"sum(double({column}[{i}])) AS s{i}") for i in range(dims)]
    total = rows.groupBy(*keys).agg(*sums)
    return total.select(*keys, F.array(*[f"s{i}" for i in range(dims)]).alias("vector"))


def mean_vectors(
    turns: DataFrame, word_vectors: DataFrame, *, tokenizer: TextFunction = tokens
) -> DataFrame:
    """``conv_id, turn, vector``: mean vector of a turn's words (those that have one)."""
    shape = vector_shape(word_vectors)
    words = turns.select("conv_id", "turn", F.explode(tokenizer(F.col("text"))).alias("term"))
    if _many(shape):
        n_words = (turns.agg(F.sum(F.length("text"))).first()[0] or 0) // 5
        placed = words.withColumn("block", block_of("turn", TURN_BLOCK))
        schema = ", ".join([_kind(words, "conv_id"), "block bigint", _kind(words, "turn"), "vector array<double>"])
        work = partial(parts.sums, mean=True)
        found = parts.in_parts(placed, word_vectors, shape[1], n_words, ["conv_id", "block"], work, schema, unit=False)
        return found.drop("block")
    found = look_up(words, word_vectors.select("term", "vector"), shape)
    means = [F.expr(f"avg(double(vector[{i}])) AS m{i}") for i in range(shape[1])]
    return (
        found.groupBy("conv_id", "turn")
        .agg(*means)
        .select("conv_id", "turn", F.array(*[f"m{i}" for i in range(shape[1])]).alias("vector"))
    )


def _key_units(lists: DataFrame, units: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``conv_id, keys``: rank, term and unit vector of each key term that has a vector."""
    keys = lists.select("conv_id", F.inline("key_terms")).drop("occurrence")
    found = look_up(keys, units, shape)
    item = F.struct("rank", "term", "unit")
    return found.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("keys"))


def _turn_words(base: DataFrame) -> DataFrame:
    words = F.explode(F.array_distinct(F.flatten("sentences"))).alias("term")
    return in_sentences(base).select(*place(base), "turn", words)


def term_similarity(base: DataFrame, lists: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """``conv_id, key, term, similarity``: cosine of the vectors of key terms and all terms."""
    shape = vector_shape(word_vectors)
    if _many(shape) or "block" in base.columns:
        return _term_similarity_in_parts(base, lists, word_vectors, shape)
    units = unit_vectors(word_vectors.select("term", "vector"))
    words = _turn_words(base).drop("turn").distinct()
    known = attach(look_up(words, units, shape), _key_units(lists, units, shape))
    pairs = known.select("conv_id", "term", "unit", F.explode("keys").alias("k"))
    cells = pairs.select(
        "conv_id",
        F.col("k.term").alias("key"),
        "term",
        dot("k.unit", "unit", shape[1]).alias("similarity"),
    )
    return cells


def _term_similarity_in_parts(
    base: DataFrame, lists: DataFrame, word_vectors: DataFrame, shape: tuple[int, int]
) -> DataFrame:
    """The same with the words of a conversation, or of a bucket of a large vocabulary, beside its key terms."""
    words = _turn_words(base).select("conv_id", "term").distinct()
    keys = lists.select("conv_id", F.inline("key_terms")).select("conv_id", "rank", "term")
    n = words.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > parts.PART_WORDS)
    buckets = F.coalesce(F.expr(f"n div {parts.PART_WORDS} + 1"), F.lit(1).cast("bigint"))
    placed, spread = (
        df.join(F.broadcast(n), "conv_id", "left").withColumn("buckets", buckets).drop("n") for df in (words, keys)
    )
    placed = placed.withColumn("block", F.pmod(F.xxhash64("term", F.lit(7)), F.col("buckets"))).drop("buckets")
    spread = spread.withColumn("block", F.explode(F.expr("sequence(0L, buckets - 1)"))).drop("buckets")
    schema = f"{_kind(words, 'conv_id')}, key string, term string, similarity double"
    return parts.in_parts(
        placed, word_vectors, shape[1], _count_words(base), ["conv_id", "block"], parts.key_cosines, schema, keys=spread
    )


def feature_arrays(
    base: DataFrame, lists: DataFrame, word_vectors: DataFrame, n_terms: int
) -> DataFrame:
    """``conv_id, turn, vector``: per key term, the summed similarity with the words of the turn."""
    shape = vector_shape(word_vectors)
    if _many(shape):
        where = place(base)
        words = _turn_words(base).dropna(subset=where)
        keys = lists.select("conv_id", F.inline("key_terms")).select("conv_id", "rank", "term")
        if "block" in where:
            keys = base.select(*where).distinct().join(keys, "conv_id")
        schema = ", ".join([_kind(words, "conv_id"), _kind(words, "turn"), "vector array<double>"])
        work = partial(parts.key_features, n_terms=n_terms)
        return parts.in_parts(words, word_vectors, shape[1], _count_words(base), where, work, schema, keys=keys)
    units = unit_vectors(word_vectors.select("term", "vector"))
    sums = _summed(look_up(_turn_words(base), units, shape), "unit", shape[1])
    keyed = attach(sums, _key_units(lists, units, shape))
    by_rank = F.map_from_arrays(F.col("keys.rank"), F.col("keys.unit"))

    def value(rank: Column) -> Column:
        return F.coalesce(dot_arrays(F.element_at("by_rank", rank), F.col("vector")), F.lit(0.0))

    known = keyed.withColumn("by_rank", by_rank)
    values = F.transform(F.sequence(F.lit(1), F.lit(n_terms)), value)
    return known.select("conv_id", "turn", values.alias("vector"))


# ---------------------------------------------------------------- all terms as key terms

# Terms per block of a conversation's vocabulary.
TERM_BLOCK = 1024
# Copies of the facts of a conversation where its terms look them up.
TERM_SALTS = 64


def known_words(base: DataFrame, word_vectors: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``conv_id, [block,] turn, term, unit``: the different words of each turn that have a vector."""
    return look_up(_turn_words(base), unit_vectors(word_vectors.select("term", "vector")), shape)


def term_blocks(words: DataFrame) -> DataFrame:
    """``conv_id, term, unit, block, blocks``: the vocabulary of each conversation in blocks by a hash of the term."""
    terms = words.select("conv_id", "term", "unit").dropDuplicates(["conv_id", "term"])
    sizes = terms.groupBy("conv_id").agg(F.expr(f"count(*) div {TERM_BLOCK} + 1").alias("blocks"))
    salted = terms.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(TERM_SALTS)))
    return attach(salted, sizes).withColumn("block", F.pmod(F.xxhash64("term", F.lit(7)), F.col("blocks")))


def _cosines(cell: pa.Table, dims: int) -> Iterator[pa.RecordBatch]:
    own = cell["i"][0].as_py() == cell["j"][0].as_py()
    side = cell["side"].to_numpy()
    one = cell.filter(pa.array(side == 0))
    other = one if own else cell.filter(pa.array(side == 1))
    values = matrix(one["unit"], dims) @ matrix(other["unit"], dims).T
    a = np.repeat(np.arange(len(one)), len(other))
    b = np.tile(np.arange(len(other)), len(one))
    keys, terms = one["term"].combine_chunks().take(pa.array(a)), other["term"].combine_chunks().take(pa.array(b))
    conv = pa.array([cell["conv_id"][0].as_py()] * len(a), pa.int64())
    names = ["conv_id", "key", "term", "similarity"]
    for at in [(keys, terms)] if own else [(keys, terms), (terms, keys)]:
        yield pa.RecordBatch.from_arrays([conv, *at, pa.array(values.ravel())], names=names)


def term_similarity_all(words: DataFrame, dims: int) -> DataFrame:
    """:func:`term_similarity` with every term as a key term: block against block of the vocabulary."""
    schema = "conv_id bigint, key string, term string, similarity double"
    rows = meet(term_blocks(words).withColumn("conv_id", F.col("conv_id").cast("bigint")))
    return in_cells(rows, ["conv_id", "i", "j"], partial(_cosines, dims=dims), schema)


def _features(cell: pa.Table, dims: int) -> Iterator[pa.RecordBatch]:
    is_turn = pc.is_null(cell["term"])
    turns, terms = cell.filter(is_turn), cell.filter(pc.invert(is_turn))
    values = matrix(turns["unit"], dims) @ matrix(terms["unit"], dims).T
    a, b = np.nonzero(values)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([cell["conv_id"][0].as_py()] * len(a), pa.int64()),
            turns["turn"].combine_chunks().take(pa.array(a)),
            terms["term"].combine_chunks().take(pa.array(b)),
            pa.array(values[a, b]),
        ],
        names=["conv_id", "turn", "term", "value"],
    )


def _by_size(base: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Conversations that one task may hold, the others (or none), and how many words there are."""
    n = F.sum(_size_of_words()).alias("n")
    block = F.max("block") if "block" in base.columns else F.lit(0)
    facts = in_sentences(base).groupBy("conv_id").agg(n, F.coalesce(block, F.lit(0)).alias("last"))
    wide = (F.col("n") > WIDE_WORDS) | (F.col("last") > 0)
    total, any_wide = facts.agg(F.sum("n"), F.bool_or(wide)).first()
    if not any_wide:
        return base, None, total or 0
    ids = facts.where(wide).select("conv_id")
    return base.join(ids, "conv_id", "left_anti"), base.join(ids, "conv_id", "left_semi"), total


def _whole(base: DataFrame, word_vectors: DataFrame, dims: int, n_words: int, work, columns: str) -> DataFrame:
    """``work`` on the words of whole conversations."""
    words = _turn_words(base).where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "term"
    )
    schema = f"conv_id bigint, turn bigint, {columns}"
    return parts.in_parts(words, word_vectors, dims, n_words, ["conv_id"], work, schema)


def features_all(base: DataFrame, word_vectors: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``conv_id, turn, term, value``: the feature vectors with every term as a key term; zero cells are absent."""
    near, far, n_words = _by_size(base)
    found = _whole(near, word_vectors, shape[1], n_words, parts.all_features, "term string, value double")
    found = found.where("turn IS NOT NULL")
    if far is None:
        return found
    return found.unionByName(features_in_blocks(known_words(far, word_vectors, shape), shape[1]))


def features_in_blocks(words: DataFrame, dims: int) -> DataFrame:
    """The same for conversations of any size: turns in blocks meet terms in blocks, a cell is one small matrix product."""
    sums = _summed(words, "unit", dims).select(
        "conv_id", "turn", F.col("vector").alias("unit"), block_of("turn", WIDTH).alias("block")
    )
    terms = term_blocks(words)
    term_sizes = terms.groupBy("conv_id").agg(F.first("blocks").alias("others"))
    turn_sizes = sums.groupBy("conv_id").agg((F.max("block") + 1).alias("others"))
    j = F.explode(F.expr("sequence(0L, others - 1)"))
    left = attach(sums, term_sizes).select(
        "conv_id", F.col("block").alias("i"), j.alias("j"), "turn", F.lit(None).cast("string").alias("term"), "unit"
    )
    right = attach(terms.drop("blocks"), turn_sizes).select(
        "conv_id", j.alias("i"), F.col("block").alias("j"), F.lit(None).cast("bigint").alias("turn"), "term", "unit"
    )
    both = left.unionByName(right).withColumns({c: F.col(c).cast("bigint") for c in ("conv_id", "turn")})
    schema = "conv_id bigint, turn bigint, term string, value double"
    return in_cells(both, ["conv_id", "i", "j"], partial(_features, dims=dims), schema)


def _grams(cell: pa.Table, dims: int) -> Iterator[pa.RecordBatch]:
    units = matrix(cell["unit"], dims)
    conv = pa.array([cell["conv_id"][0].as_py()], pa.int64())
    yield pa.RecordBatch.from_arrays([conv, lists((units.T @ units).reshape(1, -1))], names=["conv_id", "gram"])


def _roots(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Square root of the summed matrices of each conversation; one sum is held at a time."""

    def done() -> pa.RecordBatch:
        root = parts.root_of(total)
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), lists(root.reshape(1, -1))], names=["conv_id", "root"])

    conv, total, begun = None, np.zeros((dims, dims)), False
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        values = matrix(pa.chunked_array([batch.column("gram")]), dims * dims)
        for i, value in zip(ids, values):
            if begun and i != conv:
                yield done()
                total = np.zeros((dims, dims))
            conv, begun = i, True
            total += value.reshape(dims, dims)
    if begun:
        yield done()


def _turned(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = matrix(pa.chunked_array([batch.column("root")]), dims * dims).reshape(-1, dims, dims)
        sums = matrix(pa.chunked_array([batch.column("vector")]), dims)
        turned = np.einsum("nij,nj->ni", roots, sums)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), lists(turned)], names=["conv_id", "turn", "vector"]
        )


def arrays_all(base: DataFrame, word_vectors: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``conv_id, turn, vector``: vectors of ``dims`` numbers whose products are those of the all-terms feature vectors.

    With U the unit vectors of a conversation's terms and s the sum of those of a turn, the feature vector is U s, and
    products of feature vectors are s' (U'U) t. U'U is a small square matrix, summed over blocks of terms, and its
    square root times s has the same products: the vocabulary is never a dimension.
    """
    near, far, n_words = _by_size(base)
    found = _whole(near, word_vectors, shape[1], n_words, parts.all_roots, "vector array<double>")
    if "block" in base.columns:
        found = found.where("turn IS NOT NULL")
    if far is None:
        return found
    return found.unionByName(arrays_in_blocks(known_words(far, word_vectors, shape), shape[1]))


def arrays_in_blocks(words: DataFrame, dims: int) -> DataFrame:
    """The same for conversations of any size, by blocks of terms."""
    blocks = term_blocks(words).drop("blocks").withColumn("conv_id", F.col("conv_id").cast("bigint"))
    kind = "conv_id bigint, gram array<double>"
    grams = in_cells(blocks, ["conv_id", "block"], partial(_grams, dims=dims), kind)
    ordered = grams.repartition("conv_id").sortWithinPartitions("conv_id")
    roots = ordered.mapInArrow(partial(_roots, dims=dims), "conv_id bigint, root array<double>")
    sums = _summed(words, "unit", dims).withColumn("conv_id", F.col("conv_id").cast("bigint"))
    met = attach(sums, roots).select("conv_id", F.col("turn").cast("bigint"), "vector", "root")
    return met.mapInArrow(partial(_turned, dims=dims), "conv_id bigint, turn bigint, vector array<double>")
