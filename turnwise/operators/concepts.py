"""Concept model: which terms occur together, and how alike turns are through them.

Everything derives from one table, :func:`sentence_terms`, laid out by (conversation, block of turns).
Per-conversation facts are joined by block, terms of a block are grouped in place, so a huge
conversation is just many blocks. Where all conversations are brief (``ordering.all_brief``) the layout
is by conversation alone and every later step up to the vectors finds its rows in place.

Similarity of terms i and j over N windows, where O counts windows with a term and C those with both:
``S = P(i,j) P(-i,-j) / (P(-i,j) P(i,-j))``; a zero count in the last three factors gives probability 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import TextFunction, binding, drop_stopwords, sentences, tokens
from turnwise.operators import near
from turnwise.operators.ordering import attach, place, top_rows
from turnwise.operators.pairs import turn_pairs
from turnwise.operators.prepare import with_block
from turnwise.operators.terms import check_key_terms

# Windows per mask: enough for neighbours to share one, few enough that the terms of a stretch meet mostly.
SHORTEST_STRETCH, LONGEST_STRETCH = 16, 64


def sliding_windows(items: Column, width: int) -> Column:
    """All runs of ``width`` neighbouring items; one run of everything where there are fewer."""
    n = F.size(items)
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))),
        lambda start: F.slice(items, start + 1, F.lit(width)),
    )
    return F.when(n < width, F.array(items)).otherwise(runs)


def sentence_windows(
    turns: DataFrame,
    width: int = 3,
    *,
    columns: Sequence[str] = ("conv_id", "turn"),
    splitter: TextFunction = sentences,
) -> DataFrame:
    """One row per window of sentences: ``columns, window_no, sentences``."""
    if width < 1:
        raise ValueError("a window needs at least one sentence")
    windows = binding(splitter(F.col("text")), lambda s: sliding_windows(s, width))
    rows = turns.select(*columns, F.posexplode(windows).alias("window_no", "sentences"))
    return rows.withColumn("window_no", F.col("window_no").cast("bigint"))


def sentence_terms(
    turns: DataFrame,
    *,
    stopwords: Sequence[str] | None = None,
    tokenizer: TextFunction = tokens,
    splitter: TextFunction = sentences,
    brief: bool = False,
) -> DataFrame:
    """``conv_id, [block,] turn, sentences``: the different terms of each sentence of each turn.

    The one pass over the texts, and the one shuffle of their words. It pays to write it down
    (``session.cut_lineage``) as several steps read it.
    """
    words = F.transform(splitter(F.col("text")), lambda s: F.array_distinct(tokenizer(s)))
    placed = with_block(turns, brief).withColumn("__words", words)
    where = place(placed)
    kept = drop_stopwords("__words", stopwords, nested=True).alias("sentences")
    return placed.select(*where, "turn", kept).repartition(*where)


def window_terms(terms: DataFrame, width: int = 3) -> DataFrame:
    """``conv_id, [block,] turn, sentences, width``: what the windows of sentences are told from.

    No window is ever a row: see :func:`window_masks`.
    """
    if width < 1:
        raise ValueError("a window needs at least one sentence")
    return terms.select(*place(terms), "turn", "sentences", F.lit(width).alias("width"))


def in_sentences(base: DataFrame) -> DataFrame:
    """A table of :func:`window_terms`; windows given as such (a column ``windows``) are windows of one sentence."""
    if "windows" not in base.columns:
        return base
    return base.withColumnRenamed("windows", "sentences").withColumn("width", F.lit(1))


def total_windows(base: DataFrame) -> DataFrame:
    """``conv_id, n_windows``; a turn without sentences has one (empty) window."""
    windows = F.greatest(F.size("sentences") - F.col("width") + 1, F.lit(1))
    return in_sentences(base).groupBy("conv_id").agg(F.sum(windows).cast("bigint").alias("n_windows"))


def window_masks(base: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """``conv_id, [block,] turn, [kept,] stretch, term, mask``: the windows that hold a term, one bit each.

    The windows of a turn are cut into stretches of at most 64 neighbours. A sentence lies in a run of windows, so it gives its
    terms one run of bits per stretch, however wide the windows are; windows with two terms are the bits in both masks.
    """
    stretch = F.least(F.lit(LONGEST_STRETCH), F.greatest(F.lit(SHORTEST_STRETCH), F.col("width") * 4))
    where = [*place(base), "turn", *kept]
    placed = in_sentences(base).select(
        *where,
        "width",
        stretch.alias("bits"),
        F.greatest(F.size("sentences") - F.col("width"), F.lit(0)).alias("end"),
        F.posexplode("sentences").alias("at", "words"),
    ).withColumns(
        {"first": F.greatest(F.col("at") - F.col("width") + 1, F.lit(0)), "last": F.least("at", "end")}
    )
    runs = placed.withColumn("stretch", F.explode(F.expr("sequence(first div bits, last div bits)")))
    low = F.expr("cast(greatest(first - stretch * bits, 0) AS int)")
    high = F.expr("cast(least(last - stretch * bits, bits - 1) AS int)")
    ones = F.lit(-1).cast("bigint")
    run = F.call_function("shiftleft", ones, low).bitwiseAND(F.call_function("shiftrightunsigned", ones, 63 - high))
    words = runs.select(*where, "stretch", run.alias("run"), F.explode("words").alias("term"))
    return words.groupBy(*where, "stretch", "term").agg(F.bit_or("run").alias("mask"))


def term_counts(base: DataFrame) -> DataFrame:
    """``conv_id, term, occurrence, n_turns``: windows and turns holding the term."""
    per_turn = window_masks(base).groupBy(*place(base), "turn", "term")
    return (
        per_turn.agg(F.sum(F.bit_count("mask")).alias("n"))
        .groupBy("conv_id", "term")
        .agg(F.sum("n").alias("occurrence"), F.count("*").alias("n_turns"))
    )


def term_occurrence(base: DataFrame) -> DataFrame:
    """``conv_id, term, occurrence``: windows containing the term."""
    return window_masks(base).groupBy("conv_id", "term").agg(F.sum(F.bit_count("mask")).alias("occurrence"))


def _stretch_pairs(masks: DataFrame, kept: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """``conv_id, kept, i, j, n``: the terms that meet in a stretch, as structs of ``term, mask, carried``, ``i.term < j.term``.

    Stretches are dealt out by themselves, not by conversation or turn, so a huge conversation and a turn as long as a
    book are counted in many tasks.
    """
    keys = ["conv_id", "turn", "stretch"]
    entry = F.struct("term", "mask", *carried)
    lists = (
        masks.repartition(*keys)
        .groupBy(*keys)
        .agg(*[F.first(c).alias(c) for c in kept], F.sort_array(F.collect_list(entry)).alias("w"))
    )
    first = lists.select("conv_id", *kept, "w", F.posexplode("w").alias("at", "i"))
    later = F.filter(
        F.slice("w", F.col("at") + 2, F.size("w")), lambda j: j["mask"].bitwiseAND(F.col("i.mask")) != 0
    )
    pairs = first.select("conv_id", *kept, "i", F.explode(later).alias("j"))
    both = F.bit_count(F.col("i.mask").bitwiseAND(F.col("j.mask")))
    return pairs.withColumn("n", both)


def _pair_counts(base: DataFrame) -> DataFrame:
    """``conv_id, term_i, term_j, n, o_i, o_j, n_windows`` for every pair that occurs together, ``term_i < term_j``.

    Conversations that a task may hold are counted in one place (:mod:`turnwise.operators.near`), so their pairs are not shuffled.
    """
    at_once, others = near.split(in_sentences(base), near.PAIR_WORDS)
    pairs = near.term_pairs(at_once.where("conv_id IS NOT NULL"))
    return pairs if others is None else pairs.unionByName(_pair_counts_in_stretches(others))


def _pair_counts_in_stretches(base: DataFrame) -> DataFrame:
    """The same for conversations of any size.

    The number of windows of each term travels beside the term, so the table of pairs is joined with nothing. A term meets its
    number once per block, with all its masks there in one row, so a term that is everywhere in a huge conversation is no hot key.
    """
    masks = window_masks(attach(base, total_windows(base)), ["n_windows"])
    span = F.struct("turn", "stretch", "mask")
    postings = masks.groupBy(*place(base), "n_windows", "term").agg(F.collect_list(span).alias("spans"))
    # Sizes are guessed from the texts, which hold many words each: neither side may be broadcast on a guess.
    known = postings.join(term_occurrence(base).hint("merge"), ["conv_id", "term"])
    spans = known.select("conv_id", "n_windows", "term", F.col("occurrence").alias("o"), F.inline("spans"))
    pairs = _stretch_pairs(spans, ["n_windows"], ["o"])
    return pairs.groupBy("conv_id", F.col("i.term").alias("term_i"), F.col("j.term").alias("term_j")).agg(
        F.sum("n").alias("n"),
        F.first("i.o").alias("o_i"),
        F.first("j.o").alias("o_j"),
        F.first("n_windows").alias("n_windows"),
    )


def _mirrored(pairs: DataFrame, kept: Sequence[str], swapped: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Both orders of every pair; the columns of each tuple change places with the terms."""
    change = {"term_i": "term_j", "term_j": "term_i"} | {a: b for x, y in swapped for a, b in ((x, y), (y, x))}
    names = ["term_i", "term_j", *kept]
    both = F.array(F.struct(*names), F.struct(*[F.col(change.get(n, n)).alias(n) for n in names]))
    return pairs.select("conv_id", F.inline(both))


def term_cooccurrence(base: DataFrame) -> DataFrame:
    """``conv_id, term_i, term_j, n``: windows containing both, for every ordered pair that occurs."""
    at_once, others = near.split(in_sentences(base), near.PAIR_WORDS)
    counts = near.term_pairs(at_once).select("conv_id", "term_i", "term_j", "n")
    if others is not None:
        counts = counts.unionByName(_cooccurrence_in_stretches(others))
    return _mirrored(counts, ["n"])


def _cooccurrence_in_stretches(base: DataFrame) -> DataFrame:
    """``conv_id, term_i, term_j, n`` with ``term_i < term_j``, for conversations of any size."""
    pairs = _stretch_pairs(window_masks(base), [], [])
    terms = [F.col("i.term").alias("term_i"), F.col("j.term").alias("term_j")]
    return pairs.groupBy("conv_id", *terms).agg(F.sum("n").alias("n"))


def term_contingency(base: DataFrame) -> DataFrame:
    """The four cells of the contingency table of every pair that occurs together.

    ``conv_id, term_i, term_j, i_j, i_not_j, not_i_j, not_i_not_j, n_windows``.
    """
    return _mirrored(
        _cells(_pair_counts(base)),
        ["i_j", "i_not_j", "not_i_j", "not_i_not_j", "n_windows"],
        [("i_not_j", "not_i_j")],
    )


def _cells(pairs: DataFrame) -> DataFrame:
    n = F.col("n")
    return pairs.select(
        "conv_id",
        "term_i",
        "term_j",
        n.alias("i_j"),
        (F.col("o_i") - n).alias("i_not_j"),
        (F.col("o_j") - n).alias("not_i_j"),
        (F.col("n_windows") - (F.col("o_i") + F.col("o_j") - n)).alias("not_i_not_j"),
        "n_windows",
    )


def window_term_similarity(base: DataFrame) -> DataFrame:
    """:func:`term_similarity` from the windows: every pair is scored once, in one order."""
    return _mirrored(term_similarity(_cells(_pair_counts(base))), ["similarity"])


def contingency_cells(cooccurrence: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from known counts: ``conv_id, term_i, term_j, n`` and ``conv_id, term, occurrence, n_windows``."""
    of_i = counts.select(
        "conv_id", F.col("term").alias("term_i"), F.col("occurrence").alias("o_i"), "n_windows"
    )
    of_j = counts.select("conv_id", F.col("term").alias("term_j"), F.col("occurrence").alias("o_j"))
    return _cells(cooccurrence.join(of_i, ["conv_id", "term_i"]).join(of_j, ["conv_id", "term_j"]))


def similarity_score(i_j: Column, i_not_j: Column, not_i_j: Column, neither: Column, n: Column) -> Column:
    """The term similarity from a contingency table.

    The number of windows cancels out; a probability that counts as 1 is a count of ``n``. Products of whole numbers and one
    division: sums of such values hardly depend on the order of the rows.
    """

    def counted(count: Column) -> Column:
        return F.when(count == 0, n).otherwise(count).cast("double")

    return i_j.cast("double") * counted(neither) / (counted(not_i_j) * counted(i_not_j))


def term_similarity(contingency: DataFrame) -> DataFrame:
    """``conv_id, term_i, term_j, similarity`` for every pair that occurs together; the rest is 0."""
    score = similarity_score(
        *[F.col(c) for c in ("i_j", "i_not_j", "not_i_j", "not_i_not_j", "n_windows")]
    )
    return contingency.select("conv_id", "term_i", "term_j", score.alias("similarity"))


# ---------------------------------------------------------------- key terms and concept vectors


def ranked_key_terms(counts: DataFrame, key_terms: int | Sequence[str] = 20) -> DataFrame:
    """``conv_id, rank, term, occurrence``: the key terms, numbered from 1.

    The terms in most turns, or the given ones in the given order (where the conversation has them).
    """
    check_key_terms(key_terms)
    if key_terms == "all":
        raise ValueError("all terms have no ranking")
    if isinstance(key_terms, int):
        order = [F.desc("n_turns"), F.asc("term")]
        ranked = top_rows(counts, ["conv_id"], order, key_terms)
    else:
        given = list(dict.fromkeys(key_terms))
        rank = F.array_position(F.array(*[F.lit(t) for t in given]), F.col("term")).cast("int")
        ranked = counts.filter(F.col("term").isin(given)).withColumn("rank", rank)
    return ranked.select("conv_id", "rank", "term", "occurrence")


def key_term_lists(base: DataFrame, key_terms: int | Sequence[str] = 20) -> DataFrame:
    """``conv_id, n_windows, key_terms``: one short array per conversation, in rank order."""
    ranked = ranked_key_terms(term_counts(base), key_terms)
    item = F.struct("rank", "term", "occurrence")
    lists = ranked.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("key_terms"))
    return lists.join(total_windows(base), "conv_id")


def key_term_count(key_terms: int | Sequence[str]) -> int:
    """Length of the concept vectors."""
    return key_terms if isinstance(key_terms, int) else len(dict.fromkeys(key_terms))


def key_similarity(base: DataFrame, lists: DataFrame, n_terms: int) -> DataFrame:
    """``conv_id, term, weights``: similarity of a term with each key term, in rank order.

    One aggregation over the terms of the stretches of windows, with one counter per key term: key terms times
    vocabulary, never vocabulary squared, and no pair of terms is ever a row.
    """
    ranks = F.sequence(F.lit(1), F.lit(n_terms))

    def by_rank(field: str) -> Column:
        known = F.map_from_arrays("key_terms.rank", f"key_terms.{field}")
        return binding(known, lambda values: F.transform(ranks, lambda r: F.element_at(values, r)))

    facts = lists.select(
        "conv_id",
        "n_windows",
        by_rank("term").alias("names"),
        F.transform(by_rank("occurrence"), lambda o: F.coalesce(o, F.lit(0))).alias("o_keys"),
    )
    kept = ["conv_id", "n_windows", "o_keys"]
    stretches = window_masks(base).groupBy(*place(base), "turn", "stretch")
    held = attach(stretches.agg(F.collect_list(F.struct("term", "mask")).alias("w")), facts)
    # Masks of the key terms: found once per stretch, not once per term of it.
    masks = binding(
        F.map_from_entries("w"),
        lambda found: F.transform("names", lambda name: F.coalesce(F.element_at(found, name), F.lit(0).cast("bigint"))),
    )
    terms = held.select(*kept, "names", masks.alias("masks"), F.inline("w"))
    own = F.coalesce(F.array_position("names", F.col("term")), F.lit(0))
    counts = (
        terms.select(*kept, "masks", "term", "mask", own.alias("own"))
        .groupBy(*kept, "term")
        .agg(
            F.sum(F.bit_count("mask")).alias("o_term"),
            *[
                F.expr(f"sum(if(own = {r}, 0, bit_count(mask & masks[{r - 1}]))) AS c{r}")
                for r in range(1, n_terms + 1)
            ],
        )
    )
    total, o_term = F.col("n_windows"), F.col("o_term")

    def weight(n: Column, o_key: Column) -> Column:
        score = similarity_score(n, o_key - n, o_term - n, total - (o_key + o_term - n), total)
        return F.when(n == 0, F.lit(0.0)).otherwise(score)

    together = F.array(*[f"c{r}" for r in range(1, n_terms + 1)])
    return counts.select(
        "conv_id", "term", F.zip_with(together, F.col("o_keys"), weight).alias("weights")
    )


def _with_turns(base: DataFrame, weights: DataFrame) -> DataFrame:
    """The weights of each term next to each turn that holds it.

    The terms of a block become posting lists in place (at most one block of turns long), so a term
    that is everywhere in a huge conversation meets its weights block by block.
    """
    words = F.explode(F.array_distinct(F.flatten("sentences"))).alias("term")
    terms = in_sentences(base).select(*place(base), "turn", words)
    postings = terms.groupBy(*place(base), "term").agg(F.collect_list("turn").alias("turns"))
    met = postings.hint("merge").join(weights, ["conv_id", "term"])
    return met.select(
        "conv_id", *[c for c in weights.columns if c not in ("conv_id", "term")], F.explode("turns").alias("turn")
    )


def concept_arrays(base: DataFrame, weights: DataFrame, n_terms: int) -> DataFrame:
    """``conv_id, turn, vector``: how strongly a turn holds each key term's concept, in rank order."""
    sums = [F.expr(f"sum(weights[{r}]) AS v{r}") for r in range(n_terms)]
    wide = _with_turns(base, weights).groupBy("conv_id", "turn").agg(*sums)
    return wide.select("conv_id", "turn", F.array(*[f"v{r}" for r in range(n_terms)]).alias("vector"))


def concept_vectors(arrays: DataFrame, lists: DataFrame, *, brief: bool = False) -> DataFrame:
    """``conv_id, turn, term, value``: the concept vectors in long form; zero cells are absent."""
    named = attach(with_block(arrays, brief), lists)
    cells = F.transform(
        "key_terms", lambda k: F.struct(k["term"].alias("term"), F.col("vector")[k["rank"] - 1].alias("value"))
    )
    return named.select("conv_id", "turn", F.inline(cells)).filter("value != 0")


def concept_vectors_all(base: DataFrame, similarity: DataFrame) -> DataFrame:
    """The same with every term as a key term, from :func:`term_similarity`."""
    weights = similarity.select(
        "conv_id", F.col("term_i").alias("key"), F.col("term_j").alias("term"), "similarity"
    )
    added = _with_turns(base, weights)
    return added.groupBy("conv_id", "turn", F.col("key").alias("term")).agg(
        F.sum("similarity").alias("value")
    )


def term_overlap(base: DataFrame, lists: DataFrame) -> DataFrame:
    """``conv_id, row_turn, col_turn, n_terms``: key terms two turns share, where there are any."""
    held = attach(in_sentences(base), lists).select(
        "conv_id",
        "turn",
        F.array_intersect(F.col("key_terms.term"), F.flatten("sentences")).alias("held"),
    )
    pairs = turn_pairs(held.filter(F.size("held") > 0), ["held"], brief="block" not in base.columns)
    shared = F.size(F.array_intersect("a.held", "b.held")).cast("bigint")
    return pairs.select(
        "conv_id",
        F.col("a.turn").alias("row_turn"),
        F.col("b.turn").alias("col_turn"),
        shared.alias("n_terms"),
    ).filter("n_terms > 0")


def named_units(units: DataFrame, lists: DataFrame, *, brief: bool = False) -> DataFrame:
    """``conv_id, turn, concepts``: the unit vector of a turn as a list of ``term, x``; other columns stay."""
    kept = [c for c in units.columns if c not in ("conv_id", "turn")]
    return attach(with_block(units, brief), lists).select(
        "conv_id",
        "turn",
        *kept,
        F.transform(
            "key_terms",
            lambda k: F.struct(k["term"].alias("term"), F.col("unit")[k["rank"] - 1].alias("x")),
        ).alias("concepts"),
    )


def shared_concepts(a: str, b: str, n_concepts: int) -> Column:
    """The terms of the largest positive products of two lists of :func:`named_units`, rounded to 9 digits, then by term."""
    positive = F.filter(
        F.zip_with(
            a,
            b,
            lambda p, q: F.struct((p["x"] * q["x"]).alias("product"), p["term"].alias("term")),
        ),
        lambda c: c["product"] > 0,
    )
    ordered = F.array_sort(
        F.transform(
            positive,
            lambda c: F.struct((-F.round(c["product"], 9)).alias("minus"), c["term"].alias("term")),
        )
    )
    return F.transform(F.slice(ordered, 1, n_concepts), lambda c: c["term"])


def common_concepts(
    units: DataFrame, lists: DataFrame, n_concepts: int = 5, *, brief: bool = False
) -> DataFrame:
    """``conv_id, row_turn, col_turn, concepts``: the strongest concepts two turns share.

    Ordered by the product of the two unit-vector values, rounded to 9 digits, then by term.
    """
    pairs = turn_pairs(named_units(units, lists, brief=brief), ["concepts"], brief=brief)
    return pairs.select(
        "conv_id",
        F.col("a.turn").alias("row_turn"),
        F.col("b.turn").alias("col_turn"),
        shared_concepts("a.concepts", "b.concepts", n_concepts).alias("concepts"),
    ).filter(F.size("concepts") > 0)
