"""Keyword in context (KWIC): search, contexts, sorting, paging, chunks that cross line borders.

The search itself is a projection: no shuffle, one pass over the texts, work linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions.keywords import automaton_of
from turnwise.functions.keywords import available as keyword_automaton
from turnwise.functions.patterns import SearchPattern
from turnwise.functions.text import binding, strip_spaces, strip_tags
from turnwise.operators.hits import found_rows, searched, searched_all
from turnwise.operators.ordering import block_of
from turnwise.session import cut_lineage

SORTS = ("text_id", "left_context", "right_context")
HIT = (
    T.StructType()
    .add("match_no", "long")
    .add("left_context", "string")
    .add("match", "string")
    .add("right_context", "string")
)
_FAR = 2**31 - 1
_STRIDE = 64


def _tail(text: Column, width: int) -> Column:
    return F.right(text, F.lit(width))


def _head(text: Column, width: int) -> Column:
    return F.substring(text, 1, width)


def _slice(items: Column, start: Column, length: Column) -> Column:
    return F.slice(items, start.cast("int"), length.cast("int"))


def _joined(pieces: Column, start: Column, length: Column) -> Column:
    return F.array_join(_slice(pieces, start, length), "")


def _characters(pieces: Column, start: Column, n: Column) -> Column:
    """Characters in ``n`` pieces from position ``start``, counted from 0."""
    return F.aggregate(
        _slice(pieces, start + 1, n), F.lit(0).cast("bigint"), lambda a, p: a + F.length(p)
    )


def _marks(pieces: Column) -> Column:
    """Characters before every ``_STRIDE``-th piece, so that an offset needs few additions."""
    strides = F.sequence(F.lit(0), F.floor(F.size(pieces) / _STRIDE).cast("int"))
    sizes = F.transform(strides, lambda b: _characters(pieces, b * _STRIDE, F.lit(_STRIDE)))
    return binding(
        sizes,
        lambda known: F.transform(
            known,
            lambda _, b: F.aggregate(
                _slice(known, F.lit(1), b), F.lit(0).cast("bigint"), lambda a, n: a + n
            ),
        ),
    )


def _offset(pieces: Column, marks: Column, n: Column) -> Column:
    """Characters in the first ``n`` pieces."""
    rest = n % _STRIDE
    return marks[F.floor(n / _STRIDE).cast("int")] + _characters(pieces, n - rest, rest)


def _hits(text: Column, pattern: SearchPattern, width: int, offsets: bool) -> Column:
    """All matches of one text as an array of structs.

    The text is cut at the matches into ``pieces``: what precedes the first match, then every match
    with the text up to the next. A context needs its neighbouring piece only, or, where that is
    shorter than the window, the pieces around it: at most ``width`` of them, as no piece is empty.
    """

    def contexts(parts: Column) -> Column:
        found, pieces = parts["found"], parts["pieces"]

        def hit(match: Column, i: Column) -> Column:
            before = pieces[i]
            left = F.when(F.length(before) >= width, _tail(before, width)).otherwise(
                _tail(
                    _joined(
                        pieces,
                        F.greatest(i - width, F.lit(0)) + 1,
                        F.least(i, F.lit(width)) + 1,
                    ),
                    width,
                )
            )
            after = F.substring(pieces[i + 1], F.length(match) + 1, F.lit(_FAR))
            right = F.when(F.length(after) >= width, _head(after, width)).otherwise(
                _head(F.concat(after, _joined(pieces, i + 3, F.lit(width))), width)
            )
            fields = [
                i.cast("bigint").alias("match_no"),
                left.alias("left_context"),
                match.alias("match"),
                right.alias("right_context"),
            ]
            if offsets:
                fields.append(_offset(pieces, parts["marks"], i + 1).alias("start"))
            return F.struct(*fields)

        return F.transform(found, hit)

    found = F.regexp_extract_all(text, F.lit(pattern.java), F.lit(0))
    between = F.split(text, pattern.java, -1)

    def pieces(parts: Column) -> Column:
        follow = F.slice(parts["between"], F.lit(2), F.size(parts["found"]))
        return F.struct(
            parts["found"].alias("found"),
            F.concat(
                F.array(parts["between"][0]), F.zip_with(parts["found"], follow, lambda m, rest: F.concat(m, rest))
            ).alias("pieces"),
        )

    def marked(parts: Column) -> Column:
        return F.struct(parts["found"], parts["pieces"], _marks(parts["pieces"]).alias("marks"))

    def build(parts: Column) -> Column:
        if offsets:
            return binding(pieces(parts), lambda p: binding(marked(p), contexts))
        return binding(pieces(parts), contexts)

    return binding(F.struct(found.alias("found"), between.alias("between")), build)


def _python_count(pattern: SearchPattern):
    source, flags = pattern.python, pattern.flags

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: 0 if t is None else sum(1 for _ in re.finditer(source, t, flags)))

    return count


def may_match(text: Column, pattern: SearchPattern) -> Column:
    """A cheap test that keeps every text with a match; a plain ``contains`` reaches the scan."""
    if not pattern.in_jvm:
        return text.isNotNull()
    if not pattern.regex and not pattern.ignore_case:
        return F.contains(text, F.lit(pattern.keyword))
    return F.rlike(text, F.lit(pattern.java))


def _crowded(pattern: SearchPattern) -> bool:
    """Do matches stand so close that a context is put together from many pieces? Python cuts it from the text at once."""
    return not pattern.regex and not pattern.whole_word and len(pattern.keyword) <= 2


def search(
    df: DataFrame,
    keyword: str,
    *,
    regex: bool = False,
    ignore_case: bool = True,
    whole_word: bool = False,
    window_width: int = 50,
    columns: Sequence[str] = ("text_id",),
    text: str = "text",
    offsets: bool = False,
) -> DataFrame:
    """All matches with their contexts: ``columns, match_no, left_context, match, right_context``.

    One row per non-overlapping match; ``match_no`` counts the matches of a text from 0. With
    ``offsets`` a ``start`` column holds the position of the match in the text. Works on a
    streaming DataFrame too.
    """
    if window_width < 0:
        raise ValueError("window_width must not be negative")
    pattern = SearchPattern(keyword, regex, ignore_case, whole_word)
    hits = df.filter(may_match(F.col(text), pattern))
    if _crowded(pattern):
        hits, text = hits.withColumn("__valid", F.make_valid_utf8(F.col(text))), "__valid"
    if not pattern.in_jvm or _crowded(pattern):
        return found_rows(hits, columns, text, searched(pattern.compiled), window_width, offsets=offsets)
    return hits.select(*columns, F.inline(_hits(F.col(text), pattern, window_width, offsets)))


def count_matches(
    df: DataFrame,
    keyword: str,
    *,
    regex: bool = False,
    ignore_case: bool = True,
    whole_word: bool = False,
    columns: Sequence[str] = ("text_id",),
    text: str = "text",
) -> DataFrame:
    """Number of matches per text, for the texts that have one. Contexts are never built."""
    pattern = SearchPattern(keyword, regex, ignore_case, whole_word)
    if pattern.in_jvm:
        number = F.regexp_count(F.col(text), F.lit(pattern.java))
    else:
        number = _python_count(pattern)(F.col(text))
    counted = df.filter(may_match(F.col(text), pattern)).select(
        *columns, number.cast("bigint").alias("n_matches")
    )
    return counted.filter(F.col("n_matches") > 0)


def total_matches(counts: DataFrame, results_per_page: int = 20) -> DataFrame:
    """One row: number of results and of pages (at least one) from :func:`count_matches`."""
    total = F.coalesce(F.sum("n_matches"), F.lit(0)).cast("bigint")
    pages = F.greatest(F.ceil(total / F.lit(results_per_page)), F.lit(1)).cast("bigint")
    return counts.agg(total.alias("n_results"), pages.alias("n_pages"))


def search_many(
    df: DataFrame,
    keywords: Sequence[str],
    *,
    window_width: int = 50,
    columns: Sequence[str] = ("text_id",),
    **options: bool,
) -> DataFrame:
    """:func:`search` for several keywords, with a ``keyword`` column.

    All literal keywords are found by one automaton that passes over a text once, however many there are. Regular
    expressions are searched one by one, each a projection of the same row, in the texts that hold one of them; those that
    only Python reads share one pass of their own.
    """
    name = options.pop("text", "text")
    text = F.col(name)
    patterns = [SearchPattern(k, **options) for k in dict.fromkeys(keywords)]
    if not patterns:
        raise ValueError("no keywords given")
    if window_width < 0:
        raise ValueError("window_width must not be negative")
    if not patterns[0].regex and keyword_automaton():
        known = automaton_of(patterns)
        return found_rows(df, columns, name, known.numbered, window_width, keywords=known.keywords)
    inner = [p for p in patterns if p.in_jvm]
    outer = [p for p in patterns if not p.in_jvm]
    if outer:
        words = [p.keyword for p in outer]
        spans = searched_all([p.compiled for p in outer])
        by_python = found_rows(df.filter(text.isNotNull()), columns, name, spans, window_width, keywords=words)
        if not inner:
            return by_python
    hits = F.array(
        *[
            F.struct(
                F.lit(p.keyword).alias("keyword"),
                F.when(may_match(text, p), _hits(text, p, window_width, False)).alias("hits"),
            )
            for p in inner
        ]
    )
    found = df.filter(reduce(Column.__or__, [may_match(text, p) for p in inner]))
    by_spark = found.select(*columns, F.inline(hits)).select(*columns, "keyword", F.inline("hits"))
    return by_spark.union(by_python) if outer else by_spark


def sort_keys(by: str, ties: Sequence[str] = ("text_id", "match_no")) -> list[Column]:
    """Sort columns for a concordance: by text, or by the words next to the match."""
    if by not in SORTS:
        raise ValueError(f"invalid sort {by!r}: should be one of {SORTS}")
    if by == "text_id":
        return [F.col(t) for t in ties]
    cleaned = F.lower(strip_spaces(F.col(by)))
    key = F.reverse(F.split(cleaned, r"(?U)\s")) if by == "left_context" else cleaned
    return [key, *[F.col(t) for t in ties]]


def sort_results(
    results: DataFrame, by: str = "text_id", ties: Sequence[str] = ("text_id", "match_no")
) -> DataFrame:
    """Sort matches by text, by left context (nearest word first) or by right context.

    The key is computed once per match and sorted as a column; written into the sort it would be
    computed at every comparison.
    """
    first, *rest = sort_keys(by, ties)
    if by == "text_id":
        return results.orderBy(first, *rest)
    return results.withColumn("__key", first).orderBy("__key", *rest).drop("__key")


# Rows from the start up to which a page is a plain top-k, and to which a far page's range is narrowed.
NEAR_ROWS = 10_000
# Splitters per pass over the keys of a far page.
SPLITTERS = 16


def result_page(
    results: DataFrame,
    page: int = 1,
    results_per_page: int = 20,
    by: str = "text_id",
    ties: Sequence[str] = ("text_id", "match_no"),
) -> DataFrame:
    """One page of the sorted results. A near page is a top-k; a far one costs a few counts more, never a full sort.

    For a far page the keys are written down. Sampled splitters cut them into ranges, counts tell in which range the page starts,
    and the range is cut again until it is small: only that range is sorted, and no task holds the rows before it. Rows
    that agree in the sort key and ``ties`` go by their other columns.
    """
    if page < 1:
        raise ValueError("pages count from 1")
    skipped = (page - 1) * results_per_page
    first, *rest = sort_keys(by, ties)
    keyed = results.withColumn("__key", first)
    if skipped + results_per_page <= NEAR_ROWS:
        return keyed.orderBy("__key", *rest).offset(skipped).limit(results_per_page).drop("__key")
    others = [c for c in results.columns if c not in ties]
    order = F.struct("__key", *ties, *[F.col(f"`{c}`") for c in others])
    # The order holds all columns: nothing is written twice.
    rows = cut_lineage(keyed.select(order.alias("__order")))
    found = _page_at(rows, skipped, results_per_page)
    return found.select(*[F.col("__order")[c].alias(c) for c in results.columns])


def _literal(value, kind: T.DataType) -> Column:
    """A value that was read from a row, as a literal of its type."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def _page_at(rows: DataFrame, skipped: int, length: int) -> DataFrame:
    """``length`` rows from position ``skipped`` on in the order of the column ``__order``."""
    kind = rows.schema["__order"].dataType
    order = F.col("__order")
    inside, start, last = rows, 0, None  # the rows from position ``start`` on, before ``last``, in which the page begins
    size = rows.count()
    while size > NEAR_ROWS and skipped < start + size:
        fraction = min(1.0, 16 * SPLITTERS / size)
        drawn = sorted_sample(inside.select("__order").sample(fraction, seed=size), 64 * SPLITTERS)
        if not drawn:
            drawn = [inside.select("__order").first()["__order"]]
        step = -(-len(drawn) // SPLITTERS)
        splitters = [_literal(v, kind) for v in drawn[::step]]
        counts = inside.agg(
            *[F.count_if(order < s).alias(f"l{i}") for i, s in enumerate(splitters)],
            *[F.count_if(order <= s).alias(f"u{i}") for i, s in enumerate(splitters)],
        ).first()
        below = [counts[f"l{i}"] for i in range(len(splitters))]
        upto = [counts[f"u{i}"] for i in range(len(splitters))]
        wanted = skipped - start
        at = max((i for i in range(len(splitters)) if below[i] <= wanted), default=None)
        if at is not None and wanted < upto[at]:  # the page starts among equal rows
            equal = min(length, upto[at] - wanted)
            found = rows.filter(order == splitters[at]).limit(equal)
            if equal < length:
                found = found.unionByName(rows.filter(order > splitters[at]).orderBy(order).limit(length - equal))
            return found.orderBy(order)
        following = next((i for i in range(len(splitters)) if below[i] > wanted), None)
        end = size if following is None else below[following]
        first = 0 if at is None else upto[at]
        if at is not None:
            inside = inside.filter(order > splitters[at])
        if following is not None:
            inside = inside.filter(order < splitters[following])
        if end - first < size:  # the next passes read only this range
            inside = cut_lineage(inside)
        start, size = start + first, end - first
        last = last if following is None else splitters[following]
    found = inside.orderBy(order).offset(skipped - start).limit(length)
    if last is None or skipped + length <= start + size:
        return found
    # The page runs over the end of the range: the rest is the least of what follows.
    following = rows.filter(order >= last).orderBy(order).limit(skipped + length - start - size)
    return found.unionByName(following).orderBy(order)


def sorted_sample(keys: DataFrame, most: int) -> list:
    """At most ``most`` keys of a small sample, in order."""
    return [r["__order"] for r in keys.limit(most).orderBy("__order").collect()]


def numbered_results(
    results: DataFrame, by: str = "text_id", ties: Sequence[str] = ("text_id", "match_no"), *, name: str = "position"
) -> DataFrame:
    """The sorted results with their position, from 0.

    The sort cuts the rows into ranges; their sizes give every range its first position. The number of ranges is that of
    the shuffle's partitions, so the table of sizes is small.
    """
    first, *rest = sort_keys(by, ties)
    ordered = results.withColumn("__key", first).orderBy("__key", *rest).drop("__key")
    written = cut_lineage(ordered.withColumn("__id", F.monotonically_increasing_id()))
    placed = written.withColumns(
        {"__range": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("n"))
    starts = sizes.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    numbered = placed.join(F.broadcast(starts), "__range")
    return numbered.withColumn(name, F.col("__start") + F.col("__at")).drop("__id", "__range", "__at", "__start")


# ---------------------------------------------------------------- chunks of tagged lines


def search_chunks(
    rows: DataFrame,
    keyword: str,
    *,
    chunk_column: str = "chunk",
    keys: Sequence[str] = (),
    metadata: Sequence[str] | None = None,
    window_width: int = 50,
    sort: str | None = None,
    tag_lines: bool = False,
    clean: bool = False,
    whole_rows: bool = False,
    **options: bool,
) -> DataFrame:
    """Search whole chunks, so that contexts cross line borders, and name the row of each match.

    ``rows`` has ``row``, ``text`` and the chunk column (see ``operators.prepare``). Lines are tagged
    ``row--`` and joined without separator; the tags count towards the window and are removed from
    the result unless ``tag_lines``. With ``clean`` the untagged text is searched instead.
    ``row`` is the line in which the match starts. ``metadata`` adds columns of that line, carried along with
    it. With ``whole_rows`` every row is a chunk of its own, and nothing is grouped.
    """
    keys = list(keys)
    pattern = SearchPattern(keyword, **options)
    if window_width < 0:
        raise ValueError("window_width must not be negative")
    plain = F.col("text") if clean else F.concat(F.col("row").cast("string"), F.lit("--"), "text")
    carried = [c for c in dict.fromkeys(metadata or ()) if c not in {*keys, "row"}]
    line = F.struct(F.col("row").cast("bigint").alias("row"), plain.alias("line"), *[F.col(f"`{c}`") for c in carried])
    if whole_rows:
        chunks = rows.select(*keys, chunk_column, F.array(line).alias("lines"))
    else:
        chunks = rows.groupBy(*keys, chunk_column).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    # The lines without their text, and where each starts: both once per chunk.
    sources = F.transform("lines", lambda x: F.struct(x["row"].alias("row"), *[x[c].alias(c) for c in carried]))
    sizes = F.transform("lines", lambda x: F.coalesce(F.length(x["line"]), F.lit(0)))
    prepared = chunks.select(
        *keys,
        chunk_column,
        F.array_join(F.col("lines.line"), "").alias("text"),
        sources.alias("__sources"),
        _running(sizes).alias("__starts"),
    )
    hits = prepared.filter(may_match(F.col("text"), pattern))
    cells = F.transform(
        _hits(F.col("text"), pattern, window_width, True),
        lambda hit: binding(
            F.col("__sources")[_last_start(F.col("__starts"), hit["start"])],
            lambda source: F.struct(
                *[hit[n].alias(n) for n in (*HIT.names, "start")],
                source["row"].alias("row"),
                *[source[c].alias(c) for c in carried],
            ),
        ),
    )
    # Only the matches pass the generator: neither text nor lines are copied to them. The array is written inside it:
    # as a column it would be computed a second time, in the filter that Spark derives for generators.
    if pattern.in_jvm:
        hits = hits.select(*keys, chunk_column, F.inline(cells))
    else:
        placed = [*keys, chunk_column]
        found = found_rows(
            hits, placed, "text", searched(pattern.compiled), window_width, offsets=True, lines=("__sources", "__starts")
        )
        hits = found.select(*placed, *HIT.names, "start", "__source.row", *[F.col("__source")[c].alias(c) for c in carried])
    if "text_id" not in hits.columns:
        hits = hits.withColumn("text_id", F.col("row"))
    if sort is not None:
        hits = sort_results(hits, sort, ties=(*keys, "text_id", chunk_column, "match_no"))
    return hits if tag_lines or clean else remove_tags(hits)


def _running(sizes: Column) -> Column:
    """The sum of the numbers before each number, and of all: from sums of blocks, so that no long array is grown
    one by one."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(sizes) / _STRIDE).cast("int"))

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, n: a + n)

    def placed(known: Column) -> Column:
        sums = F.transform(blocks, lambda b: total(_slice(known, b * _STRIDE + 1, F.lit(_STRIDE))))
        return binding(
            F.struct(known.alias("known"), sums.alias("sums")),
            lambda s: F.transform(
                s["known"],
                lambda _, i: total(_slice(s["sums"], F.lit(1), F.floor(i / _STRIDE)))
                + total(_slice(s["known"], F.floor(i / _STRIDE) * _STRIDE + 1, i % _STRIDE)),
            ),
        )

    return binding(sizes, placed)


def _last_start(starts: Column, at: Column) -> Column:
    """Index of the last start that is not beyond ``at``, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts).cast("double"))).cast("int"))
    halved = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("low"), F.size(starts).alias("high")),
        lambda s, _: binding(
            F.floor((s["low"] + s["high"]) / 2).cast("int"),
            lambda middle: F.when(
                (middle > s["low"]) & (starts[middle] <= at), F.struct(middle.alias("low"), s["high"].alias("high"))
            ).otherwise(F.struct(s["low"].alias("low"), F.greatest(middle, s["low"] + 1).alias("high"))),
        ),
    )
    return halved["low"]


def add_metadata(
    hits: DataFrame, rows: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ()
) -> DataFrame:
    """Join columns of the source row to the matches; rows are de-duplicated first."""
    wanted = [c for c in dict.fromkeys(columns) if c not in {*keys, "row"}]
    info = rows.select(*keys, "row", *wanted).dropDuplicates()
    return hits.join(info, [*keys, "row"], "left")


def remove_tags(results: DataFrame) -> DataFrame:
    """Strip row tags from the contexts, and from the text where it is part of the result."""
    for column in ("left_context", "right_context", "text"):
        if column in results.columns:
            results = results.withColumn(column, strip_tags(F.col(column)))
    return results


# ---------------------------------------------------------------- lines around a word


# Bits that tell which lines stand near a hit: at most 2**20 numbers of 64 bits are broadcast.
LINE_BITS = 1 << 26


def _near_hits(lines: DataFrame, hits: DataFrame, reach: int, keys: Sequence[str], order: str) -> DataFrame:
    """The lines within ``reach`` of a hit, and a few others that share a bit with one."""
    place = F.pmod(F.xxhash64(*keys, order), F.lit(LINE_BITS))
    word, bit = F.expr("__place div 64"), F.expr("cast(__place % 64 as int)")
    near = hits.select(*keys, F.explode(F.sequence(F.col(order) - reach, F.col(order) + reach)).alias(order))
    marks = near.select(place.alias("__place")).groupBy(word.alias("__word"))
    marks = marks.agg(F.bit_or(F.expr("shiftleft(1L, cast(__place % 64 as int))")).alias("__bits"))
    placed = lines.withColumn("__place", place).withColumn("__word", word)
    met = placed.join(F.broadcast(marks), "__word").filter(F.call_function("getbit", "__bits", bit) == 1)
    return met.drop("__place", "__word", "__bits")


def line_context(
    lines: DataFrame,
    word: str,
    context_length: int = 10,
    *,
    keys: Sequence[str] = (),
    order: str = "line_no",
    text: str = "text",
    width: int = 4096,
) -> DataFrame:
    """Lines containing a word, with the lines before and after: ``order, before, line, after``.

    Lines are numbered densely by ``order``. The hits are found in a first scan, and only lines near one leave the second:
    a bitmap of the hashed places of the lines that are wanted, at most 8 MB, goes to every executor. These lines are
    put together in blocks; each borrows ``context_length`` lines from its neighbours, so a source of any size
    is searched in blocks, and a word that is nowhere moves no line.
    """
    width = max(width, context_length)
    known = lines.select(*keys, F.col(order).cast("bigint").alias(order), F.col(text).alias("line"))
    holds = F.contains("line", F.lit(word))
    known = _near_hits(known, known.filter(holds), context_length, keys, order)
    near = F.lit(context_length)
    at = F.expr(f"cast(`{order}` % {width} as int)")
    block = block_of(order, width)
    homes = F.array_compact(
        F.array(
            block,
            F.when(at < near, block - 1),
            F.when(at >= F.lit(width) - near, block + 1),
        )
    )
    spread = known.select(*keys, order, "line", block.alias("__own"), F.explode(homes).alias("__block"))
    window = Window.partitionBy(*keys, "__block").orderBy(order)
    before = F.collect_list("line").over(window.rangeBetween(-context_length, -1))
    after = F.collect_list("line").over(window.rangeBetween(1, context_length))
    if context_length == 0:
        before = after = F.array().cast("array<string>")
    return (
        spread.withColumn("before", before)
        .withColumn("after", after)
        .filter((F.col("__own") == F.col("__block")) & holds)
        .select(*keys, order, "before", "line", "after")
    )
