"""Divergence of the sources of a language: every pair of sources, and the terms that set a source apart.

The triangular discrimination ``(p - q)**2 / (p + q)`` is summed over the kept terms of a language, in whole numbers. Sources
are the rows and terms the columns of a sparse matrix of shares. As in Gustavson's product of sparse matrices,
each row goes through its terms, finds in the term-major index the peers that have the term, and adds to one dense
accumulator per peer; a pair of postings is never a row. A term that a source does not have still has a small share
there (smoothing), the same for all such terms, its baseline. So the accumulator starts with each side's terms
held against the other's baseline, and the terms that both have are corrected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.words import pieces
from turnwise.llm.written import written
from turnwise.operators.ordering import top_rows

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
PRIOR = 2

SLICE = 8 << 20  # bytes of text counted at a time
BLOCK = 256  # sources per block, about
CELL = 1 << 16  # postings of a block in a cell, about
LEVELS = 1 << 12  # distinct shares held against the baselines at a time
SALTS = 256  # copies of the facts of a language where its terms look them up

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(BETWEEN)

COUNTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
)
SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _counted(groups: pa.StructArray, texts: pa.StringArray) -> pa.RecordBatch:
    """Occurrences and documents of the terms of each group in some texts; a null term for the group itself."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    coded = lists.flatten().dictionary_encode()
    codes, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    row = pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(terms, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, dtype=bool)
    codes, row = codes[full], row[full]
    names = [g.dictionary_encode() for g in (groups.field("lang"), groups.field("source"))]
    pair = names[0].indices.to_numpy().astype(np.int64) * len(names[1].dictionary) + names[1].indices.to_numpy()
    known, group = np.unique(pair, return_inverse=True)
    width = max(len(terms), 1)
    occurring, n = np.unique(group[row] * width + codes, return_counts=True)
    once = np.unique(row * np.int64(width) + codes)
    _, docs = np.unique(group[once // width] * width + once % width, return_counts=True)
    which = np.concatenate([occurring // width, np.arange(len(known))])
    marks = np.zeros(len(known), dtype=np.int64)
    term = pa.concat_arrays([terms.take(pa.array(occurring % width)), pa.nulls(len(known), pa.string())])
    lang, source = known[which] // len(names[1].dictionary), known[which] % len(names[1].dictionary)
    return pa.record_batch(
        [
            names[0].dictionary.take(pa.array(lang)),
            names[1].dictionary.take(pa.array(source)),
            term,
            pa.array(np.concatenate([n, marks])),
            pa.array(np.concatenate([docs, marks])),
        ],
        schema=COUNTS,
    )


def _parts(text: str) -> Iterator[str]:
    """A long text in parts cut between terms."""
    start = 0
    while len(text) - start > SLICE:
        gap = _BETWEEN.search(text, start + SLICE)
        end = gap.end() if gap else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def _counted_long(lang: str, source: str, text: str) -> pa.RecordBatch:
    """The same for one text that is longer than a slice."""
    n: Counter[str] = Counter()
    for part in _parts(text):
        counts = pc.value_counts(pc.split_pattern_regex(pc.ascii_lower(pa.array([part])), BETWEEN).flatten())
        n.update(dict(zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist())))
    n.pop("", None)
    size = len(n)
    columns = [[lang] * (size + 1), [source] * (size + 1), [*n, None], [*n.values(), 0], [1] * size + [0]]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, COUNTS)], schema=COUNTS)


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in pieces(batches, limit=SLICE):
        texts = rows.column("text")
        if len(rows) == 1 and pc.binary_length(texts)[0].as_py() > SLICE:
            yield _counted_long(rows["lang"][0].as_py(), rows["source"][0].as_py(), texts[0].as_py())
        else:
            yield _counted(pa.StructArray.from_arrays([rows["lang"], rows["source"]], ["lang", "source"]), texts)


def term_counts(documents: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents with the term; a null term stands for the group."""
    texts = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kind = "lang string, source string, term string, n bigint, docs bigint"
    partial = texts.mapInArrow(_count_terms, kind)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: str) -> Column:
    """``1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms))`` in decimals, exact at any count."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(PRIOR)).cast("decimal(20,0)")
    whole = F.call_function("div", top, (F.col(total) + F.lit(PRIOR) * F.col("terms")).cast("decimal(20,0)"))
    return F.when(F.col("terms") > 0, F.lit(1).cast("bigint") + whole)


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)**2 / (p + q))``; shares are at most 10**9 + 1, so squares fit."""
    return (p - q) * (p - q) // (p + q)


class _Side:
    """The sources of one block in a cell, and the postings they have there, by source and by term."""

    def __init__(self, rows: pa.Table, terms: pa.Array) -> None:
        info = rows.filter(pc.is_null(rows["term"]))
        self.sources = info["source"].combine_chunks()
        self.base = pc.fill_null(info["p"], 1).to_numpy()
        self.had = info["had"].to_numpy()
        self.terms = info["terms"].to_numpy()
        postings = rows.filter(pc.is_valid(rows["term"]))
        self.p = postings["p"].to_numpy()
        self.source = pc.index_in(postings["source"], value_set=self.sources).to_numpy()
        self.term = pc.index_in(postings["term"], value_set=terms).to_numpy()
        by_term = np.argsort(self.term, kind="stable")
        self.peer, self.share = self.source[by_term], self.p[by_term]
        self.start = np.zeros(len(terms) + 1, dtype=np.int64)
        np.cumsum(np.bincount(self.term, minlength=len(terms)), out=self.start[1:])

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Terms and shares of each source that has any."""
        order = np.argsort(self.source, kind="stable")
        edges = np.searchsorted(self.source[order], np.arange(len(self.sources) + 1))
        for i in range(len(self.sources)):
            mine = order[edges[i] : edges[i + 1]]
            if len(mine):
                yield i, self.term[mine], self.p[mine]

    def against(self, base: np.ndarray) -> np.ndarray:
        """Per source, the terms it has here held against the baselines of others."""
        out = np.zeros((len(self.sources), len(base)), dtype=np.int64)
        for i, _, shares in self.rows():
            level, times = np.unique(shares, return_counts=True)
            for at in range(0, len(level), LEVELS):
                part = slice(at, at + LEVELS)
                out[i] += (_differ(level[part, None], base[None, :]) * times[part, None]).sum(axis=0)
        return out


def _accumulated(one: _Side, other: _Side, first: bool) -> np.ndarray:
    """Dense sums of every source of one block with every peer of the other over the terms of a cell."""
    sums = one.against(other.base) + other.against(one.base).T
    if first:  # terms that neither has, once per pair
        absent = one.terms[:, None] - one.had[:, None] - other.had[None, :]
        sums += absent * _differ(one.base[:, None], other.base[None, :])
    for i, terms, shares in one.rows():
        start = other.start[terms]
        length = other.start[terms + 1] - start
        total = int(length.sum())
        if not total:
            continue
        at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)
        peer, q, p = other.peer[at], other.share[at], np.repeat(shares, length)
        mine, theirs = one.base[i], other.base[peer]
        np.add.at(sums[i], peer, _differ(p, q) - _differ(p, theirs) - _differ(mine, q) + _differ(mine, theirs))
    return sums


def _cell_sums(cell: pa.Table) -> pa.Table:
    lang, first = cell["lang"][0].as_py(), cell["bucket"][0].as_py() == 0
    terms = pc.unique(cell["term"].drop_null())
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    one = _Side(cell.filter(pc.equal(cell["side"], 0)), terms)
    own = cell["i"][0].as_py() == cell["j"][0].as_py()
    other = one if own else _Side(cell.filter(pc.equal(cell["side"], 1)), terms)
    sums = np.where((one.terms > 0)[:, None], _accumulated(one, other, first), 0)
    a, b = np.nonzero(~np.eye(len(one.sources), dtype=bool)) if own else (
        np.repeat(np.arange(len(one.sources)), len(other.sources)),
        np.tile(np.arange(len(other.sources)), len(one.sources)),
    )
    left, right = one.sources.take(pa.array(a)), other.sources.take(pa.array(b))
    values = pa.array(sums[a, b], pa.int64())
    langs = pa.array([lang] * len(a), pa.string())
    out = [pa.table([langs, left, right, values], schema=SUMS)]
    if not own:
        out.append(pa.table([langs, right, left, values], schema=SUMS))
    return pa.concat_tables(out)


def _paired(rows: DataFrame) -> DataFrame:
    """Rows copied to the pairs of blocks of their language; the lower block is side 0."""
    met = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return met.select(
        "lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "bucket",
        (F.col("block") > F.col("other")).cast("int").alias("side"), "source", "term", "p", "had", "terms",
    )


def source_divergence(
    documents: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """Peers and outstanding terms of every source: ``lang, source, part, item, value, rank``.

    A term is a run of letters (A to Z count as a to z) or signs beyond ASCII; a language keeps those in at least
    ``least_documents`` of its rows. ``part`` is ``pair`` (item: another source of the language, all of them) or ``term`` (item:
    a term more frequent in the source than in the language, the first ``top_terms``). Ranks go by value, then by item.

    Null texts, languages and sources count as empty strings, repeated rows as many times as they stand. A source without
    terms is compared by its baseline; a language without kept terms gives pairs of value 0 and no term. Other columns are
    ignored, whatever their names. An empty table gives an empty one.

    Texts are read once, counted per task, and not shuffled. Postings meet in cells: a pair of blocks of sources and a
    bucket of terms, both numbers by the size of the language, so a hot source or language is many cells. The pairs are
    the result, so their number is quadratic in the sources of a language; nothing else is.
    """
    counts = written(term_counts(documents), "term_counts")
    frequent = (
        counts.where("term IS NOT NULL")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.count("*").alias("sources"))
        .where(F.col("docs") >= least_documents)
        .drop("docs")
    )
    frequent = written(frequent, "frequent_terms")
    groups = counts.select("lang", "source").distinct()
    sizes = frequent.groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("n").alias("lang_total"), F.sum("sources").alias("postings")
    )
    langs = groups.groupBy("lang").agg(F.count("*").alias("members")).join(sizes, "lang", "left")
    langs = langs.fillna(0, ["terms", "lang_total", "postings"])
    langs = langs.withColumn("blocks", F.expr(f"(members + {BLOCK - 1}) div {BLOCK}"))
    langs = langs.withColumn("buckets", F.expr(f"greatest(1L, postings div (blocks * {CELL}L))"))
    langs = written(langs.drop("members", "postings"), "languages")

    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS))
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    of_lang = (
        frequent.withColumn("salt", salt)
        .join(salted, ["lang", "salt"])
        .withColumn("q", _share(F.col("n"), "lang_total"))
        .withColumn("bucket", F.pmod(F.xxhash64("term", F.lit(1)), F.col("buckets")))
        .select("lang", "term", "q", "bucket")
    )
    entries = counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(of_lang, ["lang", "term"])
    entries = written(entries, "postings")

    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("had"))
    infos = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total", "had"]).join(langs, "lang")
    infos = infos.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    infos = infos.withColumn("bucket", F.explode(F.expr("sequence(0L, buckets - 1)")))
    infos = written(infos.select("lang", "source", "bucket", "block", "blocks", "total", "had", "terms"), "sources")
    placed = entries.join(infos, ["lang", "source", "bucket"]).withColumn("p", _share(F.col("n"), "total"))
    placed = written(placed, "placed")

    over = F.expr("(p - q) * (p - q) div (p + q)")
    ahead = placed.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), over.alias("value"))
    best = top_rows(ahead, ["lang", "source"], [F.desc("value"), F.asc("item")], top_terms)

    marks = infos.withColumns({"term": F.lit(None).cast("string"), "p": _share(F.lit(0).cast("bigint"), "total")})
    columns = ["lang", "source", "bucket", "block", "blocks", "had", "terms", "term", "p"]
    cells = _paired(placed.select(columns)).unionByName(_paired(marks.select(columns)))
    kind = "lang string, source string, item string, value bigint"
    sums = cells.groupBy("lang", "i", "j", "bucket").applyInArrow(_cell_sums, kind)
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    wanted = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair")).select(wanted)
        .unionByName(best.withColumn("part", F.lit("term")).select(wanted))
    )


def source_divergence_sql(least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> str:
    """The rows of :func:`source_divergence` over the table ``documents``, for DuckDB."""
    return rf"""
    WITH d AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
    k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= {least_documents}),
    v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM k GROUP BY ALL),
    q AS (SELECT lang, term, (1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (total + {PRIOR} * v))::BIGINT AS q FROM k JOIN v USING (lang)),
    g AS (SELECT DISTINCT lang, source FROM d),
    dense AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
        FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    t AS (SELECT lang, source, sum(n)::BIGINT AS total FROM dense GROUP BY ALL),
    p AS (
        SELECT lang, source, term, n, (1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (t.total + {PRIOR} * v))::BIGINT AS p
        FROM dense JOIN t USING (lang, source) JOIN v USING (lang)),
    summed AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (
        SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
        FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top_terms}"""
