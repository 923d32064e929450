"""N-gram Jaccard join: documents whose sets of word shingles overlap by a given share.

Prefixes of token combinations. The tokens are shingles, in one global order from rare to frequent. If
two sets are similar, few tokens of either are missing from the other, so they share a signature within
short prefixes: a single token of the rare class, or a pair of tokens of the same frequent class, for which
the prefix is extended until the missing tokens can no longer destroy every pair. Documents that share a
signature are candidates; candidates are verified on their whole sets.

Steps, all exact:

1. ``shingle_table``: equal sets are one node, however many copies there are.
2. ``likely_nodes``: a similar document must share a good part of the shingles with the least hashes. Shingles
   are counted by hash range, with what repeats inside a batch counted before the shuffle.
3. ``signatures``: classes, extended prefixes and combinations over what is left.
4. ``verified``: candidates are compared in blocks of bounded size; only a spanning forest and the number of
   links per node leave a block.

Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from turnwise.llm.components import components
from turnwise.llm.words import U64, batch_words, mix, pieces, release, seeds
from turnwise.llm.written import FEW_ROWS, batches_of, written

EXTRA_PERCENT = 15  # of a set, looked at beyond the shortest prefix when documents are sorted out
RANGE_ROWS = 1 << 19  # shingles per hash range
BATCH_TOKENS = 1 << 20  # shingles counted at a time
SLICE = 1 << 20  # bytes of text whose shingles are made at a time
SIGNED = 1 << 14  # signatures handed over at a time
FREQUENT = 64  # a shingle in more documents than this belongs to the frequent classes
CLASS_SHARE = 0.1  # frequent classes per shingle of a set
BLOCK_TOKENS = 1 << 19
BLOCK_NODES = 1 << 10
GROWTH = 1.25  # of the sizes in a band, or 100 / percent if that is more


def need(n, percent: int):
    """The least overlap of a set of ``n`` with a similar one."""
    return -(-n * percent // 100)


def looked_at(n, percent: int):
    """How many of the least shingles of a set of ``n`` are counted."""
    return np.minimum(n, n - need(n, percent) + 1 + -(-n * EXTRA_PERCENT // 100))


def must_share(n, percent: int):
    """How many of these any similar set has too, whichever of both is larger."""
    least = need(n, percent)
    return looked_at(least, percent) - (least - need(least, percent))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, edges = batch_words(texts)
    factor = seeds(words + 1, 101)
    sets = []
    if len(hashes) >= words:
        size = len(hashes) - words + 1
        joined = hashes[:size] * factor[0]
        for k in range(1, words):
            joined = joined + hashes[k : k + size] * factor[k]
        joined = mix(joined)
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if stop - start >= words:
            sets.append(np.unique(joined[start : stop - words + 1]))
        elif stop > start:
            few = hashes[start:stop] * factor[: stop - start]
            length = factor[words:] * U64(stop - start)
            sets.append(mix(few.sum(dtype=U64, keepdims=True) + length))
        else:
            sets.append(np.zeros(0, dtype=U64))
    return sets


def set_key(tokens: np.ndarray) -> int:
    """The identity of a set, as a signed 64-bit number."""
    total = mix(tokens + U64(1)).sum(dtype=U64, keepdims=True)
    odd = np.bitwise_xor.reduce(mix(tokens ^ U64(0x5851F42D4C957F2D)), keepdims=True)
    value = mix(total * U64(3) + odd + U64(len(tokens)))
    return int(value.view(np.int64)[0])


def shingle_table(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``n_shingles`` and the key of the set of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=SLICE):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([set_key(x) for x in sets], pa.int64()),
                ],
                ["doc_id", "n_shingles", "key"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_shingles long, key long")


def with_set_key(docs: DataFrame, column: str, size: str, words: int = 5) -> DataFrame:
    """``docs`` with the key of the shingle set of each row and its size, as two columns that must not be there yet."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text=names[at], limit=SLICE):
            sets = shingle_sets(batch.column(at).to_pylist(), words)
            more = [pa.array([set_key(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, column, size])

    schema = StructType([*docs.schema.fields]).add(column, LongType()).add(size, LongType())
    return docs.mapInArrow(run, schema)


_COUNTED = "part int, one binary, keys binary, many binary, local_keys binary, local_counts binary"


def _blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _counted_batch(sets: list[np.ndarray], keys: np.ndarray, bits: int, percent: int) -> list[tuple]:
    """The looked-at shingles of a batch by hash range; what occurs in two of its sets is settled here."""
    own: dict[int, np.ndarray] = {}
    for key, tokens in zip(keys.tolist(), sets):
        if len(tokens):
            own[key] = tokens[: looked_at(len(tokens), percent)]
    if not own:
        return []
    ids = np.fromiter(own, dtype=np.int64, count=len(own))
    sizes = np.array([len(x) for x in own.values()])
    tokens = np.concatenate(list(own.values()))
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    fresh = np.concatenate(([True], tokens[1:] != tokens[:-1]))
    times = np.diff(np.append(np.flatnonzero(fresh), len(tokens)))
    alone = np.repeat(times == 1, times)
    local = np.bincount(owner[~alone], minlength=len(ids))
    part = (tokens >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), dtype=np.int64)
    low = ((tokens << U64(bits)) >> U64(32)).astype(np.uint32)
    first_many = fresh & ~alone
    parts = 1 << bits
    cut_one = np.searchsorted(part[alone], np.arange(parts + 1))
    cut_many = np.searchsorted(part[first_many], np.arange(parts + 1))
    one, one_keys, many = low[alone], ids[owner[alone]], low[first_many]
    with_local = np.flatnonzero(local)
    home = ids[with_local] & (parts - 1)
    sort = np.argsort(home, kind="stable")
    cut_home = np.searchsorted(home[sort], np.arange(parts + 1))
    home_keys, home_counts = ids[with_local][sort], local[with_local][sort]
    rows = []
    for p in range(parts):
        a, b = slice(cut_one[p], cut_one[p + 1]), slice(cut_many[p], cut_many[p + 1])
        c = slice(cut_home[p], cut_home[p + 1])
        if a.start == a.stop and b.start == b.stop and c.start == c.stop:
            continue
        rows.append((p, _blob(one[a]), _blob(one_keys[a]), _blob(many[b]), _blob(home_keys[c]), _blob(home_counts[c])))
    return rows


def _counted_range(table: pa.Table) -> pa.Table:
    """A row for every shingle of a range that a set shares with another, and the counts made before the shuffle."""

    def all_of(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(name)])

    tokens, keys, many = all_of("one", np.uint32), all_of("keys", np.int64), np.unique(all_of("many", np.uint32))
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    if len(tokens):
        new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])))
        tokens, keys = tokens[new], keys[new]
        fresh = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        times = np.diff(np.append(np.flatnonzero(fresh), len(tokens)))
        shared = np.repeat(times > 1, times) | np.isin(tokens, many)
        keys = keys[shared]
    counts = np.ones(len(keys), dtype=np.int64)
    keys = np.concatenate((keys, all_of("local_keys", np.int64)))
    counts = np.concatenate((counts, all_of("local_counts", np.int64)))
    return pa.table({"key": pa.array(keys), "shared": pa.array(counts)})


def likely_nodes(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The nodes that share enough of their least shingles with other nodes to have a link.

    The counts are never too small, so no link is lost; the few that are too large are sorted out later.
    """
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(2, math.ceil(math.log2(max(1, total * (100 - percent + EXTRA_PERCENT) / 100 / RANGE_ROWS))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("part", pa.int32())]
            + [(n, pa.binary()) for n in ("one", "keys", "many", "local_keys", "local_counts")]
        )
        sets: list[np.ndarray] = []
        size = 0

        def rows() -> pa.RecordBatch:
            keys = np.array([set_key(x) for x in sets], dtype=np.int64)
            found = _counted_batch(sets, keys, bits, percent)
            columns = list(zip(*found)) if found else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

        for batch in pieces(batches, text="text", limit=SLICE):
            for tokens in shingle_sets(batch.column(0).to_pylist(), words):
                sets.append(tokens)
                size += len(tokens)
            if size > BATCH_TOKENS:
                yield rows()
                sets, size = [], 0
        if sets:
            yield rows()

    blobs = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, _COUNTED)
    counts = blobs.groupBy("part").applyInArrow(_counted_range, "key long, shared long")
    total_shared = counts.groupBy("key").agg(F.sum("shared").alias("shared"))
    least = _must_share_column(F.col("n_shingles"), percent)
    return nodes.join(total_shared, "key").where(F.col("shared") >= least).drop("shared")


def _must_share_column(n, percent: int):
    """``must_share`` as a column."""

    def up(x, by):
        return F.floor((x * by + 99) / 100)

    least = up(n, percent)
    extra = F.least(least, least - up(least, percent) + 1 + up(least, EXTRA_PERCENT))
    return extra - (least - up(least, percent))


def node_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The whole sets of some nodes: ``key``, ``n_shingles``, ``tokens``. Texts are shuffled compressed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=SLICE // 4):  # of compressed text
            texts = [None if x is None else zlib.decompress(x).decode() for x in batch.column(1).to_pylist()]
            sets = shingle_sets(texts, words)
            keys = [set_key(x) for x in sets]
            right = [i for i, (a, b) in enumerate(zip(keys, batch.column(0).to_pylist())) if a == b]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i in right], pa.int64()),
                    pa.array([len(sets[i]) for i in right], pa.int64()),
                    pa.array([sets[i].view(np.int64) for i in right], pa.list_(pa.int64())),
                ],
                ["key", "n_shingles", "tokens"],
            )

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text="text", limit=SLICE):
            texts = [None if x is None else zlib.compress(x.encode(), 1) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])

    wanted = nodes.select(F.col("first_id").alias("doc_id"), "key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = wanted.join(texts.mapInArrow(pack, "doc_id long, text binary"), "doc_id").select("key", "text")
    sets = found.mapInArrow(run, "key long, n_shingles long, tokens array<long>")
    return sets.groupBy("key").agg(F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))


def set_signatures(n: int, counts: np.ndarray, tokens: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of one set from its shared tokens, ordered from rare to frequent.

    A similar set lacks at most ``n - need(n)`` of the tokens. A single rare token falls with one missing
    token, the pairs of a class of ``c`` prefix tokens with ``c - 1``; the prefix is extended until more would have
    to be missing.
    """
    remaining = n - need(n, percent) + 1 - (n - len(tokens))
    if remaining <= 0:
        return np.zeros(0, dtype=U64)
    rare = int(np.searchsorted(counts, FREQUENT, side="right"))
    singles = tokens[: min(rare, remaining)]
    found = [mix(singles)]
    remaining -= len(singles)
    if remaining > 0:
        often = tokens[rare:]
        growth = max(GROWTH, 100 / percent)  # similar sets lie at most one band apart
        band = int(math.log(n) / math.log(growth))
        for label in (band, band + 1):
            classes = max(1, int(growth**label * CLASS_SHARE))
            kind = (often >> U64(7)) % U64(classes)
            seen = np.zeros(len(often), dtype=bool)
            seen[np.unique(kind, return_index=True)[1]] = True
            stop = int(np.searchsorted(np.cumsum(~seen), remaining)) + 1
            order = np.lexsort((often[:stop], kind[:stop]))
            group, member = kind[:stop][order], often[:stop][order]
            for gap in range(1, len(member)):
                same = group[gap:] == group[:-gap]
                if not same.any():
                    break
                pair = member[:-gap][same] * U64(0x9E3779B97F4A7C15) + mix(member[gap:][same]) + U64(label)
                found.append(mix(pair))
    return np.unique(np.concatenate(found))


def signatures(sets: DataFrame, percent: int) -> DataFrame:
    """``key``, ``signature`` for every node that can still have a link."""
    each = sets.select("key", "n_shingles", F.explode("tokens").alias("token"))
    times = each.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    shared = each.join(times, "token").groupBy("key", "n_shingles")
    listed = shared.agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("shared"))
    least = F.floor((F.col("n_shingles") * percent + 99) / 100)
    kept = listed.where(F.size("shared") >= least).select(
        "key", "n_shingles", F.col("shared.times").alias("times"), F.col("shared.token").alias("tokens")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            signed = np.concatenate([found for _, found in held]).view(np.int64)
            owner = np.repeat([key for key, _ in held], [len(found) for _, found in held])
            return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(signed)], ["key", "signature"])

        n = 0
        for batch in batches:
            keys, sizes, times, tokens = batch.columns
            for i in range(batch.num_rows):
                found = set_signatures(
                    sizes[i].as_py(),
                    times[i].values.to_numpy(),
                    tokens[i].values.to_numpy().view(U64),
                    percent,
                )
                held.append((keys[i].as_py(), found))
                n += len(found)
                if n >= SIGNED:
                    yield rows()
                    held, n = [], 0
        if held:
            yield rows()
        release()

    return kept.mapInArrow(run, "key long, signature long")


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """The links inside a block, or between the two sides of a pair of blocks; none if a side is empty."""
    side = table.column("side").to_numpy()
    inner = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    if not inner and (side == side[0]).all():
        return pa.table({name: pa.array([], pa.int64()) for name in ("a", "b", "links")})
    keys = table.column("key").to_numpy()
    copies = table.column("copies").to_numpy()
    lists = [x.values.to_numpy() for x in table.column("tokens")]
    sizes = np.array([len(x) for x in lists])
    ids = np.unique(np.concatenate(lists), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flag = np.zeros(int(ids.max()) + 1, dtype=np.int32)
    links = np.zeros(len(keys), dtype=np.int64)
    root = np.arange(len(keys))
    a, b = [], []
    for i in np.flatnonzero(side == side.min()).tolist():
        mine = ids[starts[i] : starts[i] + sizes[i]]
        flag[mine] = 1
        both = np.add.reduceat(flag[ids], starts)
        flag[mine] = 0
        linked = 100 * both >= percent * (sizes + sizes[i] - both)
        linked &= (np.arange(len(keys)) > i) if inner else (side != side[i])
        others = np.flatnonzero(linked)
        if not len(others):
            continue
        links[i] += copies[others].sum()
        links[others] += copies[i]
        roots = np.unique(np.append(root[others], root[i]))
        for other in roots[1:].tolist():
            a.append(keys[roots[0]])
            b.append(keys[other])
        root[np.isin(root, roots[1:])] = roots[0]
    some = np.flatnonzero(links)
    return pa.table(
        {
            "a": pa.array(np.concatenate((np.array(a, dtype=np.int64), keys[some]))),
            "b": pa.array(np.concatenate((np.array(b, dtype=np.int64), keys[some]))),
            "links": pa.array(np.concatenate((np.zeros(len(a), dtype=np.int64), links[some]))),
        }
    )


def verified(sets: DataFrame, nodes: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Compare the nodes of each group of candidates (``node``, ``root``).

    A group beyond a block is dealt into blocks by hash and every pair of blocks is a task of its own.
    Rows with ``a < b`` or ``a > b`` span the linked nodes; rows with ``a = b`` hold numbers of links.
    """
    member = candidates.select(F.col("node").alias("key"), "root")
    member = member.join(nodes.select("key", "n_shingles", "copies"), "key")
    blocks = member.groupBy("root").agg(
        F.ceil(F.greatest(F.sum("n_shingles") / BLOCK_TOKENS, F.count("*") / BLOCK_NODES)).alias("blocks")
    )
    placed = member.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    dealt = placed.select(
        "root", "key", "copies", "own", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other")
    )
    spread = dealt.select(
        "root",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "key",
        "copies",
    )
    filled = spread.join(sets.select("key", "tokens"), "key")
    return filled.groupBy("root", "i", "j").applyInArrow(
        lambda table: _compare(table, percent), "a long, b long, links long"
    )


def _linked(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows, the nodes and the links between nodes (see :func:`verified`), all written: no later step needs Python."""
    table = written(shingle_table(docs, words), "shingles")
    nodes = table.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles")
    )
    nodes = written(nodes, "nodes")
    likely = likely_nodes(docs, nodes.where("n_shingles > 1 AND first_id IS NOT NULL"), words, percent)
    sets = written(node_sets(docs, likely, words), "sets")
    signed = written(signatures(sets, percent), "signatures")
    least = signed.groupBy("signature").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    met = signed.join(least.where("least < most"), "signature").where("key > least")
    candidates = written(components(met.select(F.col("key").alias("a"), F.col("least").alias("b"))), "candidates")
    found = written(verified(sets, nodes, candidates, percent), "links")
    return table, nodes, found


def ngram_jaccard_join(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """Group the documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not looked at. Words are runs of characters other
    than ASCII white space, A to Z lower-cased; a text of fewer than ``words`` words is one shingle. Returns one row
    per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the least ``doc_id`` that links lead to, its own
    included), ``n_links`` (linked rows, copies included), ``set_key`` (equal sets) and ``class_key`` (sets that links connect).

    Null and empty texts have no shingles and no links. Repeated rows are copies of each other and link. A null
    ``doc_id`` takes part through rows with the same set and an id only; alone it has a null component. An empty
    table gives an empty result.
    """
    with batches_of(docs.sparkSession, FEW_ROWS):
        table, nodes, found = _linked(docs, words, percent)
    linked = components(found.where("a <> b").select("a", "b"))
    named = linked.join(nodes.select(F.col("key").alias("node"), "first_id"), "node")
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = linked.join(first, "root").select(F.col("node").alias("key"), "component_id", "root")
    counts = found.where("a = b").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    classes = (
        nodes.join(component, "key", "left")
        .join(counts, "key", "left")
        .select(
            "key",
            F.coalesce("component_id", "first_id").alias("component_id"),
            F.coalesce("root", "key").alias("class_key"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    classes = written(classes, "classes")
    full = table.where("n_shingles > 0").join(classes, "key")
    alone = [F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")]
    empty = table.where("n_shingles = 0").select("doc_id", "n_shingles", *alone, "key", F.col("key").alias("class_key"))
    every = full.select(*empty.columns).union(empty)
    return every.withColumnRenamed("key", "set_key")
