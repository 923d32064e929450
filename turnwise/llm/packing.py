"""Mixture-controlled packing: deficit round-robin over the sources.

Every source is a queue of packets, parts of its documents of bounded length. In each round a source is given its
share of a window as credit and sends packets as long as its credit lasts; what is left is carried to the next
round. A packet therefore leaves in the round in which the credit of its source reaches the end of the packet:
``ceil(end * total / (total of source * window))``, with the shares of the sources in the whole input as targets, so that
all queues run dry together. That needs the running total of a source only, not the rounds before, so all rounds
are planned at once: deficits are carried across windows and partitions by arithmetic. The packets of all
rounds in a row are cut into windows of the sequence length, without gaps.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator, Sequence
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from turnwise.llm.gather import Codes, binary, coded, distinct, filled, joined, listed, shorten
from turnwise.llm.words import pieces
from turnwise.llm.written import written
from turnwise.operators.ordering import running_totals

WINDOW = 2048
PACKET = 128
END_ID = 1
SLICE = 4 << 20  # bytes of text encoded at a time
KNOWN = 500_000  # words that a task remembers
TAIL = ".,;:!?$%&*#()[]{}+-=/_~^@\"\\`"  # signs that a tokenizer parts from the letters before them
TOGETHER = 1000  # new words encoded as one text
SPECIAL = "<|"  # may begin a special token, which is told from text by its case


class WordEncoder:
    """Token ids of texts, word by word.

    For a tokenizer that splits at white space, lower-cases, and splits letters or digits from other signs, so
    that words, and a word and the signs after it, are encoded on their own. Words repeat; those seen are kept.
    """

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(definition)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.ends = self._word_ends()
        self.bare = self._bare(definition)

    def _learn(self, words: Sequence[str]) -> None:
        """Encode new words: those of letters many at a time, as one text, which costs half as much."""
        plain, letters, alone = [], [], []
        for word in words:
            if self.ends is None or not word.lower().isalpha():
                alone.append(word)
            elif self.bare is not None and word.isascii() and word.islower():
                letters.append(word)
            else:
                plain.append(word)
        for tokenizer, several in ((self.tokenizer, plain), (self.bare, letters)):
            for at in range(0, len(several), TOGETHER):
                some = several[at : at + TOGETHER]
                if not self._learn_together(tokenizer, some):
                    alone += some
        coded = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
        for word, each in zip(alone, coded):
            self.known[word] = np.array(each.ids, dtype=self.kind).tobytes()

    def _bare(self, definition: bytes) -> Tokenizer | None:
        """The tokenizer without what is done to a text before it is encoded, if that leaves a to z as they are."""
        bare = Tokenizer.from_buffer(definition)
        bare.normalizer, bare.pre_tokenizer = None, WhitespaceSplit()
        pairs = [" ".join(a + b for a in ascii_lowercase for b in ascii_lowercase)]
        ids = [x.encode_batch_fast(pairs, add_special_tokens=False)[0].ids for x in (self.tokenizer, bare)]
        return bare if ids[0] == ids[1] else None

    def _learn_together(self, tokenizer: Tokenizer, words: list[str]) -> bool:
        """A word of letters is one pre-token, with one id that ends it; unless there are as many as words, nothing is learned."""
        coded = tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(coded[0].ids, dtype=self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return False
        data, start = ids.tobytes(), 0
        for word, end in zip(words, (ends * self.kind.itemsize).tolist()):
            self.known[word] = data[start:end]
            start = end
        return True

    def _word_ends(self) -> np.ndarray | None:
        """Which ids end a word, where the tokenizer marks that."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        size = self.tokenizer.get_vocab_size()
        ends = np.fromiter((self.tokenizer.id_to_token(i).endswith(suffix) for i in range(size)), dtype=bool, count=size)
        return ends

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.BinaryArray:
        """The ids of each text, as packed numbers of ``kind``; ``end`` follows the ids of every text."""
        shorten(self.known, KNOWN)
        texts = filled(texts)
        special = pc.match_substring(texts, SPECIAL)
        words = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        found, parts, edges = distinct(words)
        cores, tails = (side.dictionary_encode() for side in _parted(found))
        known = self.known
        names = listed(cores.dictionary) + listed(tails.dictionary)
        codes = list(map(known.get, names))
        missing = [i for i, code in enumerate(codes) if code is None]
        self._learn(list({names[i] for i in missing}))
        for i in missing:
            codes[i] = known[names[i]]
        # Every distinct word is a core and a tail; what follows a text is one more word.
        sides = np.stack((cores.indices.to_numpy(), tails.indices.to_numpy() + np.int32(len(cores.dictionary))), axis=1)
        sides, bounds = sides.ravel(), 2 * np.arange(len(found) + 1)
        if end is not None:
            codes.append(np.array([end], dtype=self.kind).tobytes())
            sides, bounds = np.append(sides, len(names)), np.append(bounds, 2 * len(found) + 1)
            parts = np.insert(parts, edges[1:], len(found))
            edges = edges + np.arange(len(edges))
        return binary(joined(joined(coded(codes, self.kind), sides, bounds), parts, edges))


def _parted(words: pa.StringArray) -> tuple[pa.Array, pa.Array]:
    """Each word without the signs at its end, and these signs, where a tokenizer encodes the two apart; else the word and nothing."""
    core = pc.ascii_rtrim(words, characters=TAIL)
    last = pc.utf8_slice_codeunits(core, -1).dictionary_encode()
    # A capital sigma may be lowered by what follows it, and some capitals leave a mark behind the letter.
    apart = [c != "" and c != "\u03a3" and c.lower()[-1].isalnum() for c in last.dictionary.to_pylist()]
    core = pc.if_else(pa.array(np.array(apart, dtype=bool)[last.indices.to_numpy()]), core, words)
    lengths = pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy()
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[words.offset + 1 : words.offset + len(words) + 1]
    whole = Codes(np.frombuffer(data or b"", dtype=np.uint8), ends - lengths, lengths)
    tails = joined(whole, np.arange(len(words)), np.arange(len(words) + 1))
    return core, binary(tails).cast(pa.string())


_LOADED: dict[int, WordEncoder] = {}


def _loaded(definition: bytes) -> WordEncoder:
    key = hash(definition)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordEncoder(definition)
    return _LOADED[key]


def token_table(docs: DataFrame, path: str, *, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``source``, ``ids`` (packed, ``end_id`` last) and ``n`` (their number) of every row."""
    with open(path, "rb") as file:  # the tokenizer, not data: read by the driver, then broadcast
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(shared.value)
        size = encoder.kind.itemsize
        for batch in pieces(batches, limit=SLICE):
            coded = encoder.encode(batch.column(2), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    coded,
                    pc.divide(pc.binary_length(coded), size).cast(pa.int64()),
                ],
                ["doc_id", "source", "ids", "n"],
            )

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.col("text").cast("string").alias("text")
    )
    return plain.mapInArrow(run, "doc_id long, source string, ids binary, n long")


def planned(rows: DataFrame, *, window: int = WINDOW, packet: int = PACKET) -> DataFrame:
    """Where everything goes: ``row_id``, ``start``, ``length``, ``sequence_id``, ``offset`` of every part of every row.

    ``rows`` has ``row_id``, ``doc_id``, ``source`` and ``n``. The queue of a source is in order of ``doc_id``.
    """
    queued = rows.select(
        "row_id",
        F.coalesce(F.col("doc_id"), F.lit(-1)).alias("place"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue"),
        "n",
    )
    totals = queued.groupBy("queue").agg(F.sum("n").alias("source_total"))
    total = totals.agg(F.sum("source_total")).first()[0] or 1
    based = running_totals(queued, ["queue"], "place", {"base": F.col("n")}, ties=("row_id",), levels=2)
    firsts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(packet).cast("long"))
    packets = based.join(totals, "queue").select(
        "row_id", "queue", "base", "n", "source_total", F.explode(firsts).alias("start")
    )
    packets = packets.withColumn("length", F.least(F.lit(packet).cast("long"), F.col("n") - F.col("start")))
    wide = "decimal(18,0)"
    credit = F.col("source_total").cast(wide) * F.lit(window).cast(wide)
    asked = (F.col("base") + F.col("start") + F.col("length")).cast(wide) * F.lit(total).cast(wide)
    packets = packets.select(
        "row_id", "queue", "start", "length", (F.col("base") + F.col("start")).alias("position"),
        asked.alias("asked"), credit.alias("credit"),
    ).withColumn("round", F.expr("cast((asked + credit - 1) div credit as bigint)"))
    packets = written(packets.drop("asked", "credit"), "packets")
    rounds = packets.groupBy("round").agg(F.sum("length").alias("sent"))
    begun = running_totals(rounds, [], "round", {"begin": F.col("sent")}, levels=2).select("round", "begin")
    inside = Window.partitionBy("round").orderBy("queue", "position").rowsBetween(Window.unboundedPreceding, -1)
    placed = packets.withColumn("before", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(begun, "round")
    # A packet is cut where a window ends.
    at = F.col("begin") + F.col("before")
    room = F.lit(window) - at % window
    head = F.struct(F.lit(0).cast("long").alias("skip"), F.least("length", room).alias("size"))
    rest = F.struct(room.alias("skip"), (F.col("length") - room).alias("size"))
    parts = F.when(F.col("length") > room, F.array(head, rest)).otherwise(F.array(head))
    cut = placed.select("row_id", "start", at.alias("at"), F.explode(parts).alias("part"))
    first = F.col("at") + F.col("part.skip")
    return cut.select(
        "row_id",
        (F.col("start") + F.col("part.skip")).alias("start"),
        F.col("part.size").alias("length"),
        F.floor(first / window).cast("long").alias("sequence_id"),
        (first % window).alias("offset"),
    )


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids and checksums of the parts of each row; parts that touch in a sequence become one."""
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "source": pa.string()}
    for batch in batches:
        columns: list[list] = [[] for _ in kinds]
        doc_ids, sources, blobs, sizes, lists = batch.columns
        for i in range(batch.num_rows):
            n, blob = sizes[i].as_py(), blobs[i].as_buffer()
            ids = np.frombuffer(blob, dtype="<u2" if len(blob) == 2 * n else "<u4")
            part = lists[i].values
            start, length, sequence, offset = (part.field(k).to_numpy() for k in range(4))
            new = np.append(True, (sequence[1:] != sequence[:-1]) | (offset[1:] != offset[:-1] + length[:-1]))
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(start)) - 1
            doc_id, source = doc_ids[i].as_py(), sources[i].as_py()
            for b, e in zip(begins.tolist(), ends.tolist()):
                first, last = int(start[b]), int(start[e] + length[e])
                crc = zlib.crc32(ids[first:last].astype("<u4").tobytes())
                row = (doc_id, first, last - first, crc, n, int(sequence[b]), int(offset[b]), source)
                for column, value in zip(columns, row):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def pack(docs: DataFrame, path: str, *, window: int = WINDOW, packet: int = PACKET, end_id: int = END_ID) -> DataFrame:
    """Pack the tokens of all rows into sequences of ``window`` tokens in the proportions of the sources.

    ``path`` is the definition of a word tokenizer (see ``WordEncoder``); the ids of a row are those of its text, without
    special tokens, and ``end_id``. Returns one row per piece: ``doc_id``, ``start`` (ids of the row before it), ``length``, ``ids_crc32``
    (of the ids as little-endian 32-bit numbers), ``doc_tokens``, ``sequence_id``, ``offset``, ``source``. Only the last sequence is not
    full. Pieces are parts of packets of ``packet`` ids, joined where they touch.

    Null and empty texts are one id. A null source is a queue of its own, a null ``doc_id`` comes first in its queue.
    Repeated rows are packed each. Columns other than ``doc_id``, ``text``, ``source`` are not looked at; without ``source`` there is one
    queue. An empty table gives an empty result.
    """
    tokens = token_table(docs, path, end_id=end_id).withColumn("row_id", F.monotonically_increasing_id())
    tokens = written(tokens, "tokens")  # row_id is fixed from here on
    plan = planned(tokens.select("row_id", "doc_id", "source", "n"), window=window, packet=packet)
    parts = plan.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("parts")
    )
    joined = tokens.join(parts, "row_id").select("doc_id", "source", "ids", "n", "parts")
    return joined.mapInArrow(
        _cut,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string",
    )
