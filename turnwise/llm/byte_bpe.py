"""Byte-level BPE encoding and decoding from a file of merge ranks.

Merges go through a rank queue: a bucket per rank holds places of a linked list of tokens, and a hierarchical
bitmap over the ranks finds the least non-empty bucket by find-first-set. Places whose pair has changed
since they were put there are stale and skipped. The work grows with the number of merges, not with the square of
the length, so very long pre-tokens are no worse than short ones; many pre-tokens share one queue.

Pre-tokens repeat, so a task keeps a table of those it has seen, of bounded size.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.gather import distinct_parts, filled, gathered, shorten
from turnwise.llm.words import pieces

KNOWN = 400_000  # pre-tokens (and pieces between spaces) that a task remembers
GROUP = 1 << 17  # bytes merged in one queue
SHORT = 64  # longer pieces are not remembered

# A space with no white space on either side always begins a pre-token; what stands between two such
# spaces is encoded on its own. Where the classes of white space differ, nothing is split.
_BREAK = re.compile(r"(?<=\S) (?=\S)")


class RankQueue:
    """Places by rank, least rank first."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels = [[0] * ((ranks >> 6) + 1)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * ((len(self.levels[-1]) >> 6) + 1))

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(place)
        else:
            self.open(rank, [place])

    def open(self, rank: int, places: list[int]) -> None:
        """Begin the bucket of a rank."""
        self.buckets[rank] = places
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            known = level[word]
            level[word] = known | bit
            if known:
                break
            rank = word

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank and its places from left to right; they leave the queue."""
        place = 0
        for level in reversed(self.levels):
            word = level[place]
            if not word:
                return None
            place = place << 6 | (word & -word).bit_length() - 1
        rank = place
        for level in self.levels:
            word, bit = place >> 6, 1 << (place & 63)
            level[word] &= ~bit
            if level[word]:
                break
            place = word
        found = self.buckets.pop(rank)
        found.sort()
        return rank, found


class BytePairs:
    """A vocabulary of ranks, and the encoder and decoder it defines."""

    def __init__(self, ranks: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        self.size = max(self.rank.values(), default=0) + 1
        self.packed = {number: number.to_bytes(4, "little") for number in self.rank.values()}
        self.tokens = [b""] * self.size
        for token, number in self.rank.items():
            self.tokens[number] = token
        self.pair: dict[int, int] = {}
        for token, number in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = number
        self.first = np.array([self.rank[bytes([b])] for b in range(256)])
        self.byte_pair = np.full((256, 256), -1)  # ranks of pairs of bytes
        for token, number in self.rank.items():
            if len(token) == 2:
                self.byte_pair[token[0], token[1]] = number
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def merge(self, words: Sequence[bytes]) -> list[bytes]:
        """The packed ids of each of some pre-tokens, merged in one queue."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words])
        starts = np.concatenate(([0], ends[:-1])).tolist()
        places = np.arange(len(data))
        following, leading = places + 1, places - 1
        following[ends - 1] = -1
        leading[starts] = -1
        rank = np.append(self.byte_pair[data[:-1], data[1:]], -1)
        rank[ends - 1] = -1
        ids, after, before, rank_at = self.first[data].tolist(), following.tolist(), leading.tolist(), rank.tolist()
        queue = RankQueue(self.size)
        order = np.argsort(rank, kind="stable")
        order = order[np.searchsorted(rank[order], 0) :]
        ranks, begins = np.unique(rank[order], return_index=True)
        order = order.tolist()
        begins = begins.tolist()
        for number, begin, end in zip(ranks.tolist(), begins, [*begins[1:], len(order)]):
            queue.open(number, order[begin:end])
        pair = self.pair.get
        while (found := queue.pop()) is not None:
            rank, places = found
            for n, i in enumerate(places):
                if rank_at[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                ids[i], rank_at[i], rank_at[j], after[i] = rank, -1, -1, k
                lowest = rank
                if k >= 0:
                    before[k] = i
                    new = pair(rank << 32 | ids[k])
                    if new is not None:
                        rank_at[i] = new
                        queue.push(new, i)
                        lowest = min(lowest, new)
                h = before[i]
                if h >= 0:
                    new = pair(ids[h] << 32 | rank)
                    if new is None:
                        rank_at[h] = -1
                    elif new != rank_at[h]:
                        rank_at[h] = new
                        queue.push(new, h)
                        lowest = min(lowest, new)
                if lowest < rank:  # something more urgent came up: the other places wait
                    for other in places[n + 1 :]:
                        queue.push(rank, other)
                    break
        out = []
        packed = self.packed
        for i in starts:
            tokens = []
            while i >= 0:
                tokens.append(packed[ids[i]])
                i = after[i]
            out.append(b"".join(tokens))
        return out

    def _learn(self, pre_tokens: set[str]) -> None:
        """Encode new pre-tokens and remember them."""
        waiting: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal waiting, size
            if waiting:
                coded = self.merge([x.encode("utf-8", "surrogatepass") for x in waiting])
                self.known.update(zip(waiting, coded))
            waiting, size = [], 0

        for word in pre_tokens:
            data = word.encode("utf-8", "surrogatepass")
            whole = self.rank.get(data)
            if whole is not None:
                self.known[word] = self.packed[whole]
                continue
            waiting.append(word)
            size += len(data)
            if size >= GROUP:
                flush()
        flush()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))

    def encode(self, texts: pa.Array) -> pa.BinaryArray:
        """The ids of each text as little-endian 32-bit numbers. A null text has none."""
        shorten(self.known, KNOWN)
        shorten(self.spaced, KNOWN)
        texts = filled(texts)
        found, parts, edges = distinct_parts(pc.split_pattern(texts, " "))
        odd = {i for i, part in enumerate(found) if not part or part[0].isspace() or part[-1].isspace()}
        if odd:  # a space beside other white space: such texts are split with care
            mark = np.zeros(len(found), dtype=bool)
            mark[list(odd)] = True
            rows = np.unique(np.searchsorted(edges, np.flatnonzero(mark[parts]), side="right") - 1)
            rows = [i for i in rows.tolist() if edges[i + 1] - edges[i] > 1]
            if rows:
                careful = [_BREAK.split(texts[i].as_py()) for i in rows]
                every = pc.split_pattern(texts, " ").to_pylist()
                for i, split in zip(rows, careful):
                    every[i] = split
                found, parts, edges = distinct_parts(pa.array(every, pa.list_(pa.string())))
        # The first part of a text has no space before it: it gets a code of its own.
        heads, place = np.unique(parts[edges[:-1]], return_inverse=True)
        parts = parts.copy()
        parts[edges[:-1]] = len(found) + place
        head_texts = [found[i] for i in heads.tolist()]
        codes = list(map(self.spaced.get, found))
        used = np.zeros(len(found) + len(heads), dtype=bool)
        used[parts] = True
        missing = [i for i, code in enumerate(codes) if code is None and used[i]]
        split = [self.pattern.findall(" " + found[i]) for i in missing]
        new: set[str] = set().union(*split, *map(self.pattern.findall, head_texts))
        self._learn({word for word in new if word not in self.known})
        known = self.known.__getitem__
        for i, pre_tokens in zip(missing, split):
            codes[i] = b"".join(map(known, pre_tokens))
            if len(found[i]) <= SHORT and "\n" not in found[i]:
                self.spaced[found[i]] = codes[i]
        codes = [code or b"" for code in codes] + [self._plain(text) for text in head_texts]
        return gathered(codes, parts, edges, np.dtype("<u4"))

    def decode(self, ids: pa.BinaryArray) -> pa.BinaryArray:
        """The bytes that the packed ids of each row stand for."""
        offsets = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1] // 4
        data = ids.buffers()[2]
        parts = np.frombuffer(data, dtype="<u4")[offsets[0] : offsets[-1]] if data else np.zeros(0, dtype=np.uint32)
        return gathered(self.tokens, parts, offsets - offsets[0], np.dtype("u1"))


_LOADED: dict[tuple[int, str], BytePairs] = {}


def _loaded(ranks: bytes, pattern: str) -> BytePairs:
    """The vocabulary of this worker, made once."""
    key = (hash(ranks), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = BytePairs(ranks, pattern)
    return _LOADED[key]


def _vocabulary(docs: DataFrame, path: str):
    with open(path, "rb") as file:  # a file of the tokenizer, not of the data: read by the driver, then broadcast
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str, *, decoded: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit numbers) of every row of ``docs``.

    ``path`` names a file of ranks, ``pattern`` splits texts into pre-tokens, which are encoded one by one; there are no
    special tokens. With ``decoded`` a column ``decoded`` holds the bytes that the ids decode to.

    Null and empty texts have no tokens. Repeated rows and null ids are kept. Other columns are not looked at. Texts
    are read whole, in slices that bound the memory of a task.
    """
    ranks = _vocabulary(docs, path)
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _loaded(ranks.value, pattern)
        for batch in pieces(batches, limit=4 << 20):
            coded = pairs.encode(batch.column(1))
            count = pc.divide(pc.binary_length(coded), 4).cast(pa.int64())
            columns, names = [batch.column(0), count, coded], ["doc_id", "n_tokens", "ids"]
            if decoded:
                columns.append(pairs.decode(coded))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, pattern: str = r"\S+") -> DataFrame:
    """``doc_id``, ``decoded`` (bytes) from ``doc_id``, ``ids``. Null ids decode to no bytes."""
    ranks = _vocabulary(coded, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _loaded(ranks.value, pattern)
        for batch in batches:
            ids = pc.fill_null(batch.column(1), b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pairs.decode(ids)], ["doc_id", "decoded"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the SHA-256 of the ids and of what they decode to."""
    both = encode(docs, path, pattern, decoded=True)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
