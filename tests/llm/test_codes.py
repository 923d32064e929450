import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import clashing, random_text, rows
from turnwise.llm import byte_bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "a\x1cb \x1c c", "it's I'll", "é́", "日本 語", "\u200b x",
    "x\x85y \xa0z", "<|endoftext|> <|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ İ K", "1234 5.6", "…!! ##", "a" * 3000, "\x00", "👍🏽 ok",
]


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pairs():
    return byte_bpe.BytePairs(open(RANKS, "rb").read(), public_tokenizers.PATTERN)


def mixed(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choices(ODD + ["the", "ing", " "], k=draw.randint(0, 12))) for _ in range(n)]


def test_byte_pairs_equal_the_library(pairs, encoding):
    texts = ODD + mixed(1, 400) + [random_text(2, 500)]
    coded = pairs.encode(pa.array(texts))
    for text, ids in zip(texts, coded.to_pylist()):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text)
    assert pairs.decode(coded).to_pylist() == [t.encode() for t in texts]


def test_words_equal_the_library():
    encoder = packing.WordEncoder(open(WORDS, "rb").read())
    library = Tokenizer.from_file(WORDS)
    signs = ["Σ", "ΑΣ.", "İ", "İ.", "ß%%%", "it's", "'s", "$5", "x_y", "½", "²,", "ǅ", "ﬁ.", "e\u0301", "\u0301", "ŉ.", "<|", "'", "ª)"]
    draw = random.Random(8)
    parts = ODD + signs + ["the", "ing", " ", "é", "."]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(4000)]
    texts += [" ".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(2000)]
    for start in range(0, len(texts), 1500):
        some = texts[start : start + 1500]
        ids = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(pa.array(some)).to_pylist()]
        assert ids == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]


def test_very_long_pre_tokens(pairs, encoding):
    draw = random.Random(3)
    text = "".join(draw.choices("abcdefgh", k=20_000))
    ids = pairs.encode(pa.array([text]))[0].as_py()
    assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text)
    many = pairs.encode(pa.array(["ab" * 300_000]))
    assert pairs.decode(many)[0].as_py() == b"ab" * 300_000


def test_rank_queue_gives_the_least_rank_first():
    draw = random.Random(4)
    queue = byte_bpe.RankQueue(60_000)
    pushed = [(draw.randrange(60_000), place) for place in range(3000)]
    for rank, place in pushed:
        queue.push(rank, place)
    found = []
    while (item := queue.pop()) is not None:
        found += [(item[0], place) for place in item[1]]
    assert found == sorted(pushed)


def test_round_trip(documents, encoding):
    given = [(i, t) for i, t in enumerate([*ODD, None])] + [(None, "x y"), (0, "")]
    found = byte_bpe.round_trip_digests(clashing(documents(given)), RANKS, public_tokenizers.PATTERN)
    want = []
    for i, text in given:
        ids = np.array(encoding.encode_ordinary(text or ""), dtype="<u4")
        digest = hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        want.append((i, len(ids), *digest))
    assert rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert byte_bpe.round_trip_digests(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_decode_alone(documents):
    coded = byte_bpe.encode(documents(["a b", None]), RANKS, public_tokenizers.PATTERN)
    assert rows(byte_bpe.decode(coded, RANKS), "doc_id", "decoded") == [(0, bytearray(b"a b")), (1, bytearray())]


def test_words_equal_the_library():
    tokenizer = Tokenizer.from_file(WORDS)
    encoder = packing.WordEncoder(open(WORDS, "rb").read())
    texts = ODD + mixed(5, 400)
    for text, ids in zip(texts, encoder.encode(pa.array(texts)).to_pylist()):
        assert np.frombuffer(ids, encoder.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_and_the_signs_after_them_are_kept_apart():
    library = Tokenizer.from_file(WORDS)
    encoder = packing.WordEncoder(open(WORDS, "rb").read())
    texts = ["zebra.%%% Zebra, zebra", "zebra.%%%", "\u0391\u03a3. \u0130. na\u00efve.,", "...", "", None, " \t", "<|x|>.", "it's. 42!"]
    texts += [" ".join(f"{a}{b}{c}" for b in "xyz") for a in ["ab", "ABC", "\u00e9t\u00e9", "9"] for c in ["", ".", "?!", "'", "\u00df;"]]
    ids = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(pa.array(texts), 1).to_pylist()]
    assert ids == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert "zebra" in encoder.known and not any("zebra" in w for w in encoder.known if w != "zebra")
    assert encoder.bare is not None
    for none in ([], [None], [""]):
        assert encoder.encode(pa.array(none, pa.string())).to_pylist() == [b""] * len(none)


def check_packing(given, found, window):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for _, t in given]
    filled = {}
    for p in sorted(found, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        filled[p["sequence_id"]] = p["offset"] + p["length"]
    total = sum(map(len, ids))
    assert sorted(filled) == list(range(len(filled))) and len(filled) == -(-total // window)
    assert all(n == window for s, n in filled.items() if s < len(filled) - 1)
    seen = {}
    for p in found:
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    for doc in {i for i, _ in given}:
        own = [x for (i, _), x in zip(given, ids) if i == doc]
        assert sum(n for _, n, _, _ in seen[doc]) == sum(map(len, own))
        for start, length, crc, n in seen[doc]:
            assert any(len(x) == n and zlib.crc32(x[start : start + length].tobytes()) == crc for x in own)
        if len(own) == 1:
            parts = sorted(seen[doc])
            assert [s for s, *_ in parts] == np.cumsum([0] + [n for _, n, _, _ in parts])[:-1].tolist()


def test_packing(documents):
    given = [(i, random_text(i, 5 + 37 * (i % 9))) for i in range(40)]
    given += [(100, None), (101, ""), (None, "no id"), (7, given[7][1]), (102, random_text(1, 3000))]
    docs = clashing(documents(given, source=lambda i: None if i == 3 else "hot" if i % 2 else f"s{i % 5}"))
    found = packing.pack(docs, WORDS, window=256, packet=64).collect()
    check_packing(given, found, 256)
    assert packing.pack(documents([]), WORDS).count() == 0


def test_windows_hold_the_sources_in_proportion(documents):
    given = [(i, random_text(i, 300)) for i in range(120)]
    docs = documents(given, source=lambda i: "a" if i < 80 else "b")
    found = packing.pack(docs, WORDS, window=2048, packet=64)
    held = {}
    for p in found.collect():
        held.setdefault(p["sequence_id"], {}).setdefault(p["source"], 0)
        held[p["sequence_id"]][p["source"]] += p["length"]
    for s in range(len(held) - 1):
        assert abs(held[s]["a"] / 2048 - 2 / 3) < 0.07
    check_packing(given, packing.pack(docs.drop("source"), WORDS, window=512).collect(), 512)
