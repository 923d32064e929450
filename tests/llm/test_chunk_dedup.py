import numpy as np

from tests.llm.conftest import clashing, random_text, rows
from turnwise.llm import chunk_dedup as cd


def test_chunks_cover_every_text_and_end_between_characters():
    texts = [random_text(1, 300), "ab", "a" * 5000, "é" * 700, "日本語" * 400, " \n" * 50, "x"]
    for text in texts:
        starts, lengths, digests = cd.text_chunks(text)
        assert starts[0] == 0 and (starts[1:] == starts[:-1] + lengths[:-1]).all()
        assert starts[-1] + lengths[-1] == len(text) and (lengths > 0).all()
        assert lengths.max() <= cd.MAX_CHUNK + 3
        pieces = [text[s : s + n] for s, n in zip(starts, lengths)]
        known = {}
        assert all(known.setdefault(p, d) == d for p, d in zip(pieces, digests))
        assert len(set(digests.tolist())) == len(set(pieces))
    assert all(len(x) == 0 for x in cd.text_chunks(None)) and all(len(x) == 0 for x in cd.text_chunks(""))


def test_gear_rolls():
    data = np.frombuffer(random_text(2, 50).encode(), dtype=np.uint8)
    value, want = 0, []
    for b in data.tolist():
        value = ((value << 1) + int(cd._GEAR[b])) & 0xFFFF
        want.append(value)
    assert cd.gear(data).tolist() == want


def test_an_insertion_moves_few_cuts():
    text = random_text(3, 2000)
    moved = text[:100] + "inserted words " + text[100:]
    a, b = (set(cd.text_chunks(t)[2].tolist()) for t in (text, moved))
    assert len(a - b) < 8


def test_repeated_passages_are_found_and_cut(documents):
    passages = [random_text(100 + k, 60, 50_000) for k in range(20)]
    texts = []
    for k in range(60):
        body = random_text(k, 150, 50_000)
        texts.append(body if k % 3 else body[:300] + " " + passages[k // 3] + " " + body[300:])
        if k % 3 == 1:
            texts[-1] = passages[k // 3] + " " + body
    docs = clashing(documents(texts))
    spans = cd.repeated_spans(docs)
    found = rows(spans, "doc_id", "start", "length", "first_doc_id")
    assert {r[0] for r in found} == {k for k in range(60) if k % 3 == 1}  # the second holder of each passage
    for doc, start, length, first in found:
        part = texts[doc][start : start + length]
        assert first == doc - 1 and part in texts[first] and length >= cd.MIN_CHARS
    out = {r["doc_id"]: r for r in cd.remove_spans(docs, spans).collect()}
    assert len(out) == 60
    for k, text in enumerate(texts):
        cut = text
        for doc, start, length, _ in sorted(found, key=lambda r: -r[1]):
            if doc == k:
                cut = cut[:start] + cut[start + length :]
        assert out[k]["text"] == cut and out[k]["n_chars"] == len(cut)


def test_odd_rows(documents):
    text = random_text(7, 60, 50_000)
    docs = documents([(1, text), (1, text), (2, text), (None, text + " end"), (3, None), (4, ""), (5, "short")])
    spans = cd.repeated_spans(docs)
    found = rows(spans, "doc_id", "first_doc_id")
    assert {r[0] for r in found} == {1, 2} and {r[1] for r in found} == {None}
    assert cd.remove_spans(docs, spans).count() == 7
    empty = documents([])
    assert cd.repeated_spans(empty).count() == 0 and cd.remove_spans(empty, cd.repeated_spans(empty)).count() == 0


def test_repeats_inside_one_text(documents):
    line = random_text(8, 40, 50_000)
    docs = documents([line + "\n" + line + "\n" + line])
    out = cd.remove_spans(docs, cd.repeated_spans(docs)).first()["text"]
    assert len(line) <= len(out) < 1.7 * len(line)
