import numpy as np
import pyarrow as pa

from turnwise.llm import blobs


def test_numbers_come_back_by_range(monkeypatch):
    monkeypatch.setattr(blobs, "ENTRIES", 5)
    draw = np.random.default_rng(0)
    keys = np.sort(draw.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2))
    place = blobs.range_of(keys, 4)
    edges = blobs.cuts(place)
    assert np.diff(edges).max() <= 5 and np.diff(edges).min() > 0
    batches = list(blobs.handed(["range", "keys"], [pa.array(place[edges[:-1]]), blobs.packed(keys, edges)], 7))
    assert max(b.num_rows for b in batches) == 7
    found: dict[int, list] = {}
    for at, rows in blobs.runs(batches, "range"):
        found.setdefault(at, []).extend(blobs.unpacked(rows.column("keys"), 0, rows.num_rows, np.uint64))
    assert list(found) == sorted(found)
    for at, some in found.items():
        assert some == list(keys[place == at])


def test_nothing_packed():
    edges = blobs.cuts(np.zeros(0, dtype=np.int64))
    assert list(edges) == [0]
    empty = blobs.packed(np.zeros(0, dtype=np.uint64), edges)
    assert len(empty) == 0 and not list(blobs.handed(["a"], [empty]))
    assert len(blobs.unpacked(pa.array([b"", None], pa.binary()), 0, 2, np.uint64)) == 0
