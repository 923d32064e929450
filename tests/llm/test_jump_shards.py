import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import clashing, rows
from turnwise.llm import jump_shards
from turnwise.llm.jump_shards import jump_stops, shard_documents, write_shards


def walk(key, shards):
    """The published loop, on Python's integers."""
    key %= 1 << 64
    stop, onward = -1, 0
    while onward < shards:
        stop = onward
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        onward = int((stop + 1) * (2.0**31 / ((key >> 33) + 1)))
    return stop


KEYS = [*range(-40, 400), 2**63 - 1, -(2**63), 1 << 32, (1 << 32) - 1, 6364136223846793005]


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 300])
def test_equals_the_published_loop(spark, shards):
    keys = spark.createDataFrame([(k,) for k in KEYS], "k bigint")
    found = keys.select("k", jump_stops(F.col("k"), shards).alias("s")).select("k", "s.shard", "s.grown")
    assert rows(found, "k", "shard", "grown") == sorted(
        ((k, walk(k, shards), walk(k, shards + 1)) for k in KEYS), key=repr
    )


def test_the_setting_for_overflow_does_not_matter(spark):
    keys = spark.createDataFrame([(k,) for k in KEYS], "k bigint")
    seen = []
    before = spark.conf.get("spark.sql.ansi.enabled")
    for setting in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", setting)
        seen.append(rows(keys.select("k", jump_stops(F.col("k"), 24)["shard"].alias("s")), "k", "s"))
    spark.conf.set("spark.sql.ansi.enabled", before)
    assert seen[0] == seen[1]


def test_growing_moves_rows_only_into_the_new_shard(spark):
    found = spark.range(20000).select(jump_stops(F.col("id"), 24).alias("s")).select("s.*")
    assert found.where("grown <> shard AND grown <> 24").isEmpty()
    moved = found.where("grown = 24").count()
    assert 0.8 * 20000 / 25 < moved < 1.2 * 20000 / 25
    sizes = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert len(sizes) == 24 and min(sizes) > 0.85 * 20000 / 24 and max(sizes) < 1.15 * 20000 / 24


def check(found, given):
    """Every given (id, text) once, in the right shard, with slots that have no gap."""
    out = [r.asDict() for r in found.collect()]
    expect = Counter()
    for doc_id, text in given:
        raw = (text or "").encode()
        expect[doc_id, len(raw) + 8, zlib.crc32(raw), walk(doc_id or 0, 24), walk(doc_id or 0, 25)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in out) == expect
    assert {r["law"] for r in out} <= {"key"}
    for shard in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    return out


GIVEN = [
    (None, None), (None, ""), (None, "a"), (None, "a"), (0, "a"), (0, "ä€𝄞"), (0, "ä€𝄞"), (-5, "x"),
    (7, "w " * 200_000), (2**63 - 1, "last"), *[(i, "copy") for i in range(50)], *[(9, "same")] * 40,
]


def test_every_row_once_in_its_shard(documents):
    docs = documents(GIVEN)
    plain = check(shard_documents(docs), GIVEN)
    assert sorted(map(repr, plain)) == sorted(map(repr, check(shard_documents(clashing(docs)), GIVEN)))


def test_many_equal_rows_unfold_in_parts(documents, monkeypatch):
    monkeypatch.setattr(jump_shards, "COPIES", 3)
    check(shard_documents(documents(GIVEN)), GIVEN)


def test_slots_do_not_depend_on_the_order_of_arrival(documents):
    first = rows(shard_documents(documents(GIVEN)), "doc_id", "text_crc32", "slot")
    again = rows(shard_documents(documents(GIVEN[::-1]).repartition(3)), "doc_id", "text_crc32", "slot")
    assert first == again


def test_empty_table_and_arguments(documents):
    assert shard_documents(documents([])).count() == 0
    with pytest.raises(ValueError):
        jump_stops(F.lit(1), 0)


def test_files_by_shard(spark, documents, tmp_path):
    docs = documents(GIVEN).withColumn("shard", F.lit("old"))
    write_shards(docs, str(tmp_path / "out"), 24, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == set(docs.columns)
    assert rows(back, "doc_id", "text", "source") == rows(docs, "doc_id", "text", "source")
    assert all(r["shard"] == walk(r["doc_id"] or 0, 24) for r in back.collect())


def test_string_keys(spark, tmp_path):
    df = spark.createDataFrame([(f"key {i}",) for i in range(100)], "name string")
    write_shards(df, str(tmp_path / "named"), 5, key="name")
    assert spark.read.parquet(str(tmp_path / "named")).select("shard").distinct().count() == 5
