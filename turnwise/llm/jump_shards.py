"""Shards by jump consistent hashing: a key and the number of shards decide, without a table of the ring.

A key is the seed of a pseudo-random walk over the shard numbers that only ever jumps forward, and its shard is the
last stop below the number of shards. With one more shard a key either stays or goes to the new one, so appending
shards moves the fewest rows that keep sizes even. All of it is column arithmetic: no Python, and texts are not shuffled.

The step is ``key = key * 2862933555777941757 + 1`` modulo 2**64 and ``next = (stop + 1) * 2**31 / (key >> 33 + 1)``.
Products wrap in 32-bit halves, so the result does not depend on how the session treats overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.written import written
from turnwise.operators.ordering import running_totals

SHARDS = 24
LAW = "key"

# Multiplier and divisor of the published walk.
MULTIPLIER = 2862933555777941757
SCALE = 2.0**31

STEPS = 32  # of the walk in one go; a walk that has ended skips the rest
COPIES = 1 << 16  # equal rows that one row is unfolded to in one go
MASK = (1 << 32) - 1


def _low(value: Column) -> Column:
    return value.bitwiseAND(F.lit(MASK))


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of ``key * MULTIPLIER + 1`` modulo 2**64; no product here reaches 2**63."""
    high, low = MULTIPLIER >> 32, MULTIPLIER & MASK
    upper, lower = F.lit(low >> 16), F.lit(low & 0xFFFF)
    middle = lo * upper
    bottom = lo * lower + F.shiftleft(middle.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carried = F.shiftright(middle, 16) + F.shiftright(bottom, 32)
    crossed = _low(hi * lower) + F.shiftleft((hi * upper).bitwiseAND(F.lit(0xFFFF)), 16)
    return _low(carried + crossed + _low(lo * F.lit(high))), _low(bottom)


def jump_stops(key: Column, shards: int) -> Column:
    """``struct<shard, grown>`` of a bigint key: its shard among ``shards``, and with one more.

    The walk visits at most ``shards + 1`` numbers and about ln(shards) in the mean.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    long = F.lit(0).cast("bigint")
    start = F.struct(
        _low(F.shiftright(key, 32)).alias("hi"),
        _low(key).alias("lo"),
        long.alias("shard"),
        long.alias("grown"),
        long.alias("next"),
    )

    def step(walk: Column) -> Column:
        stop = walk["next"]
        hi, lo = _advance(walk["hi"], walk["lo"])
        drawn = (F.shiftright(hi, 1) + F.lit(1)).cast("double")
        onward = ((stop + F.lit(1)).cast("double") * (F.lit(SCALE) / drawn)).cast("bigint")
        return F.struct(
            hi.alias("hi"),
            lo.alias("lo"),
            F.when(stop < shards, stop).otherwise(walk["shard"]).alias("shard"),
            stop.alias("grown"),
            onward.alias("next"),
        )

    def going(walk: Column, more: Column) -> Column:
        return F.when(walk["next"] <= shards, more).otherwise(walk)

    def some(walk: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), walk, lambda w, _: going(w, step(w)))

    rounds = -(-(shards + 1) // STEPS)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda w, _: going(w, some(w)))
    return F.struct(walked["shard"].alias("shard"), walked["grown"].alias("grown"))


def shard_key(column: Column, kind: str) -> Column:
    """A bigint key: integers as they are, others by a 64-bit hash; null is 0."""
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(column.cast("bigint") if whole else F.xxhash64(column), F.lit(0).cast("bigint"))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def shard_documents(
    documents: DataFrame, shards: int = SHARDS, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Shard and place of every row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is 8 and the UTF-8 bytes of the text, ``slot`` counts the rows of a shard from 0 without gaps, in an order
    that the values of a row decide. ``grown_shard`` is the shard with one more. A null text has no bytes and
    checksum 0, as an empty one; a null id is key 0. Rows that repeat an id share its shard and differ in their slot. Other
    columns are ignored, whatever their names. An empty table gives an empty one.

    Texts are read once and stay where they are: sizes and checksums are numbered, in blocks of 65,536 values of a
    hash of id, checksum and size. Rows equal in all three are one row with a count there, so no id, text or shard
    fills a task.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    facts = documents.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text).cast("bigint") + F.lit(8)).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    same = facts.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size")
    stops = jump_stops(shard_key(F.col("doc_id"), _kind(facts, "doc_id")), shards)
    placed = same.select("*", F.crc32(named.cast("binary")).alias("place"), stops.alias("stops")).select(
        "doc_id", "size", "text_crc32", "copies", "place", "stops.shard", F.col("stops.grown").alias("grown_shard")
    )
    kept = written(placed, "shards")
    ties = ["doc_id", "text_crc32", "size"]
    numbered = running_totals(kept, ["shard"], "place", {"slot": F.col("copies")}, ties=ties)

    def unfold(rows: DataFrame) -> DataFrame:
        return rows.withColumn("slot", F.explode(F.expr("sequence(slot, slot + copies - 1)")))

    few = numbered.where(F.col("copies") <= COPIES)
    chunk = F.explode(F.expr(f"sequence(0, (copies - 1) div {COPIES})"))
    many = numbered.where(F.col("copies") > COPIES).withColumn("chunk", chunk)
    many = many.repartition("shard", "place", "chunk").withColumns(
        {
            "slot": F.expr(f"slot + chunk * {COPIES}L"),
            "copies": F.expr(f"least(copies - chunk * {COPIES}L, {COPIES}L)"),
        }
    )
    return unfold(few).unionByName(unfold(many.drop("chunk"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int"),
        "slot",
        F.col("grown_shard").cast("int"),
    )


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, *, key: str = "doc_id", files: int = 1) -> None:
    """Write the rows, all columns, as Parquet below ``path/shard=<n>``, each shard in up to ``files`` files.

    A column ``shard`` of the input is replaced. Rows go to the files of their shard by a hash of the whole row, so that
    one key does not decide the size of a file.
    """
    placed = df.withColumn("shard", jump_stops(shard_key(F.col(key), _kind(df, key)), shards)["shard"].cast("int"))
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != "shard"]), F.lit(files))
    placed.repartition(shards * files, F.col("shard"), salt).write.partitionBy("shard").parquet(path)


def shard_sql(shards: int = SHARDS) -> str:
    """The rows of :func:`shard_documents` over the table ``documents``, for DuckDB."""
    return f"""
    WITH RECURSIVE bits AS (
        SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    raw AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
    summed AS (
        SELECT r, doc_id, octet_length(b)::BIGINT + 8 AS size,
            xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(b), '..'),
                lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c >> 8, t[1 + xor(c & 255, x)])), 4294967295) AS text_crc32
        FROM raw, bits),
    named AS (
        SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || text_crc32 || ':' || size)) AS h FROM summed),
    placed AS (
        SELECT r, doc_id, size, text_crc32,
            xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(h, '..'),
                lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c >> 8, t[1 + xor(c & 255, x)])), 4294967295) AS place
        FROM named, bits),
    walk AS (
        SELECT r, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT AS k,
            0::BIGINT AS shard, 0::BIGINT AS grown, 0::BIGINT AS next FROM placed
        UNION ALL
        SELECT r, n, CASE WHEN next < {shards} THEN next ELSE shard END, next,
            floor((next + 1)::DOUBLE * (2147483648::DOUBLE / ((n // 8589934592) + 1)::DOUBLE))::BIGINT
        FROM (SELECT *, (k * {MULTIPLIER}::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS n
              FROM walk WHERE next <= {shards})),
    ended AS (SELECT r, shard, grown FROM walk WHERE next > {shards})
    SELECT doc_id, size, text_crc32, '{LAW}' AS law, shard::INT AS shard,
        row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
        grown::INT AS grown_shard
    FROM placed JOIN ended USING (r)"""
