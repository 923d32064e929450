import os

from pyspark.sql import functions as F

from turnwise.session import bucket_count, cut_lineage, lay_out, release, scratch, scratch_path, written_bytes


def buckets(spark, table):
    described = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'")
    return int(described.first()["data_type"])


def laid_out(spark, df):
    before = {t.name for t in spark.catalog.listTables()}
    rows = lay_out(df, ["k"])
    (name,) = {t.name for t in spark.catalog.listTables()} - before
    return rows, name


def test_joins_upstream_do_not_change_the_buckets(spark):
    small = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    joined = small
    for i in range(4):  # the plan's estimate multiplies the sizes of both sides
        joined = joined.join(small.select("id", F.col("k").alias(f"k{i}")).hint("shuffle_merge"), "id")
    for df in (small, joined):
        rows, name = laid_out(spark, df)
        assert rows.count() == 300
        assert buckets(spark, name) == 4


def test_buckets_follow_the_written_bytes(spark):
    assert bucket_count(spark, 10) == 4
    assert bucket_count(spark, 10 << 30) == 160
    path = scratch_path(spark, "some")
    spark.range(1000).write.parquet(path)
    files = [os.path.join(path, f) for f in os.listdir(path) if not f.endswith(".crc")]
    assert written_bytes(spark, path) == sum(map(os.path.getsize, files))


def test_scratch_leaves_nothing(spark):
    lay_out(spark.range(5).withColumnRenamed("id", "k"), ["k"])
    kept = scratch_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    before = {t.name for t in spark.catalog.listTables()}
    with scratch(spark):
        path = scratch_path(spark, "inside")
        spark.range(3).write.parquet(path)
        rows = lay_out(spark.read.parquet(path).withColumnRenamed("id", "k"), ["k"])
        assert cut_lineage(rows).count() == 3
        assert {t.name for t in spark.catalog.listTables()} > before
    assert {t.name for t in spark.catalog.listTables()} == before
    assert os.path.isdir(kept) and not os.path.isdir(path)
    release(spark)
    assert not os.path.isdir(kept)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("turnwise_")]
