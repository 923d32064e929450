import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators.ordering import all_brief, attach, number_rows, running_totals, top_rows


@pytest.fixture(scope="module")
def numbers(spark):
    """One key owns most rows; orders have gaps and start below zero."""
    rng = random.Random(1)
    rows = [("hot", o, rng.randint(0, 9)) for o in rng.sample(range(-50, 900), 400)]
    rows += [(f"k{i}", o, rng.randint(0, 9)) for i in range(20) for o in rng.sample(range(100), 3)]
    return spark.createDataFrame(rows, "key string, ord bigint, value bigint")


def cumulative(rows, key_of):
    seen, totals = {}, {}
    for row in sorted(rows, key=lambda r: (key_of(r) or "", r["ord"])):
        group = key_of(row)
        totals[(row["key"], row["ord"])] = seen.get(group, 0)
        seen[group] = seen.get(group, 0) + row["value"]
    return totals, seen


@pytest.mark.parametrize("width, levels", [(1 << 16, 1), (7, 1), (4, 2), (3, 3), (1, 1)])
def test_running_totals_do_not_depend_on_blocks(numbers, width, levels):
    rows = numbers.collect()
    want, sums = cumulative(rows, lambda r: r["key"])
    got = running_totals(
        numbers, ["key"], "ord", {"before": F.col("value")}, width=width, levels=levels, totals=True
    ).collect()
    assert {(r["key"], r["ord"]): r["before"] for r in got} == want
    assert all(r["before_total"] == sums[r["key"]] for r in got)


def test_numbers_over_the_whole_table(numbers):
    table = numbers.filter("key = 'hot'")
    got = number_rows(table, "ord", name="n").orderBy("ord").collect()
    assert [r["n"] for r in got] == list(range(400))


def test_numbers_per_key(numbers):
    got = number_rows(numbers, "ord", keys=["key"], name="n")
    per_key = got.groupBy("key").agg(F.max("n").alias("last"), F.countDistinct("n").alias("d"))
    assert all(r["last"] + 1 == r["d"] == (400 if r["key"] == "hot" else 3) for r in per_key.collect())


@pytest.mark.parametrize("n", [1, 5, 250])
def test_top_rows_with_and_without_the_salted_pass(spark, numbers, n):
    setting = "spark.sql.optimizer.windowGroupLimitThreshold"
    order = [F.desc("value"), F.asc("ord")]
    plain = {tuple(r) for r in top_rows(numbers, ["key"], order, n).collect()}
    spark.conf.set(setting, "0")
    try:
        salted = {tuple(r) for r in top_rows(numbers, ["key"], order, n).collect()}
    finally:
        spark.conf.unset(setting)
    assert plain == salted
    assert sum(1 for r in plain if r[0] == "hot") == min(n, 400)


def test_facts_are_attached_block_by_block(spark):
    turns = spark.range(100).selectExpr("id % 3 AS conv_id", "id AS turn", "id div 10 AS block")
    facts = spark.createDataFrame([(0, "a"), (1, "b")], "conv_id bigint, name string")
    got = attach(turns, facts)
    assert got.count() == 67
    assert got.filter("name = 'a' AND conv_id != 0").isEmpty()
    assert attach(turns.drop("block"), facts).count() == 67


def test_brief_conversations(spark):
    assert all_brief(spark.range(64).withColumnRenamed("id", "turn"))
    assert not all_brief(spark.range(65).withColumnRenamed("id", "turn"))


def test_rows_without_a_key_are_kept(spark):
    rows = [(None, 3), ("a", 1), (None, 1), ("a", 7), (None, 9)]
    table = spark.createDataFrame(rows, "key string, ord bigint")
    got = {(r["key"], r["ord"]): r["n"] for r in number_rows(table, "ord", keys=["key"], name="n").collect()}
    assert got == {(None, 1): 0, (None, 3): 1, (None, 9): 2, ("a", 1): 0, ("a", 7): 1}
