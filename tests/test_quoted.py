"""Quoted CSV files cut into many splits against Python's reader and Spark's one-task reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from turnwise.sources.files import read_csv
from turnwise.sources.quoted import ends_inside

SCHEMA = "id bigint, text string, tail string"


@pytest.mark.parametrize(
    "line, inside, expected",
    [
        ("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('b",c', True, False), ('b"",c', True, True),
        ('"a""b",c', False, False), ('"a""', False, True), ('5" pipe,x', False, False), ('x,"",y', False, False),
        ('"a","b', False, True), ('a","b","', True, True), ('a"', True, False), ('"', False, True), ('"', True, False), ("", True, True),
    ],
)
def test_a_line_ends_inside(line, inside, expected):
    assert ends_inside(line, inside) is expected


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(["id", "text", "tail"])
        out.writerows(rows)


def given(seed, n):
    draw = random.Random(seed)
    parts = ["word", "\n", '"', ",", " ", "é", '""', "line\nbreak", "\n\n", '","']
    return [(i, "x" + "".join(draw.choice(parts) for _ in range(draw.randrange(30))), "end") for i in range(n)]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def found(df):
    return sorted(tuple(r) for r in df.select("row", "id", "text", "tail").collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_file_in_many_splits(spark, small_splits, tmp_path, end):
    rows = given(1, 800) + [(800, "long " + "many\n" * 5000 + '"', "end"), (801, "last", "end")]
    path = tmp_path / "one.csv"
    write(path, rows, end)
    df = read_csv(spark, str(path), schema=SCHEMA)
    assert found(df) == [(i, *r) for i, r in enumerate(rows)]
    assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 8


def test_equals_the_one_task_reader(spark, small_splits, tmp_path):
    for i in range(3):
        write(tmp_path / f"{i}.csv", given(i, 150) + [(None, None, ""), (7, "", None)])
    (tmp_path / "4.csv").write_text('id,text,tail\n\n1,5" pipe,"a"\n  \n2,"x"y,z\n3\n4,a,b,c\n')
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(SCHEMA)
    one = reader.csv(str(tmp_path))
    many = read_csv(spark, str(tmp_path), schema=SCHEMA)
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, many.select("id", "text", "tail").collect()), key=repr) == sorted(map(tuple, one.collect()), key=key)
    per_file = many.groupBy("source_file").agg(F.count("*").alias("n"), F.max("row").alias("last"), F.countDistinct("row").alias("d"))
    assert all(r["n"] == r["last"] + 1 == r["d"] for r in per_file.collect())


def test_without_broadcasts(spark, small_splits, tmp_path, monkeypatch):
    from turnwise.sources import files

    monkeypatch.setattr(files, "BROADCAST_ROWS", 0)
    rows = given(5, 400)
    write(tmp_path / "one.csv", rows)
    assert found(read_csv(spark, str(tmp_path / "one.csv"), schema=SCHEMA)) == [(i, *r) for i, r in enumerate(rows)]


def test_types_are_inferred(spark, small_splits, tmp_path):
    path = tmp_path / "typed.csv"
    path.write_text('a,b,c,d,e,f,\n1,2.5,2020-01-01,true,"x\ny",,q\n30000000000,1e3,2021-02-03,false,7,,r\n')
    one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", True)
    one = one.csv(str(path))
    many = read_csv(spark, str(path))
    assert [(f.name, f.dataType) for f in one.schema] == [(f.name, f.dataType) for f in many.select(one.columns).schema]
    assert sorted(map(tuple, many.select(one.columns).collect())) == sorted(map(tuple, one.collect()))


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "e.csv"), schema=SCHEMA).count() == 0
    (tmp_path / "h.csv").write_text("id,text,tail\n")
    assert read_csv(spark, str(tmp_path / "h.csv"), schema=SCHEMA).count() == 0


def test_quotes_agree_with_python(tmp_path):
    rows = given(9, 300)
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    inside, records = False, 0
    for line in text.getvalue().split("\n")[:-1]:
        inside = ends_inside(line, inside)
        records += not inside
    assert records == 300 and not inside
