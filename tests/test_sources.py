import pytest
from pyspark.sql import functions as F

from turnwise import TextLoader
from turnwise.operators import prepare
from turnwise.sources import (
    column_widths,
    files,
    from_dataframe,
    keyed_lines,
    read_csv,
    read_keyed_lines,
    read_lines,
    write_results,
)

from .conftest import SHERLOCK


@pytest.fixture(params=["broadcast", "joined"])
def mode(request, monkeypatch):
    """Both ways of numbering: counts per split broadcast, or joined."""
    if request.param == "joined":
        monkeypatch.setattr(files, "BROADCAST_ROWS", -1)
    return request.param


def test_csv_equals_table(spark, sherlock, tmp_path):
    path = tmp_path / "s.csv"
    lines = ["text,speaker"] + ['"' + t.replace(" the ", "\nthe ") + f'",{s}' for t, s in SHERLOCK]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    broken = sherlock.withColumn("text", F.replace("text", F.lit(" the "), F.lit("\nthe ")))
    of_csv = TextLoader(spark, str(path), "csv", chunk=1).chunks().select("chunk", "text")
    of_table = TextLoader(spark, type="dataframe", df=broken.drop("text_id").join(
        broken.select("text", "text_id"), "text"), order="text_id", chunk=1).chunks()
    assert of_csv.schema["chunk"].dataType == of_table.schema["chunk"].dataType
    assert sorted(map(tuple, of_csv.collect())) == sorted(map(tuple, of_table.collect()))


def test_lines_are_numbered_across_splits(spark, tmp_path, mode):
    for name in ("a", "b"):
        lines = [f"  {name} line {i} " if i % 5 else "x" for i in range(2000)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = rows.orderBy("source_file", "row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [f"{n} line {i}" for n in "ab" for i in range(2000) if i % 5]
    assert [r["text"] for r in got] == want
    assert [r["row"] for r in got] == list(range(1600)) * 2


def test_bytes_that_are_not_utf8_make_a_file_latin1(spark, tmp_path, mode):
    (tmp_path / "u.txt").write_bytes("déjà vu\nstraße\n".encode())
    (tmp_path / "l.txt").write_bytes("déjà vu\nplain\n".encode("latin-1") + "é".encode() + b"!\n")
    got = {r["source_file"].rsplit("/", 1)[1] + str(r["row"]): r["text"] for r in read_lines(spark, str(tmp_path)).collect()}
    assert got == {
        "u.txt0": "déjà vu", "u.txt1": "straße",
        "l.txt0": "déjà vu", "l.txt1": "plain", "l.txt2": "Ã©!",
    }


def test_named_encoding(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes("déjà vu\n".encode("latin-1"))
    assert read_lines(spark, str(tmp_path), encoding="ISO-8859-1").first()["text"] == "déjà vu"


def test_keyed_files(spark, tmp_path):
    text = "Question: why?\n\nName 6: because : of it\nno symbol\n話者: こんにちは\n"
    (tmp_path / "q.txt").write_text(text, encoding="utf-8")
    rows = read_keyed_lines(spark, str(tmp_path), ":").orderBy("row").collect()
    assert [(r["row"], r["key"], r["text"]) for r in rows] == [
        (0, "Question", " why?"),
        (1, "Name 6", " because : of it"),
        (2, "話者", " こんにちは"),
    ]
    loader = TextLoader(spark, str(tmp_path), "txt", symbol=":", chunk=3)
    assert loader.search("because", metadata=["key"]).first()["key"] == "Name 6"


def test_a_symbol_is_taken_literally(spark):
    lines = spark.createDataFrame([("a.*b.*c",), ("a.b",)], "text string")
    assert [tuple(r) for r in keyed_lines(lines, ".*").select("key", "text").collect()] == [("a", "b.*c")]


def test_missing_table():
    with pytest.raises(ValueError, match="missing"):
        from_dataframe(None)


def test_results_survive_csv(spark, tmp_path):
    rows = [(1, ' lead "q", \n next '), (2, "plain"), (3, "")]
    df = spark.createDataFrame(rows, "text_id bigint, text string")
    write_results(df, str(tmp_path / "out"))
    again = read_csv(spark, str(tmp_path / "out"), schema="text_id bigint, text string")
    got = sorted((r["text_id"], r["text"] or "") for r in again.collect())
    assert got == rows
    with pytest.raises(ValueError, match="invalid format"):
        write_results(df, str(tmp_path / "x"), "xlsx")


def test_column_widths(spark):
    df = spark.createDataFrame([("ab", "x" * 300), (None, "y")], "long_name string, t string")
    assert {r[0]: r[1] for r in column_widths(df).collect()} == {"long_name": 9, "t": 100}


def test_prepared_turns_are_dense(spark):
    df = spark.createDataFrame(
        [(7, 10, "x", "u1", "n1"), (7, 30, "y", "u2", "n2"), (8, 5, "z", "u3", "n3")],
        "c bigint, pos bigint, speaker string, utterance string, name string",
    )
    with pytest.warns(UserWarning, match="speaker_original"):
        got = prepare.prepare_turns(
            df, "utterance", "name", conversation_column="c", turn_column="pos"
        )
    assert {"speaker_original", "pos_original"} <= set(got.columns)
    rows = got.orderBy("conv_id", "turn").select("conv_id", "turn", "text_id", "speaker", "text").collect()
    assert [tuple(r) for r in rows] == [(7, 0, 0, "n1", "u1"), (7, 1, 1, "n2", "u2"), (8, 0, 0, "n3", "u3")]


def test_prepared_texts(spark):
    df = spark.createDataFrame([(30, "b"), (10, "a")], "pos bigint, body string")
    got = prepare.prepare_texts(df, "body", order="pos").orderBy("text_id").collect()
    assert [(r["text_id"], r["text"], r["tokens"]) for r in got] == [(0, "a", ["a"]), (1, "b", ["b"])]
    with pytest.raises(ValueError, match="order"):
        prepare.prepare_texts(df, "body")


def test_rows_of_a_folder_that_holds_one_text(spark, tmp_path):
    path = str(tmp_path / "parts")
    lines = [(i, f"line {i}\nmore {i}") for i in range(50)]
    df = spark.createDataFrame(lines, "id bigint, text string").repartitionByRange(7, "id").sortWithinPartitions("id")
    df.select("text").write.text(path)
    found = files.read_lines(spark, path, as_one=True)
    assert found.select("source_file").distinct().count() > 1
    want = [(i, t) for i, t in enumerate(x for _, text in lines for x in text.split("\n"))]
    assert sorted((r["row"], r["text"]) for r in found.collect()) == want
    assert found.select("source_file").distinct().count() == files.read_lines(spark, path).where("row = 0").count()
