import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnwise.session import local_session  # noqa: E402

# Sentences whose results are known.
SHERLOCK = [
    ("To Sherlock Holmes she is always the woman.", "A"),
    ("I have seldom heard him mention her under any other name.", "B"),
    ("In his eyes she eclipses and predominates the whole of her sex.", "A"),
    ("It was not that he felt any emotion akin to love for Irene Adler.", "B"),
    (
        "All emotions, and that one particularly, were abhorrent to his cold, precise but "
        "admirably balanced mind.",
        "A",
    ),
]

# Upper triangle of a symmetric table of similarities whose recurrences are known.
MATRIX = {
    "AB": 0.9, "AC": 0.8, "AD": 0.7, "AE": 0.6, "AF": 0.5, "AG": 0.4,
    "BC": 0.5, "BD": 0.4, "BE": 0.3, "BF": 0.2, "BG": 0.1,
    "CD": 0.1, "CE": 0.2, "CF": 0.3, "CG": 0.4,
    "DE": 0.5, "DF": 0.6, "DG": 0.7,
    "EF": 0.2, "EG": 0.4,
    "FG": 0.5,
}


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", app="tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sherlock(spark):
    rows = [(i, text, speaker) for i, (text, speaker) in enumerate(SHERLOCK)]
    return spark.createDataFrame(rows, "text_id bigint, text string, speaker string")


@pytest.fixture(scope="session")
def seven(spark):
    rows = [(0, i, "Alice" if i % 2 == 0 else "Bob", f"turn {i}") for i in range(7)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string")


def similarity_rows(letters="ABCDEFG"):
    place = {letter: i for i, letter in enumerate(letters)}
    return [
        (0, place[a], place[b], s) for (a, b), s in MATRIX.items() if a in place and b in place
    ]


@pytest.fixture(scope="session")
def seven_similarity(spark):
    return spark.createDataFrame(
        similarity_rows(), "conv_id bigint, row_turn bigint, col_turn bigint, similarity double"
    )
