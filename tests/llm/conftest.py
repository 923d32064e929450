import random

import pytest

from turnwise.llm.written import prepared

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def settings(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table of documents from texts; pairs give the id too."""

    def make(texts, source=lambda i: f"s{i % 3}"):
        rows = []
        for i, item in enumerate(texts):
            doc_id, text = item if isinstance(item, tuple) else (i, item)
            rows.append((doc_id, text, "en", source(i), None if text is None else len(text)))
        return spark.createDataFrame(rows, SCHEMA)

    return make


def random_text(seed, words, vocabulary=500):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


def clashing(df):
    """Extra columns with names the operators use inside."""
    from pyspark.sql import functions as F

    names = ("key", "row_id", "digest", "tokens", "score", "part", "round", "start", "length", "n", "ids", "copies", "rank")
    return df.withColumns({n: F.lit("clash") for n in names})


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
