"""The registered queries against their SQL. All of them: ``python tools/compare.py``."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import difference, open_oracle
from turnwise.plans.catalog import QUERIES
from turnwise.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
FAST = [
    "assign_text_id", "chunk_concat", "column_display_width", "common_concepts", "kwic_chunked",
    "kwic_literal", "kwic_page_left", "kwic_regex", "kwic_sort_left", "kwic_whole_word",
    "line_context", "load_csv", "load_keyed_lines", "load_text_files", "match_source_row",
    "similarity_embedding", "split_sentences", "term_contingency", "tile_layout", "tokenize",
    "top_terms", "similarity_vector", "grouped_recurrence",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert not set(oracle_sql()) - set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["conv_id", "turn", "time_scale", "direction", "speaker", "score"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, oracle, name):
    assert difference(queries()[name](spark, SF), oracle, oracle_sql()[name]) is None
