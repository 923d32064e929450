"""Concordances: a text table or loaded lines with search settings, as lazily built plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from turnwise.functions.patterns import pattern_error
from turnwise.operators import concordance as kwic
from turnwise.operators import prepare
from turnwise.operators.ordering import number_rows
from turnwise.sources import files, results, tables

TYPES = ("csv", "dataframe", "txt")


@dataclass(frozen=True)
class Concordance:
    """Matches of a keyword in a table of texts (``text_id, text``).

    Settings never change in place: ``with_settings`` gives a concordance with other ones.
    """

    texts: DataFrame
    keyword: str = ""
    regex: bool = False
    ignore_case: bool = True
    whole_word: bool = False
    results_per_page: int = 20
    window_width: int = 50
    sort: str = "text_id"
    columns: tuple[str, ...] = ("text_id",)

    def with_settings(self, **settings) -> Concordance:
        return replace(self, **settings)

    @property
    def _options(self) -> dict:
        return {"regex": self.regex, "ignore_case": self.ignore_case, "whole_word": self.whole_word}

    def is_valid(self) -> bool:
        return not self.regex or pattern_error(self.keyword) is None

    def matches(self) -> DataFrame:
        """All matches, unsorted."""
        return kwic.search(
            self.texts,
            self.keyword,
            window_width=self.window_width,
            columns=self.columns,
            **self._options,
        )

    def results(self) -> DataFrame:
        """All matches in the chosen order."""
        return kwic.sort_results(self.matches(), self.sort)

    def page(self, number: int = 1) -> DataFrame:
        return kwic.result_page(self.matches(), number, self.results_per_page, self.sort)

    def totals(self) -> DataFrame:
        """One row: results and pages."""
        counts = kwic.count_matches(self.texts, self.keyword, **self._options)
        return kwic.total_matches(counts, self.results_per_page)

    def export(self, path: str, format: str = "csv") -> None:
        results.write_results(self.results(), path, format)


class TextLoader:
    """Texts from a file or table, searched in chunks so that contexts cross line borders.

    Args:
        path: CSV or text file(s), for types ``csv`` and ``txt``.
        type: ``csv``, ``txt`` or ``dataframe``.
        df: the table, for type ``dataframe``; with ``order``, its integral order column.
        symbol: splits ``key<symbol>text`` lines of text files.
        chunk: rows searched as one text.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str = "",
        type: str = "csv",
        *,
        df: DataFrame | None = None,
        order: str | None = None,
        symbol: str | None = None,
        chunk: int = 1,
    ) -> None:
        if type not in TYPES:
            raise ValueError(f"invalid type {type!r}: should be one of {TYPES}")
        if type == "csv":
            rows = files.read_csv(spark, path)
        elif type == "txt" and symbol is None:
            rows = files.read_lines(spark, path)
        elif type == "txt":
            rows = files.read_keyed_lines(spark, path, symbol)
        else:
            rows = tables.from_dataframe(df)
            if order is None:
                raise ValueError("a table has no row order of its own: name its order column")
            rows = number_rows(rows, order, name="row")
        self.keys = ["source_file"] if "source_file" in rows.columns else []
        self.rows = prepare.chunk_rows(rows, chunk)
        self.chunk = chunk

    def columns(self) -> list[str]:
        """Columns that may be shown next to a match."""
        return prepare.metadata_columns(self.rows, self.keys)

    def chunks(self) -> DataFrame:
        """``chunk, text``: the tagged rows of each chunk, joined."""
        return prepare.concat_chunks(prepare.tag_rows(self.rows), keys=self.keys)

    def largest_text_length(self) -> DataFrame:
        return prepare.largest_text_length(self.chunks())

    def search(self, keyword: str, metadata: Sequence[str] | None = None, **settings) -> DataFrame:
        """See ``operators.concordance.search_chunks``."""
        return kwic.search_chunks(
            self.rows, keyword, keys=self.keys, metadata=metadata, whole_rows=self.chunk == 1, **settings
        )

    def line_context(self, word: str, context_length: int = 10) -> DataFrame:
        return kwic.line_context(
            self.rows, word, context_length, keys=self.keys, order="row"
        )
