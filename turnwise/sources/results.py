"""Writing results."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the widest column of an exported sheet, in characters.
MAX_COLUMN_WIDTH = 100
FORMATS = ("csv", "parquet", "json", "orc")


def write_results(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Write a result table; CSV gets a header and doubled quotes, as spreadsheets expect."""
    if format not in FORMATS:
        raise ValueError(f"invalid format {format!r}: should be one of {FORMATS}")
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        # Texts are written as they are: no trimming, and an empty text stays apart from none.
        for trim in ("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"):
            writer = writer.option(trim, False)
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", '""')
    writer.save(path)


def column_widths(df: DataFrame, max_width: int = MAX_COLUMN_WIDTH) -> DataFrame:
    """Display width of each column: longest value or header, up to a maximum. One aggregation."""
    longest = df.agg(
        *[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(c) for c in df.columns]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.least(
                    F.greatest(F.col(f"`{c}`"), F.lit(len(c))), F.lit(max_width)
                ).cast("bigint").alias("width"),
            )
            for c in df.columns
        ]
    )
    return longest.select(F.inline(rows))
