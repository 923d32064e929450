from turnwise.sources.files import (
    decode_with_fallback,
    file_encodings,
    number_file_rows,
    read_csv,
    read_keyed_lines,
    read_lines,
)
from turnwise.sources.results import column_widths, write_results
from turnwise.sources.tables import (
    deal_out,
    from_dataframe,
    keyed_lines,
    plain_lines,
    split_lines,
)

__all__ = [
    "column_widths",
    "deal_out",
    "decode_with_fallback",
    "file_encodings",
    "from_dataframe",
    "keyed_lines",
    "number_file_rows",
    "plain_lines",
    "read_csv",
    "read_keyed_lines",
    "read_lines",
    "split_lines",
    "write_results",
]
