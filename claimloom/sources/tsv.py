"""Tab-separated cells in which backslash, tab, newline and carriage return are escaped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PAIRS = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def encode_cell(col: Column) -> Column:
    for raw, shown in _PAIRS:
        col = F.replace(col, F.lit(raw), F.lit(shown))
    return col


def decode_cell(col: Column) -> Column:
    """Left to right: an escaped backslash never begins another escape."""
    parts = F.split(col, r"\\\\", -1)  # at doubled backslashes

    def plain(part: Column) -> Column:
        for raw, shown in _PAIRS[1:]:
            part = F.replace(part, F.lit(shown), F.lit(raw))
        return part

    return F.array_join(F.transform(parts, plain), "\\")


def write_tsv(df: DataFrame, path: str) -> None:
    """One line per row, cells as texts; null is an empty cell."""
    cells = [F.coalesce(encode_cell(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns]
    df.select(F.concat_ws("\t", *cells).alias("value")).write.mode("error").text(path)


def read_tsv(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of (name, Spark type) columns; a line with another number of cells raises."""
    cells = F.split("value", "\t", -1)
    bad = F.raise_error(F.concat(F.lit("wrong number of cells: "), F.col("value")))
    rows = spark.read.text(path).select(F.when(F.size(cells) == len(columns), cells).otherwise(bad.cast("array<string>")).alias("c"))
    return rows.select(*[decode_cell(F.get("c", F.lit(k))).cast(t).alias(n) for k, (n, t) in enumerate(columns)])
