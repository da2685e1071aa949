"""RFC 4180 text of rows: NULL is nothing, an empty string is "", lines end with LF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(value: object) -> str:
    if value is None:
        return ""
    text = str(value)
    return '"' + text.replace('"', '""') + '"' if text == "" or any(c in text for c in ',"\r\n') else text


def to_csv(header: list[str], rows) -> str:
    return "".join(",".join(quoted(v) for v in row) + "\n" for row in [header, *rows])


def csv_lines(df: DataFrame) -> DataFrame:
    """line: each row as CSV, computed where the row is; for frames too large to collect."""

    def cell(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        escaped = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.isNull(), "").when((text == "") | text.rlike('[,"\\r\\n]'), escaped).otherwise(text)

    return df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """Part files of lines, without a header."""
    csv_lines(df).write.mode("overwrite").text(path)
