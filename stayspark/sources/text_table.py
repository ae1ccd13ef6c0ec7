"""Whitespace table parse of extracted text (one row per non-blank line)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayspark import functions as SF


def text_table_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Split each text into lines, drop blank ones and split every line on
    runs of blanks into positional cells (``cells`` array; ``line_no`` is the
    line's position in the text)."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\\n")).alias("line_no", "line"))
    lines = lines.select(key, "line_no", SF.py_strip("line").alias("line")).where(F.col("line") != "")
    return lines.select(key, "line_no", F.split("line", f"{SF.PY_WS}+").alias("cells"))


def to_columns(lines: DataFrame, n: int | None = None, key: str = "doc_id") -> DataFrame:
    """Cells as columns ``_0 .. _{n-1}`` (NULL when a line is shorter), a
    positional table. Without ``n`` the longest line sets the width (one
    number is read for that); with it, a longer line is an error."""
    if n is None:
        n = lines.agg(F.max(F.size("cells"))).first()[0] or 0
    else:
        too_long = F.raise_error(F.format_string("a line has %d cells", F.size("cells"))).cast("array<string>")
        lines = lines.withColumn("cells", F.when(F.size("cells") > n, too_long).otherwise(F.col("cells")))
    return lines.select(key, "line_no", *[F.try_element_at("cells", F.lit(i + 1)).alias(f"_{i}")
                                          for i in range(n)])
