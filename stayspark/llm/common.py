"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, written

__all__ = ["ensure_checkpoint_dir", "free_name", "held_out", "small_enough", "table", "wide", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no classifier learns from (a null id
    is not held out, and has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until ``df`` has no such column
    (compared without case, as Spark does)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows (reads no more than it must)."""
    return df.limit(rows + 1).count() <= rows


def wide(spark: SparkSession, at_least: int = 1) -> int:
    """Partitions for a spread: the session's shuffle partitions."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
