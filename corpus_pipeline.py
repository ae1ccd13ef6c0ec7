"""Corpus pipeline over ``documents``: quality classifier, SimHash near-dedup,
benchmark decontamination, personal data, best-fit packing.

Every stage takes (spark, docs, sf_dir), calls one operator of
``stayspark.llm`` on all rows that its predecessor kept, and is written as
Parquet in the shared checkpoint folder before the next one reads it, so that
a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayspark.llm import decontaminate, packing, pii, quality, simhash
from stayspark.llm.common import held_out, table, written
from stayspark.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject (score of 0.3 or more)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels, train_on=~held_out(F.col("doc_id")))
    return quality.keep_good(docs, model, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each SimHash component."""
    return simhash.drop_near_duplicates(docs, words=4, max_bits=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences of 4096 tokens."""
    out = packing.pack_documents(docs, tokenizer_path(), keep={"ids_crc32": F.crc32("ids")})
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

#: A fitted model and a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
