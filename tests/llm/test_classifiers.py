import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayspark.llm import quality, queries, toxicity
from stayspark.llm.common import held_out

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.85), ("op8_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    cut = 0.5 if label == "toxic" else 0.3
    for r in out:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    test = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(test) > 40
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) >= least


@pytest.mark.parametrize("m,label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, m, label):
    rows = [(1, "you awful fool " * 40, 9), (2, "a calm day by the river. " * 30, 9), (2, "a calm day by the river. " * 30, 9),
            (None, "x", 9), (4, None, 9), (5, "", 9), (6, " \n ", 9), (7, "long " * 200_000, 9), (8, "!!", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("id", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], f"doc_id long, {label} int")
    got = m.score(docs, m.fit(docs, labels))
    assert got.count() == len(rows) and got.where("score between 0 and 1").count() == len(rows)
    none = m.fit(docs, labels.where("false"))
    assert m.score(docs, none).where("score = 0.5").count() == len(rows)
    assert m.score(docs.where("false"), none).count() == 0
    again = m.score(docs, m.fit(docs.repartition(3), labels))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_held_out_rows_do_not_train(spark):
    ids = [i for i in range(200)]
    docs = spark.createDataFrame([(i, "bad worse" if i % 2 else "good better") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i % 2) ^ int(held(i))) for i in ids], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels, train_on=~held_out(F.col("doc_id")), rates=toxicity.Rates(l1=0.5)))
    wrong = [r for r in out.collect() if (r.score >= 0.5) != bool(r.id % 2)]
    assert not wrong


def test_keep_good(spark):
    docs = spark.createDataFrame([(1, "a", 2.5), (None, None, None)], "doc_id long, text string, x double")
    yes, no = quality.Model(constant=3.0), quality.Model(constant=-3.0)
    assert quality.keep_good(docs, yes).collect() == docs.collect()
    assert quality.keep_good(docs, no).count() == 0
