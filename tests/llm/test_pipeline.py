import os
import re

import corpus_pipeline as C

from stayspark.llm import quality
from stayspark.llm.common import held_out
from tests.llm import test_decontaminate, test_packing, test_pii, test_simhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels, train_on=~held_out(F.col("doc_id")))
    good = {r.id for r in quality.score(docs, model).where("score >= 0.3").collect()}
    seen, kept = docs, []
    for name, stage in C.STAGES:
        seen = C.written(stage(spark, seen, SF), "test")
        kept.append(seen)
        if name != "packing":
            assert seen.columns == docs.columns and seen.dtypes == docs.dtypes
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] == good and len(good) < len(rows)
    texts = [(i, rows[i].text) for i in sorted(good)]
    assert ids[1] == {c for _, _, c in test_simhash.brute(texts)}
    texts = [(i, t) for i, t in texts if i in ids[1]]
    assert ids[2] == {r[0] for r in test_decontaminate.brute(texts, bench, 13) if not r[-1]}
    assert ids[3] == ids[2] == ids[4]
    clean = {r.doc_id: r for r in kept[3].collect()}
    for i, r in clean.items():
        assert not test_pii.base(r.text) and r.n_chars == len(r.text)
        if not test_pii.base(rows[i].text) and "[" not in r.text:
            assert r.text == rows[i].text
    packed = [r.asDict() for r in kept[4].collect()]
    test_packing.verify([(i, r.text) for i, r in clean.items()], packed, 4096)
    again = [r.asDict() for r in C.run(spark, SF).collect()]
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"], r["length"])
    assert sorted(map(key, again)) == sorted(map(key, packed))


def test_odd_rows_pass_through(spark):
    rows = [(1, None, None, None, None, "x"), (None, "", "en", "s", 0, "x"), (2, "word " * 40, "en", "s", 200, "x"), (2, "word " * 40, "en", "s", 200, "x"),
            (3, "a b " * 30_000, None, None, 120_000, "x"), (4, "mail a@b.cd now", "en", "s", 15, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")
    # every name that a stage uses for columns of its own
    own = {n for f in ("common", "quality", "simhash", "components", "decontaminate", "pii", "packing") for n in
           re.findall(r"""["'](_?[a-z][a-z_]*)["']""", open(f"{os.path.dirname(quality.__file__)}/{f}.py").read())}
    df = df.withColumns({n: F.lit(7) for n in sorted(own) if n not in {c.lower() for c in df.columns}})
    assert {"_spans", "_span_id", "_span_key", "_bad_id", "_bad_key", "_some_id", "_some_key", "_text_key", "fingerprint", "row"} <= set(df.columns)
    for table in (df, df.where("false")):
        seen = table
        for name, stage in C.STAGES:
            seen = C.written(stage(spark, seen, SF), "test")
            if name != "packing":
                assert seen.columns == df.columns
        assert (seen.count() > 0) == (table is df)
