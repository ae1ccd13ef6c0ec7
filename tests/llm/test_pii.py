import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from stayspark.llm import pii as P, queries


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def base(text):
    out = []
    text = text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def named(spans):
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    None, "", "nothing", "a@b.c", "a@b.c_d@e.f", "a@b.c.", "x@y@z.w", "@a.b", "a@b", "é+tag%x@mail-1.example.com, next.a@b.co.uk;c@d.e",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.0.0.00", "1.2.3", "1..2.3.4", "9" * 400 + ".1.1.1", "1.1.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111111111111112", "12--4111111111111111", "4111 1111 1111 111 1 5",
    "0 4111111111111111", "4111  1111 1111 1111", "é4111111111111111é", "1" * 19 + "0" * 3,
    "+1 (269) 555-3296 4524132264652876", "+1 (499) 555-6503", "+1", "++49 30 1234567 8.", "+1 2-3-4-5-6-7-8-9-0)", "+12 345 678 90 12345",
    "+1.2.3.4.5555555", "𝕏𝕐 +1 (499) 555-6503 𝕏 a@b.cd 1.2.3.4", "call (212) 555-1234 now", "write jo [at] mail [dot] com",
    "host 2001:0db8:0000:0000:0000:ff00:0042:8329 up", "version 4111111111111111", "a " * 2000 + "z@z.zz", "1" * 900,
    "a" * 900 + "@", "+1" + " " * 900, "1.1" * 400, "1 2-" * 400,
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(None if i in (0, 4) else i, t, "clash") for i, t in enumerate(TEXTS + TEXTS[3:8])]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string").withColumn("id", F.lit(1)).repartition(4)


def test_base_spans(frame):
    got = sorted((str(r.id), r.base, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in P.summary(frame).collect())
    want = []
    for i, t in enumerate(TEXTS + TEXTS[3:8]):
        s = base(t)
        want.append((str(None if i in (0, 4) else i), named(s), *[sum(k == a for _, k, _ in s) for a in range(4)]))
    assert got == sorted(want)


def test_added_spans(frame):
    out = {r.id: r for r in P.summary(frame).collect()}
    at = lambda t: TEXTS.index(t)
    r = out[at("+1 (269) 555-3296 4524132264652876")]
    assert r.base == "" and r.spans == "phone:0:17,card:18:34"
    for r in out.values():
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    for t in ("nothing", "4111111111111112", "256.1.1.1"):
        assert out[at(t)].spans == ""


def test_redact(spark):
    rows = [(1, "to a@b.cd, 1.2.3.4!", 9, None), (2, None, 9, 2.0), (3, "+1.2.3.4.5555555 x", 9, None), (None, "é 𝕏 a@b.cd", 9, None),
            (None, "é 𝕏 a@b.cd", 9, None), (5, "clean", 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, start double")
    out = P.redact(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in out.collect())
    assert got == sorted([("1", "to [EMAIL], [IP]!", 17), ("2", None, 9), ("3", "[PHONE] x", 9), ("None", "é 𝕏 [EMAIL]", 11),
                          ("None", "é 𝕏 [EMAIL]", 11), ("5", "clean", 5)], key=lambda x: (x[0], x[1] or ""))
    assert P.redact(df.where("false")).count() == 0 and P.summary(df.where("false")).count() == 0


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op4_pii"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    added = 0
    for d in docs:
        want = named(base(d.text))
        assert got[d.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        added += len(got[d.doc_id].spans.split(",")) - len(want.split(","))
    assert 0 <= added < 30


def test_em_learns_reliability():
    import numpy as np
    rnd = np.random.default_rng(0)
    truth = rnd.random(4000) < 0.7
    right = np.array([0.97, 0.9, 0.8, 0.6, 0.85])
    vote = np.where(rnd.random((4000, 5)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    pat, at, n = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    model, p = P.estimate(np.zeros(len(n), int), pat, n.astype(float))
    assert ((p[at.ravel()] > 0.5) == truth).mean() > 0.95
    acc = model.table[0, 1:, 1, 2]
    assert acc[0] > acc[2]


def test_long_texts_take_linear_time(spark):
    n = 300_000
    texts = ["1" * n, "a" * n + "@", "+1" + " " * n, "1.1" * n, "1 2-" * n, "a@" * n, "1." * n, "+1" * n, "1:" * n, "(at)" * n, "1234 " * n]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    start = time.time()
    assert P.summary(df).count() == len(texts)
    assert time.time() - start < 120
