import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stayspark.llm import suffix_dedup as S


def brute(rows, length):
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - length + 1):
                s = t[p:p + length]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        if i is not None:
            for p in range(len(t) - length + 1):
                if least[t[p:p + length]] < i:
                    gone[p:p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((str(i), len(t), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6), st.integers(8, 40))
def test_prefix_doubling(texts, length):
    text = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    at, rank = S.equal_strings(text, ends, length)
    strings = {}
    for t, e in zip(texts, ends):
        for p in range(len(t) - length + 1):
            strings.setdefault(t[p:p + length], set()).add(int(e - len(t) + p))
    got = {}
    for p, r in zip(at.tolist(), rank.tolist()):
        got.setdefault(r, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in strings.values() if len(v) > 1)


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage = prose(12), prose(60)
    rows = []
    for i in range(60):
        parts = [prose(rnd.randint(0, 30)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, line)
        if i % 5 == 0:
            parts.insert(2, passage[rnd.randint(0, 30):])
        rows.append((i * 3 + 1, "\n".join(parts)))
    rows += [(500 + i, rows[7][1]) for i in range(3)] + [(2, rows[7][1])]
    rows += [(700, "a" * 900), (701, "b" + "a" * 300), (702, "ab" * 200), (703, None), (704, ""), (705, "x" * 49), (706, "x" * 50), (705, "x" * 50),
             (None, line + passage), (None, line + passage), (707, line), (707, line)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("length", [24, 50])
def test_matches_brute_force(spark, monkeypatch, small, length):
    if small:  # many blocks and buckets, hot classes
        for name, value in (("BLOCK_BYTES", 700), ("BUCKET_BYTES", 500), ("HOT", 4)):
            monkeypatch.setattr(S, name, value)
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, block string").withColumn("id", F.lit(1)).repartition(3)
    got = sorted((str(r.id), r.n_bytes, [(x.start, x.end) for x in r.removed], bytes(r.kept)) for r in S.remove_repeats(df, length).collect())
    assert got == brute(rows, length)


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).count() == 0
    some = spark.createDataFrame([(1, "a" * 100)], "doc_id long, text string")
    out = S.remove_repeats(some)
    assert out.count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    with pytest.raises(ValueError):
        S.remove_repeats(df, 10)


def test_a_digest_leaves_a_block_once():
    import pyarrow as pa
    row = (7, np.arange(300, 0, -1).astype("<i8").tobytes(), np.r_[np.ones(299, np.uint8), np.uint8(0)].tobytes(), b"", b"d" * 16 * 298 + b"e" * 32, b"")
    sent = pa.Table.from_batches(S._digest_batches(iter(S._table([row], S._BLOCK).to_batches()))).to_pylist()
    assert [(r["digest"], r["id"], r["block"], r["row"]) for r in sent] == [(b"d" * 16, 3, 7, 297), (b"e" * 16, 2, 7, 298)]


@pytest.mark.parametrize("listed", [0, 100])
def test_copies_over_many_blocks(spark, monkeypatch, listed):
    for name, value in (("BLOCK_BYTES", 200), ("HOT_BLOCKS", 2), ("HOT_DIGESTS", listed)):
        monkeypatch.setattr(S, name, value)
    a, b, c = "common text " * 6, "another one " * 5, "a" * 40
    rows = [(i, a if i % 3 else c) for i in range(40, 0, -1)] + [(50, b), (49, b), (-5, b), (51, ""), (52, None), (None, a), (1, a), (60, a + b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.id), r.n_bytes, [(x.start, x.end) for x in r.removed], bytes(r.kept)) for r in S.remove_repeats(df).collect())
    assert got == brute(rows, S.LENGTH)
