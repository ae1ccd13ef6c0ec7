import numpy as np
import pytest
from pyspark.sql import functions as F

from stayspark.llm import topk


def brute(rows, k):
    ints = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in ints if i % 20 == 0}:
        s = sorted((-sum(a * b for a, b in zip(x, y)), d) for i, x in ints if i == q for d, y in ints if d != q and len(x) == len(y))
        out += [(q, r + 1, d, -x) for r, (x, d) in enumerate(s[:k])]
    return sorted(out)


def vectors(n, dim, seed):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(9, dim))
    x = c[rnd.integers(0, 9, n)] + 0.1 * rnd.normal(size=(n, dim))
    x[: n // 4] = x[0]  # a hot vector
    return [(int(i), [float(np.float32(t)) for t in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many centers, blocks, query groups and leaves
        for name, value in (("ROWS_PER_CENTER", 40), ("BLOCK", 16), ("QUERY_GROUP", 7), ("QUERY_TREE", 4), ("LEAF", 3), ("SAMPLE_ROWS", 90), ("POINTS_PER_CHILD", 1), ("POINTS", 5)):
            monkeypatch.setattr(topk, name, value)
    rows = vectors(400, 8, 1)
    rows += [(1001, None), (1020, [1.0, None] * 4), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (None, [1.0] * 8),
             (1100, [0.0] * 8), (1120, [1.0, 2.0]), (1121, [3.0, -2.0]), (1140, []), (1141, [])]
    # rows repeated with an equal vector: a query, a candidate, and one that is both
    rows += [(20, rows[20][1]), (3, rows[3][1]), (3, rows[3][1]), (40, rows[40][1]), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).repartition(4)
    got = topk.top_k(df, F.col("id") % 20 == 0, k=7).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 7)


def test_few_and_none(spark):
    df = spark.createDataFrame([(20, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0).collect()] == [(20, 1, 3, 64 * 128)]
    assert topk.top_k(df.where("false"), F.col("id") % 20 == 0).count() == 0
    assert topk.top_k(df, F.col("id") < 0).count() == 0


def test_tree_covers_and_prunes():
    rnd = np.random.default_rng(2)
    x = np.floor(64 * (rnd.normal(size=(6, 5))[rnd.integers(0, 6, 900)] + 0.05 * rnd.normal(size=(900, 5))))
    t = topk.CoverTree(x)
    assert sorted(t.perm) == list(range(900))
    for n in range(len(t.center)):
        below = x[t.perm[t.lo[n]: t.hi[n]]]
        assert np.linalg.norm(below - x[t.center[n]], axis=1).max() <= t.radius[n] + 1e-9
        kids = t.children[n]
        c = x[[t.center[j] for j in kids]]
        for i in range(len(kids)):
            apart = np.linalg.norm(c[i + 1:] - c[i], axis=1)
            assert (apart > t.radius[n] / 2).all()


@pytest.mark.parametrize("small", [False, True])
def test_repeated_ids_with_different_vectors(spark, monkeypatch, small):
    if small:
        for name, value in (("ROWS_PER_CENTER", 40), ("BLOCK", 16), ("QUERY_GROUP", 7), ("QUERY_TREE", 4), ("LEAF", 3), ("POINTS_PER_CHILD", 1), ("POINTS", 5)):
            monkeypatch.setattr(topk, name, value)
    # A hot id, repeated queries (one of them of two lengths) and candidates.
    rows = [(i % 90 if i % 3 else 7, v) for i, v in vectors(300, 6, 3)] + [(20, [9.0, 1.0]), (5, [2.0, 3.0]), (5, [4.0, 5.0])]
    rows = [(i, list(v)) for i, v in {(i, tuple(v)) for i, v in rows}]
    ints = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want = []
    for q in {i for i, _ in rows if i % 20 == 0}:
        s = sorted((-sum(a * b for a, b in zip(x, y)), d) for i, x in ints if i == q for d, y in ints if d != q and len(x) == len(y))
        want += [(q, r + 1, d, -x) for r, (x, d) in enumerate(s[:7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, k=7).collect()) == sorted(want)
