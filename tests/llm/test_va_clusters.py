import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayspark.llm import va_clusters


def brute(rows, k, rounds, dims, scale=1024):
    """Plain k-means on Python integers: sorted rows of the whole result."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda: [min(range(len(c)), key=lambda j: (dist(v, c[j]), j)) for _, v in kept]
    for _ in range(rounds):
        at = place()
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    at = place()
    d = [dist(v, c[a]) for (_, v), a in zip(kept, at)]
    return sorted((str(i), a, x, sum(y for y, b in zip(d, at) if b == a), sum(d),
                   hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d))


def run(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {"id": F.lit("clash"), "cluster": F.lit(1), "vec": F.lit(2), "block": F.lit(3)}).repartition(parts)
    out = va_clusters.cluster(df, **how)
    assert out.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def vectors(n, dim, seed, spread=0.05):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(11, dim))[rnd.integers(0, 11, n)] + spread * rnd.normal(size=(n, dim))
    x[: n // 3] = x[0]  # a third of the rows are one vector
    return [(int(i), [float(np.float32(t)) for t in v]) for i, v in enumerate(x)]


ODD = [(900, None), (901, []), (902, [1.0]), (903, [float("nan")] * 6), (904, [1.0] * 5 + [None]), (905, [float("-inf")] * 6), (None, [0.5] * 6),
       (None, None), (7, [9.0] * 6), (7, [9.0] * 6), (8, [-90.0, 3.0, 1e-9, -1e-9, 0.0, -0.0])]


@pytest.mark.parametrize("bits", [2, 5, 8])
@pytest.mark.parametrize("block", [7, 1024])
def test_matches_brute_force(spark, monkeypatch, bits, block):
    monkeypatch.setattr(va_clusters, "BLOCK", block)
    monkeypatch.setattr(va_clusters, "SAMPLE_ROWS", 50)
    rows = vectors(230, 6, bits) + ODD
    assert run(spark, rows, k=5, rounds=4, dims=6, bits=bits) == brute(rows, 5, 4, 6)


def test_without_structure_and_ties(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.integers(-2, 3, 3)]) for i in range(150)]
    for rounds in (0, 1, 10):
        assert run(spark, rows, k=8, rounds=rounds, dims=3, scale=1) == brute(rows, 8, rounds, 3, 1)


def test_structure_saves_fetches(spark):
    told = []
    rows = vectors(600, 16, 9, 0.01)
    assert run(spark, rows, k=6, rounds=6, dims=16, told=told) == brute(rows, 6, 6, 16)
    assert told and max(told) < 600


def test_few_equal_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert run(spark, rows, k=8, dims=2) == brute(rows, 8, 10, 2)
    assert run(spark, [(1, None), (2, [1.0])], k=8, dims=2) == []
    assert va_clusters.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_text_ids_doubles_and_too_large(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", [3.0]), ("c", [8.0])], "vec_id string, embedding array<double>")
    got = {r.id: r.cluster for r in va_clusters.cluster(df, k=2, dims=1).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == got["b"] != got["c"]
    with pytest.raises(Exception, match="beyond"):
        va_clusters.cluster(spark.createDataFrame([("a", [1e30])], df.schema), dims=1).count()


def test_intervals_hold_the_distance():
    rnd = np.random.default_rng(5)
    v = rnd.integers(-900, 900, (300, 4))
    bounds = va_clusters._bounds(v[:40], 4, 4)
    t = va_clusters._Tables(rnd.integers(-900, 900, (5, 4)), bounds)
    cells = np.stack([np.searchsorted(bounds[d], v[:, d], side="right") for d in range(4)], 1).astype(np.uint8)
    lo, hi = t.intervals(cells, np.concatenate([v.min(0), v.max(0)]))
    middle = t.c.sum(0) // 5
    exact = ((v[:, None] - t.c[None]) ** 2).sum(2) - ((v - middle) ** 2).sum(1)[:, None]
    assert (lo <= exact).all() and (exact <= hi).all()
