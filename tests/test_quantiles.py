"""Exact distributed quantiles and rank lookups against numpy / brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayspark.operators.market import count_below
from stayspark.operators.quantiles import attach, column_quantiles, exact_quantiles, order_key, small_quantile


def test_fixture_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = exact_quantiles(df, "x", {"q1": 0.25, "m": 0.5, "q3": 0.75}).first()
    assert (r.q1, r.m, r.q3, r.n) == (1.75, 2.5, 4.75, 4)


def test_matches_numpy_with_hot_value(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(100, 30, 3000), np.full(2000, 42.5), rng.integers(0, 50, 1000)])
    rows = [(float(v),) for v in vals] + [(None,)] * 10
    df = spark.createDataFrame(rows, "x double")
    probs = {"p0": 0.0, "p05": 0.05, "q1": 0.25, "m": 0.5, "q3": 0.75, "p95": 0.95, "p100": 1.0}
    r = exact_quantiles(df, "x", probs).first()
    for k, p in probs.items():
        assert r[k] == pytest.approx(float(np.quantile(vals, p)), rel=0, abs=1e-9), k
    assert r.n == len(vals)


def test_radix_order_and_extremes(spark):
    """Keys order as numbers do; signs, zeros, denormals, infinities and
    values that share 48 bits are told apart."""
    x = [0.0, -0.0, 5e-324, -5e-324, 1.0, float(np.nextafter(1, 2)), float(np.nextafter(1, 0)), -1.0, 1e308, -1e308, float("inf"), float("-inf"), 2.0 ** -1022, 42.5, -42.5]
    df = spark.createDataFrame([(v,) for v in x] + [(float("nan"),), (None,)], "x double")
    got = [r.x for r in df.where("x is not null and not isnan(x)").orderBy(order_key(F.col("x")), "x").collect()]
    assert got == sorted(x)
    probs = {f"r{i}": i / (len(x) - 1) for i in range(len(x))}
    r = exact_quantiles(df, "x", probs, neighbors=True).first()
    assert r.n == len(x) and [r[f"r{i}_a"] for i in range(len(x))] == sorted(x)
    close = [float(v) for v in np.nextafter(100.0, 200.0) + np.arange(40) * 1e-13]
    d = spark.createDataFrame([(v,) for v in close], "x double")
    assert exact_quantiles(d, "x", {"m": 0.37}).first().m == pytest.approx(np.quantile(close, 0.37), rel=0, abs=0)


def test_attach_takes_one_row_only(spark):
    df = spark.range(3)
    assert attach(df, "s", spark.createDataFrame([(1, "a")], "x int, y string")).select("s.y").collect() == [("a",)] * 3
    assert attach(df, "s", spark.createDataFrame([], "x int")).where("s is null").count() == 3
    with pytest.raises(Exception, match="more than one row"):
        attach(df, "s", spark.createDataFrame([(1,), (2,)], "x int")).collect()


def test_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    r = exact_quantiles(df, "x", {"m": 0.5}).first()
    assert r.m is None and r.n == 0


def test_small_quantile(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in [(1, 1), (1, 2), (1, 3), (1, 10), (2, 5)]], "k int, v double")
    got = {r.k: r.q for r in df.groupBy("k").agg(small_quantile("v", 0.75).alias("q")).collect()}
    assert got == {1: 4.75, 2: 5.0}


def test_count_below_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vals = [float(x) for x in rng.integers(0, 100, 2000)] + [50.0] * 700
    probes = [-1.0, 0.0, 13.5, 50.0, 99.0, 150.0]
    v = spark.createDataFrame([(x,) for x in vals], "p double")
    pr = spark.createDataFrame([(i, x) for i, x in enumerate(probes)], "id int, price double")
    got = {r.id: r.n_below or 0 for r in count_below(v, "p", pr, "price", buckets=7).collect()}
    assert got == {i: sum(1 for x in vals if x < p) for i, p in enumerate(probes)}


def test_rank_lookup_does_not_depend_on_partitions(spark):
    """20,000 probes with AQE dealing both sides differently."""
    conf = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rng = np.random.default_rng(5)
        vals, probes = np.round(rng.normal(100, 30, 30_000), 1), np.round(rng.normal(100, 40, 20_000), 1)
        v = spark.createDataFrame([(float(x),) for x in vals], "p double")
        pr = spark.createDataFrame([(i, float(x)) for i, x in enumerate(probes)] + [(-1, None)], "id int, price double")
        got = {r.id: r.n_below for r in count_below(v, "p", pr, "price").collect()}
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert got.pop(-1) is None
    want = np.searchsorted(np.sort(vals), probes)
    assert [got[i] for i in range(len(probes))] == want.tolist()


def test_column_quantiles(spark):
    df = spark.createDataFrame([(1.0, 5, None), (2.0, None, None), (4.0, 7, None)], "a double, b int, c double")
    r = column_quantiles(df, ["a", "b", "c"], 0.5).first()
    assert (r.a, r.b, r.c) == (2.0, 6.0, None)
