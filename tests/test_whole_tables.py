"""Queries take every row of their tables."""

from bisect import bisect_left

import __spark_entry__ as E
from stayspark.plans import fixtures as FX
from tests.conftest import SF_SMALL


def test_price_rank_has_every_order(spark):
    got = [tuple(r) for r in E.queries()["customer_price_rank"](spark, SF_SMALL).collect()]
    prices = sorted(float(r.p) for r in FX.market(spark, SF_SMALL).selectExpr("CAST(precio_noche AS DOUBLE) AS p").collect() if r.p is not None)
    want = {r.o_orderkey: None if r.o_orderkey % 3 == 1 else bisect_left(prices, r.o_totalprice / (1 + r.o_orderkey % 7))
            for r in FX.table(spark, SF_SMALL, "orders").select("o_orderkey", "o_totalprice").collect()}
    assert len(got) == len(want) and dict(got) == want
    assert {k % 3 for k in want} == {0, 1, 2}


def test_raw_mode_has_every_property(spark, tmpdir_path):
    n = 40
    tables = {"nation": ([(i, f"N{i}") for i in range(n)], "n_nationkey long, n_name string"),
              "customer": ([(i, i) for i in range(n)], "c_custkey long, c_nationkey long"),
              "orders": ([(2 * i + j, i, 10.0 * i + j) for i in range(n) for j in range(2)], "o_orderkey long, o_custkey long, o_totalprice double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmpdir_path}/{name}.parquet")
    got = sorted(tuple(r) for r in E.queries()["raw_mode_properties"](spark, tmpdir_path).collect())
    assert got == sorted((f"N{i}", 2, 20.0 * i + 1, 10.0 * i + 0.5) for i in range(n))
