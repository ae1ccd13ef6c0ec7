"""Driver contract and plan shape checks."""

import __spark_entry__ as E
from stayspark.plans import fixtures as FX
from tests.conftest import SF_SMALL


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "pct_ingresos" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_rows_and_no_cartesian_in_main_queries(spark):
    qs = E.queries()
    for name in ["monthly_summary", "channel_summary", "outlier_report", "elasticity_fit", "forecast_12m",
                 "property_diagnosis", "market_upsert", "card_extract", "search_plan", "market_kpis"]:
        plan = _plan(qs[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_pushdown_and_pruning_on_scans(spark):
    df = FX.bookings_raw(spark, SF_SMALL).select("R_ID", "R_TOTAL_AMOUNT")
    plan = _plan(df)
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


def test_all_queries_run_small(spark):
    for name, build in E.queries().items():
        build(spark, SF_SMALL).limit(5).collect()


def test_money_is_cleaned_by_few_regexes(spark):
    """The amount's text is bound once: its regex stands in the filter and in
    the projection, and no other rule's text is copied into either."""
    df = E.queries()["monthly_summary"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^0-9.,") <= 3
    assert "percentile" not in plan and "doubleToLongBits" not in plan


def test_quantile_plans_are_small(spark):
    """Statistics are literals: the rows are read once more, nothing is
    shuffled for them."""
    plan = E.queries()["outliers_iqr"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    plan = E.queries()["market_kpis"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 10
