"""Monthly series, seasonal naive forecast and growth.

All functions accept ``keys`` to run per property (or any other key) in
one job; windows are always partitioned by the keys and run over the
monthly series (one row per month), never over booking rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayspark.functions.labels import opportunity_label
from stayspark.operators.stats import dynamic_pricing
from stayspark.operators.summary import exact_avg, exact_sum, grouped, period_of, r2

METRIC_NAMES = ("ingresos", "reservas", "ppn_medio")


def join_on_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on the keys; with no keys both sides hold one row and are
    joined on a constant (still an equi-join, never a cartesian product)."""
    if keys:
        return a.join(b, list(keys), how)
    return a.withColumn("_k", F.lit(0)).join(F.broadcast(b.withColumn("_k", F.lit(0))), "_k", how).drop("_k")


def build_ts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A9 + N1: unrounded monthly series with forward-filled ``ppn_medio``."""
    g = grouped(df, keys, ["year_month"], ["reservas", "ingresos", "ppn_medio"], rounded=False)
    g = g.withColumn("period", period_of(F.col("year_month")))
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.withColumn("ppn_medio", F.last("ppn_medio", ignorenulls=True).over(w))


def seasonal_naive_forecast(df: DataFrame, horizon_months: int = 12, metric: str = "ingresos",
                            keys: Sequence[str] = (), min_history: int = 12) -> DataFrame:
    """Baseline (mean of the last 12 monthly rows, at least 3 values)
    x seasonal index of the month (1.0 if unseen) + yearly OLS slope / 12
    per step, floored at 0, +-20 % band. Keys with fewer than
    ``min_history`` months give no rows."""
    if metric not in METRIC_NAMES:
        raise ValueError(f"metric must be one of {METRIC_NAMES}")
    ts = build_ts(df, keys).select(*keys, "period", F.col(metric).cast("double").alias("y"))
    ts = ts.withColumn("month", F.month("period")).withColumn("year", F.year("period"))
    last_first = Window.partitionBy(*keys).orderBy(F.desc("period"))
    ts = ts.withColumn("_rn", F.row_number().over(last_first))
    stats = ts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_months"), F.max("period").alias("last_period"),
        F.avg("y").alias("overall"),
        F.avg(F.when(F.col("_rn") <= 12, F.col("y"))).alias("_base"),
        F.count(F.when(F.col("_rn") <= 12, F.col("y"))).alias("_base_n"))
    stats = stats.where(F.col("n_months") >= min_history).withColumn(
        "baseline", F.when(F.col("_base_n") >= 3, F.col("_base")))
    seasonal = ts.groupBy(*keys, "month").agg(F.avg("y").alias("m_avg"))
    annual = ts.groupBy(*keys, "year").agg(F.sum("y").alias("total"))
    annual = annual.withColumn("x", (F.col("year") - F.min("year").over(Window.partitionBy(*keys))).cast("double"))
    trend = annual.groupBy(*keys).agg(F.coalesce(F.regr_slope("total", "x"), F.lit(0.0)).alias("slope"))
    steps = join_on_keys(stats, trend, keys, "left")
    steps = steps.select(*keys, "last_period", "baseline", "overall",
                         (F.coalesce(F.col("slope"), F.lit(0.0)) / 12).alias("step"),
                         F.explode(F.sequence(F.lit(1), F.lit(horizon_months))).alias("i"))
    steps = steps.withColumn("period", F.add_months("last_period", F.col("i")))
    steps = steps.withColumn("month", F.month("period"))
    fc = steps.join(seasonal, [*keys, "month"], "left")
    idx = F.coalesce(F.try_divide(F.col("m_avg"), F.col("overall")), F.lit(1.0))
    idx = F.when(F.col("m_avg").isNull(), F.lit(1.0)).otherwise(idx)
    point = F.greatest(F.lit(0.0), F.col("baseline") * idx + F.col("step") * F.col("i"))
    fc = fc.withColumn("_pt", point)
    return fc.select(
        *keys, "period", F.date_format("period", "yyyy-MM").alias("year_month"), "month",
        r2(F.col("_pt")).alias("forecast"), r2(F.col("_pt") * 0.8).alias("ci_low"),
        r2(F.col("_pt") * 1.2).alias("ci_high"), F.col("month").isin(7, 8).alias("is_peak"),
    ).orderBy(*keys, "period")


def price_opportunity_calendar(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Demand tiers (A27) left-joined with the 12-month forecast on the
    month (J1) and an action label. The schema is fixed: without a forecast
    the forecast columns and the label are NULL."""
    pricing = dynamic_pricing(df, keys)
    fc = seasonal_naive_forecast(df, 12, "ingresos", keys).select(
        *keys, "month", F.col("forecast").alias("forecast_ingresos"), "is_peak")
    # <= 12 rows per key on the right side
    out = pricing.join(fc if keys else F.broadcast(fc), [*keys, "month"], "left")
    has_fc = F.max(F.col("forecast_ingresos").isNotNull().cast("int")).over(Window.partitionBy(*keys)) > 0
    return out.withColumn("oportunidad", F.when(has_fc, opportunity_label("demand_tier"))).orderBy(*keys, "month")


def growth_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """YoY of the last two years present, MoM of the last two months
    present, total, mean and best month (first on ties). One row per key."""
    ts = build_ts(df, keys)
    w_last = Window.partitionBy(*keys).orderBy(F.desc("period"))
    ts = ts.withColumn("_rn", F.row_number().over(w_last))
    annual = ts.groupBy(*keys, F.year("period").alias("year")).agg(F.sum("ingresos").alias("tot"))
    annual = annual.withColumn("_yr", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("year"))))
    yoy = annual.groupBy(*keys).agg(
        F.max(F.when(F.col("_yr") == 1, F.col("tot"))).alias("y1"),
        F.max(F.when(F.col("_yr") == 2, F.col("tot"))).alias("y2"),
        F.count(F.lit(1)).alias("n_years"))
    mo = ts.groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("ingresos"))).alias("m1"),
        F.max(F.when(F.col("_rn") == 2, F.col("ingresos"))).alias("m2"),
        F.count(F.lit(1)).alias("n_months"),
        exact_sum("ingresos").alias("total"), exact_avg("ingresos").alias("mean"),
        F.min_by("year_month", F.struct(-F.col("ingresos"), F.col("period"))).alias("best_month"))
    j = join_on_keys(mo, yoy, keys)
    pct = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(b)) * 100
    return j.select(
        *keys,
        F.when(F.col("n_years") >= 2, r2(pct("y1", "y2"), 1)).otherwise(0.0).alias("yoy_growth_pct"),
        F.when(F.col("n_months") >= 2, r2(pct("m1", "m2"), 1)).otherwise(0.0).alias("mom_growth_pct"),
        r2(F.col("total")).alias("total_revenue"), r2(F.col("mean")).alias("avg_monthly"),
        F.coalesce(F.col("best_month"), F.lit("-")).alias("best_month"))
