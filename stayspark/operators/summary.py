"""Grouped booking summaries.

Every function takes the cleaned, confirmed bookings and optional extra
grouping ``keys`` (e.g. ``["property"]``) so one job serves all properties;
the default reproduces the single-table result. NULL group keys are dropped
(as a pandas ``groupby`` does) and sums of nothing are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayspark import schema as S
from stayspark.functions.bookings import _pick
from stayspark.session import written


def r2(c: Column, d: int = 2) -> Column:
    """Half-even rounding (pandas ``round``)."""
    return F.bround(c, d)


def exact_sum(col: str) -> Column:
    """Sum of money (to ten decimals a row) as an exact decimal, returned as
    double: the result does not depend on the order rows are added in (partitions, retries), so a
    rounded mean that sits on a half-way point rounds the same every time.
    Amounts of 28 integer digits and ten decimals are kept; a larger one (or
    an infinity) is an error, not a silent NULL."""
    x = F.col(col)
    exact = x.try_cast("decimal(38,10)")
    too_large = F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.raise_error(F.lit(f"{col}: beyond 28 integer digits")).cast("decimal(38,10)"))
    return F.sum(F.coalesce(exact, too_large)).cast("double")


def exact_avg(col: str) -> Column:
    return exact_sum(col) / F.count(col)


METRICS = {
    "reservas": lambda: F.count("amount"),
    "ingresos": lambda: F.coalesce(exact_sum("amount"), F.lit(0.0)),
    "ticket_medio": lambda: exact_avg("amount"),
    "noches_totales": lambda: F.coalesce(F.sum("nights"), F.lit(0.0)),
    "ppn_medio": lambda: exact_avg("price_per_night"),
}


def metrics(names: Sequence[str], rounded: bool = True) -> list[Column]:
    out = []
    for n in names:
        c = METRICS[n]()
        out.append((c if n == "reservas" or not rounded else r2(c)).alias(n))
    return out


def grouped(df: DataFrame, keys: Sequence[str], by: Sequence[str], names: Sequence[str],
            rounded: bool = True) -> DataFrame:
    cond = F.lit(True)
    for k in by:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys, *by).agg(*metrics(names, rounded))


def monthly_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A1: by month number, short name, revenue share of the rounded sums."""
    g = grouped(df, keys, ["month"], ["reservas", "ingresos", "ticket_medio",
                                      "noches_totales", "ppn_medio"])
    total = F.sum("ingresos").over(Window.partitionBy(*keys))  # <= 12 rows per key
    return (g.withColumn("month_name", _pick(S.MONTH_ES_SHORT, F.col("month")))
            .withColumn("pct_ingresos", r2(F.try_divide(F.col("ingresos"), total) * 100, 1))
            .orderBy(*keys, "month"))


def quarterly_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A2."""
    return grouped(df, keys, ["quarter"], ["reservas", "ingresos", "ticket_medio", "ppn_medio"]
                   ).orderBy(*keys, "quarter")


def _ordinal(col: str, labels: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(col))


def dow_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A3: Monday first."""
    g = grouped(df, keys, ["dow"], ["reservas", "ingresos", "ppn_medio"])
    return g.where(_ordinal("dow", S.DOW_ES) > 0).orderBy(*keys, _ordinal("dow", S.DOW_ES))


def seasonal_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A4: winter first."""
    g = grouped(df, keys, ["season"], ["reservas", "ingresos", "ticket_medio", "ppn_medio"])
    return g.where(_ordinal("season", S.SEASON_ORDER) > 0).orderBy(
        *keys, _ordinal("season", S.SEASON_ORDER))


def channel_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A5: by channel, revenue descending, commission and net revenue."""
    from stayspark.functions.labels import channel_commission
    g = grouped(df, keys, ["channel"], ["reservas", "ingresos", "ticket_medio", "ppn_medio"])
    return (g.withColumn("comision_est", channel_commission("channel"))
            .withColumn("ingresos_netos", r2(F.col("ingresos") * (1 - F.col("comision_est"))))
            .orderBy(*keys, F.desc("ingresos"), "channel"))


def property_summary(df: DataFrame, top_n: int = 20) -> DataFrame:
    """Top-N properties by revenue (TakeOrderedAndProject)."""
    g = grouped(df, [], ["property"], ["reservas", "ingresos", "ticket_medio",
                                       "noches_totales", "ppn_medio"], rounded=False)
    top = g.orderBy(F.desc("ingresos"), "property").limit(top_n)
    return top.select("property", "reservas", *[r2(F.col(c)).alias(c) for c in
                                                ["ingresos", "ticket_medio", "noches_totales", "ppn_medio"]])


def yearly_trend(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A7."""
    return grouped(df, keys, ["year"], ["reservas", "ingresos", "ticket_medio", "ppn_medio"]
                   ).orderBy(*keys, "year")


def period_of(ym: Column) -> Column:
    return F.to_date(F.concat(ym, F.lit("-01")))


def time_series_monthly(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per year-month with its first day as ``period``."""
    g = grouped(df, keys, ["year_month"], ["reservas", "ingresos", "ppn_medio"])
    return g.withColumn("period", period_of(F.col("year_month"))).orderBy(*keys, "period")


def monthly_heatmap(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A10: year x month booking counts; all 12 month columns, gaps 0."""
    g = (df.where(F.col("year").isNotNull() & F.col("month").isNotNull())
         .groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.count("amount")))
    g = g.fillna(0, subset=[str(m) for m in range(1, 13)])
    return g.select(*keys, "year", *[F.col(str(m)).alias(S.MONTH_ES_SHORT[m - 1])
                                     for m in range(1, 13)]).orderBy(*keys, "year")


def property_month_revenue(df: DataFrame) -> DataFrame:
    """A11, long form: revenue per (property, year_month) present."""
    return (df.where(F.col("property").isNotNull() & F.col("year_month").isNotNull())
            .groupBy("property", "year_month")
            .agg(F.coalesce(exact_sum("amount"), F.lit(0.0)).alias("ingresos")))


def property_month_rows(df: DataFrame) -> DataFrame:
    """A11 as sparse rows: one ``map<year_month, revenue>`` per property, in
    month order; as many entries as the property has months."""
    month = F.struct("year_month", "ingresos")
    return property_month_revenue(df).groupBy("property").agg(
        F.map_from_entries(F.array_sort(F.collect_list(month))).alias("ingresos_por_mes"))


def property_month_matrix(df: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """A11, wide form: one column per year-month, gaps 0.

    With a given list of ``months`` (a calendar) this is one lazy plan; months
    outside the list have no column. Without one, the columns are the months
    that occur: the sparse rows are written once, and the distinct months (a
    list bounded by the calendar, not by the data) are read from them.
    """
    rows = property_month_rows(df)
    if months is None:
        rows = written(rows, "property_months")
        months = sorted(r.m for r in rows.select(F.explode(F.map_keys("ingresos_por_mes")).alias("m")).distinct().collect())
    return rows.select("property", *[F.coalesce(F.try_element_at("ingresos_por_mes", F.lit(m)), F.lit(0.0)).alias(m) for m in months])


def property_peaks_valleys(df: DataFrame) -> DataFrame:
    """Per property best / worst month and monthly mean, best first.
    Ties: the earliest month wins."""
    m = property_month_revenue(df)
    g = m.groupBy("property").agg(
        F.min_by("year_month", F.struct(-F.col("ingresos"), F.col("year_month"))).alias("mes_pico"),
        F.max("ingresos").alias("valor_pico"),
        F.min_by("year_month", F.struct(F.col("ingresos"), F.col("year_month"))).alias("mes_valle"),
        F.min("ingresos").alias("valor_valle"),
        exact_avg("ingresos").alias("media_mensual"),
    )
    return g.select(F.col("property").alias("propiedad"), "mes_pico", "valor_pico", "mes_valle", "valor_valle", "media_mensual"
                    ).orderBy(F.desc("valor_pico"), "propiedad")
