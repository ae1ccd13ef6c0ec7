"""Registered queries: name -> Spark builder, plus DuckDB oracle SQL.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's tables (through the views of :mod:`stayspark.plans.fixtures`);
same rules for DuckDB; floats are rounded half-even in both engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark import schema as S
from stayspark.functions.listing import rating_value, review_count
from stayspark.functions.text import plain_number
from stayspark.operators import clean as CL
from stayspark.operators import forecast as FC
from stayspark.operators import market as MK
from stayspark.operators import planner as PL
from stayspark.operators import property as PR
from stayspark.operators import stats as ST
from stayspark.operators import summary as SM
from stayspark.plans import fixtures as FX
from stayspark.plans.oracle import (BOOKINGS_RAW, CARDS, HAS_NULLS, MARKET, MONTHS_LONG, MONTHS_SHORT,
                                    q_agg, rnd, with_bookings, with_views)

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r2(c, d=2):
    return F.bround(c, d)


def rcols(df: DataFrame, cols, d=2) -> DataFrame:
    """Round the given float columns (half-even) in place."""
    return df.withColumns({c.strip("`"): F.bround(F.col(c), d) for c in cols})


def xsum(col: str) -> str:
    """Exact decimal sum of doubles, back as the nearest double. Both casts go
    through text: DuckDB's direct ones scale by a power of ten in binary."""
    return f"CAST(CAST(sum(CAST(CAST({col} AS VARCHAR) AS DECIMAL(38,10))) AS VARCHAR) AS DOUBLE)"


XSUM = xsum("amount")
XPPN = xsum("price_per_night")
XAVG = f"({XSUM} / count(amount))"
SQL_METRIC = {
    "reservas": "count(amount) AS reservas",
    "ingresos": f"{rnd(f'coalesce({XSUM}, 0.0)')} AS ingresos",
    "ticket_medio": f"{rnd(XAVG)} AS ticket_medio",
    "noches_totales": f"{rnd('coalesce(sum(nights), 0.0)')} AS noches_totales",
    "ppn_medio": f"{rnd(XPPN + ' / count(price_per_night)')} AS ppn_medio",
}


def sql_grouped(by: str, names: list[str], table: str = "bookings") -> str:
    cols = ", ".join(SQL_METRIC[n] for n in names)
    return f"SELECT {by}, {cols} FROM {table} WHERE {by} IS NOT NULL GROUP BY {by}"


ALL5 = ["reservas", "ingresos", "ticket_medio", "noches_totales", "ppn_medio"]
MONTHLY_SQL = f"""monthly AS (
  SELECT *, {MONTHS_SHORT}[month] AS month_name,
         {rnd('ingresos / sum(ingresos) OVER () * 100', 1)} AS pct_ingresos
  FROM ({sql_grouped('month', ALL5)}))"""

# ---------------------------------------------------------------------------
# Bookings cleaning
# ---------------------------------------------------------------------------


@register("clean_amount", with_bookings("SELECT id, amount FROM bookings_clean"))
def q_clean_amount(spark, sf):
    return FX.bookings_clean(spark, sf).select("id", "amount")


@register("classify_status", with_bookings(
    "SELECT status, status_group, count(*) AS n FROM bookings_clean GROUP BY status, status_group"))
def q_classify_status(spark, sf):
    return FX.bookings_clean(spark, sf).groupBy("status", "status_group").agg(F.count(F.lit(1)).alias("n"))


@register("normalize_channel", with_bookings(
    "SELECT source, channel, count(*) AS n FROM bookings_clean GROUP BY source, channel"))
def q_normalize_channel(spark, sf):
    return FX.bookings_clean(spark, sf).groupBy("source", "channel").agg(F.count(F.lit(1)).alias("n"))


@register("nights_filled", with_bookings("SELECT id, nights FROM bookings_clean"))
def q_nights_filled(spark, sf):
    return FX.bookings_clean(spark, sf).select("id", "nights")


@register("price_per_night", with_bookings("SELECT id, price_per_night FROM bookings_clean"))
def q_price_per_night(spark, sf):
    return FX.bookings_clean(spark, sf).select("id", "price_per_night")


TEMPORAL = ["month", "month_name", "month_short", "year", "quarter", "season", "dow", "week_num",
            "is_weekend", "is_holiday", "year_month"]


@register("temporal_enrich", with_bookings(f"SELECT id, {', '.join(TEMPORAL)} FROM bookings_clean"))
def q_temporal_enrich(spark, sf):
    return FX.bookings_clean(spark, sf).select("id", *TEMPORAL)


@register("parse_dates_elected", with_bookings(
    "SELECT id, CAST(arrival AS DATE) AS arrival, CAST(departure AS DATE) AS departure FROM bookings_clean"))
def q_parse_dates(spark, sf):
    return FX.bookings_clean(spark, sf, elect=True).select("id", F.to_date("arrival").alias("arrival"),
                                                           F.to_date("departure").alias("departure"))


@register("confirmed_paid", with_bookings("SELECT id, property, amount FROM bookings"))
def q_confirmed_paid(spark, sf):
    return FX.bookings(spark, sf).select("id", "property", "amount")


@register("quality_flags", with_bookings(f"SELECT id, _is_outlier, {HAS_NULLS} AS _has_nulls FROM bookings_clean"))
def q_quality_flags(spark, sf):
    return FX.bookings_clean(spark, sf, outlier_flag=True).select("id", "_is_outlier", "_has_nulls")


@register("quality_report", with_bookings("""
SELECT (SELECT count(*) FROM bookings_raw) AS total_rows,
  count_if(status_group = 'Confirmada') AS confirmed, count_if(amount > 0) AS with_revenue,
  count_if(guest IS NULL) AS null_guest, count_if(source IS NULL) AS null_source,
  count_if(arrival IS NULL) AS null_dates, CAST(min(arrival) AS DATE) AS date_range_min,
  CAST(max(arrival) AS DATE) AS date_range_max, count(DISTINCT property) AS properties,
  count(DISTINCT channel) AS channels
FROM bookings_clean"""))
def q_quality_report(spark, sf):
    raw = FX.bookings_raw(spark, sf)
    r = CL.quality_report(raw, FX.bookings_clean(spark, sf))
    return r.withColumns({"date_range_min": F.to_date("date_range_min"),
                          "date_range_max": F.to_date("date_range_max")})


@register("unconfirmed_statuses", with_bookings("""
SELECT DISTINCT CAST(status AS VARCHAR) AS status FROM bookings_clean
WHERE (SELECT count(*) FROM bookings_clean) > 0
  AND (SELECT count_if(status_group = 'Confirmada') FROM bookings_clean) = 0"""))
def q_unconfirmed(spark, sf):
    return CL.unconfirmed_statuses(FX.bookings_clean(spark, sf))


IMPUTE_IN = "imp AS (SELECT CAST(R_ID AS VARCHAR) AS id, TRY_CAST(R_NIGHTS AS DOUBLE) AS nights FROM bookings_raw)"


def _impute_input(spark, sf):
    return FX.bookings_raw(spark, sf).select(F.col("R_ID").cast("string").alias("id"),
                                             plain_number("R_NIGHTS").alias("nights"))


@register("impute_mean", with_views(
    "SELECT id, coalesce(nights, (SELECT avg(nights) FROM imp)) AS nights FROM imp", BOOKINGS_RAW, IMPUTE_IN))
def q_impute_mean(spark, sf):
    return CL.impute_missing(_impute_input(spark, sf), "mean")


@register("impute_median", with_views(
    f"SELECT id, coalesce(nights, (SELECT {q_agg('nights', 0.5)} FROM imp)) AS nights FROM imp",
    BOOKINGS_RAW, IMPUTE_IN))
def q_impute_median(spark, sf):
    return CL.impute_missing(_impute_input(spark, sf), "median")


# ---------------------------------------------------------------------------
# Summaries
# ---------------------------------------------------------------------------

@register("monthly_summary", with_bookings("SELECT * FROM monthly", MONTHLY_SQL))
def q_monthly_summary(spark, sf):
    return SM.monthly_summary(FX.bookings(spark, sf))


@register("quarterly_summary", with_bookings(
    sql_grouped("quarter", ["reservas", "ingresos", "ticket_medio", "ppn_medio"])))
def q_quarterly(spark, sf):
    return SM.quarterly_summary(FX.bookings(spark, sf))


@register("dow_summary", with_bookings(sql_grouped("dow", ["reservas", "ingresos", "ppn_medio"])))
def q_dow(spark, sf):
    return SM.dow_summary(FX.bookings(spark, sf))


@register("seasonal_summary", with_bookings(
    sql_grouped("season", ["reservas", "ingresos", "ticket_medio", "ppn_medio"])))
def q_seasonal(spark, sf):
    return SM.seasonal_summary(FX.bookings(spark, sf))


@register("channel_summary", with_bookings(f"""
SELECT *, {rnd('ingresos * (1 - comision_est)')} AS ingresos_netos FROM (
  SELECT *, CAST(CASE channel WHEN 'Booking.com' THEN 0.15 WHEN 'Airbnb' THEN 0.14
                 WHEN 'HomeAway/VRBO' THEN 0.12 ELSE 0.0 END AS DOUBLE) AS comision_est
  FROM ({sql_grouped('channel', ['reservas', 'ingresos', 'ticket_medio', 'ppn_medio'])}))"""))
def q_channel(spark, sf):
    return SM.channel_summary(FX.bookings(spark, sf))


@register("property_top_n", with_bookings(f"""
SELECT property, reservas, {rnd('ingresos')} AS ingresos, {rnd('ticket_medio')} AS ticket_medio,
       {rnd('noches_totales')} AS noches_totales, {rnd('ppn_medio')} AS ppn_medio
FROM (SELECT property, count(amount) AS reservas, coalesce({XSUM}, 0.0) AS ingresos,
             {XAVG} AS ticket_medio, coalesce(sum(nights), 0.0) AS noches_totales,
             {XPPN} / count(price_per_night) AS ppn_medio
      FROM bookings WHERE property IS NOT NULL GROUP BY property
      ORDER BY ingresos DESC, property LIMIT 20)"""))
def q_property_top_n(spark, sf):
    return SM.property_summary(FX.bookings(spark, sf), 20)


@register("yearly_trend", with_bookings(sql_grouped("year", ["reservas", "ingresos", "ticket_medio", "ppn_medio"])))
def q_yearly(spark, sf):
    return SM.yearly_trend(FX.bookings(spark, sf))


@register("time_series_monthly", with_bookings(
    f"SELECT *, CAST(year_month || '-01' AS DATE) AS period FROM "
    f"({sql_grouped('year_month', ['reservas', 'ingresos', 'ppn_medio'])})"))
def q_time_series(spark, sf):
    return SM.time_series_monthly(FX.bookings(spark, sf))


_HEAT = ", ".join(f"count(amount) FILTER (WHERE month = {m}) AS {S.MONTH_ES_SHORT[m - 1]}" for m in range(1, 13))


@register("heatmap_year_month", with_bookings(
    f"SELECT year, {_HEAT} FROM bookings WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year"))
def q_heatmap(spark, sf):
    return SM.monthly_heatmap(FX.bookings(spark, sf))


@register("property_month_matrix", with_bookings(f"""
SELECT property, year_month, {rnd(f'coalesce({XSUM}, 0.0)')} AS ingresos FROM bookings
WHERE property IS NOT NULL AND year_month IS NOT NULL GROUP BY property, year_month"""))
def q_property_month_matrix(spark, sf):
    return rcols(SM.property_month_revenue(FX.bookings(spark, sf)), ["ingresos"])


PM_SQL = f"""pm AS (SELECT property, year_month, coalesce({XSUM}, 0.0) AS ingresos FROM bookings
  WHERE property IS NOT NULL AND year_month IS NOT NULL GROUP BY property, year_month)"""


@register("property_peaks_valleys", with_bookings(f"""
SELECT property AS propiedad, max(CASE WHEN rp = 1 THEN year_month END) AS mes_pico,
  {rnd('max(ingresos)')} AS valor_pico, max(CASE WHEN rv = 1 THEN year_month END) AS mes_valle,
  {rnd('min(ingresos)')} AS valor_valle,
  {rnd(xsum('ingresos') + ' / count(ingresos)')} AS media_mensual
FROM (SELECT *, row_number() OVER (PARTITION BY property ORDER BY ingresos DESC, year_month) AS rp,
             row_number() OVER (PARTITION BY property ORDER BY ingresos, year_month) AS rv FROM pm)
GROUP BY property""", PM_SQL))
def q_peaks_valleys(spark, sf):
    return rcols(SM.property_peaks_valleys(FX.bookings(spark, sf)), ["valor_pico", "valor_valle", "media_mensual"])


# ---------------------------------------------------------------------------
# Outliers, demand, elasticity, pricing
# ---------------------------------------------------------------------------

PPN_Q = f"ppn_q AS (SELECT {q_agg('price_per_night', 0.25)} AS q1, {q_agg('price_per_night', 0.75)} AS q3 FROM bookings)"
PPN_Z = "ppn_z AS (SELECT avg(price_per_night) AS mu, stddev_pop(price_per_night) AS sd FROM bookings)"
IQR_COND = "coalesce(price_per_night < q1 - 1.5 * (q3 - q1) OR price_per_night > q3 + 1.5 * (q3 - q1), false)"
Z_COND = "coalesce(abs((price_per_night - mu) / CASE WHEN sd = 0 THEN NULL ELSE sd END) > 3.0, false)"


@register("outliers_iqr", with_bookings(
    f"SELECT id, property, price_per_night FROM bookings CROSS JOIN ppn_q WHERE {IQR_COND}", PPN_Q))
def q_outliers_iqr(spark, sf):
    d = CL.with_iqr_flag(FX.bookings(spark, sf), "price_per_night", "f", 1.5)
    return d.where("f").select("id", "property", "price_per_night")


@register("outliers_zscore", with_bookings(
    f"SELECT id, property, price_per_night FROM bookings CROSS JOIN ppn_z WHERE {Z_COND}", PPN_Z))
def q_outliers_z(spark, sf):
    d = CL.with_zscore_flag(FX.bookings(spark, sf), "price_per_night", "f", 3.0)
    return d.where("f").select("id", "property", "price_per_night")


@register("outlier_report", with_bookings(f"""
SELECT id, property, price_per_night, is_outlier_iqr, is_outlier_z FROM (
  SELECT id, property, price_per_night, {IQR_COND} AS is_outlier_iqr, {Z_COND} AS is_outlier_z
  FROM bookings CROSS JOIN ppn_q CROSS JOIN ppn_z) WHERE is_outlier_iqr OR is_outlier_z""", PPN_Q, PPN_Z))
def q_outlier_report(spark, sf):
    r = ST.outlier_report(FX.bookings(spark, sf), "price_per_night")
    return r.select("id", "property", "price_per_night", "is_outlier_iqr", "is_outlier_z")


@register("demand_peaks", with_bookings(f"""
SELECT month, month_name, reservas, {rnd('z', 4)} AS z_score, coalesce(z > 0.8, false) AS is_peak,
       coalesce(z < -0.8, false) AS is_valley
FROM (SELECT *, (reservas - avg(reservas) OVER ()) /
               CASE WHEN stddev_samp(reservas) OVER () = 0 THEN NULL ELSE stddev_samp(reservas) OVER () END AS z
      FROM monthly)""", MONTHLY_SQL))
def q_demand_peaks(spark, sf):
    m = ST.demand_peaks(FX.bookings(spark, sf))
    return m.select("month", "month_name", "reservas", r2(F.col("z_score"), 4).alias("z_score"),
                    "is_peak", "is_valley")


def _tier_sql() -> str:
    base = q_list_over("ppn_medio")
    return f"""tiers AS (
  SELECT *, CASE WHEN reservas >= t8 THEN 'Pico' WHEN reservas >= t6 THEN 'Alto'
                 WHEN reservas >= t4 THEN 'Normal' ELSE 'Valle' END AS demand_tier,
            CASE WHEN reservas >= t8 THEN 1.22 WHEN reservas >= t6 THEN 1.10
                 WHEN reservas >= t4 THEN 1.0 ELSE 0.92 END::DOUBLE AS mult
  FROM (SELECT *, {base} AS base, {q_list_over('reservas', 0.8)} AS t8,
               {q_list_over('reservas', 0.6)} AS t6, {q_list_over('reservas', 0.4)} AS t4 FROM monthly))"""


def q_list_over(col: str, p: float = 0.5) -> str:
    from stayspark.plans.oracle import q_list
    return q_list(f"(list_sort(list(CAST({col} AS DOUBLE)) OVER ()))", p)


PRICING_COLS = ("month, reservas, ingresos, ticket_medio, noches_totales, ppn_medio, month_name, pct_ingresos, "
                "demand_tier")
PRICING_SQL = f"""pricing AS (
  SELECT {PRICING_COLS}, {rnd('base * mult')} AS precio_sugerido_ppn,
         {rnd(f"({rnd('base * mult')} - base) / base * 100", 1)} AS delta_pct, {rnd('base')} AS base_ppn
  FROM tiers)"""


@register("dynamic_pricing", with_bookings("SELECT * FROM pricing", MONTHLY_SQL, _tier_sql(), PRICING_SQL))
def q_dynamic_pricing(spark, sf):
    return ST.dynamic_pricing(FX.bookings(spark, sf))


def elast_sql(n: int = 10) -> list[str]:
    """Views of the elasticity bins with ``n`` bins."""
    return [
        "d0 AS (SELECT price_per_night AS p, nights AS q FROM bookings "
        "WHERE price_per_night IS NOT NULL AND nights IS NOT NULL AND price_per_night > 0)",
        f"cap AS (SELECT {q_agg('p', 0.95)} AS cap FROM d0)",
        "d AS (SELECT p, q FROM d0 CROSS JOIN cap WHERE p <= cap)",
        "rg AS (SELECT min(p) AS lo, max(p) AS hi FROM d)",
        f"db AS (SELECT p, q, lo, hi, CASE WHEN hi = lo THEN 1 ELSE 1 + list_sum(list_transform(range(1, {n}), "
        f"lambda i: CAST(p > CAST(i AS DOUBLE) * ((hi - lo) / CAST({n} AS DOUBLE)) + lo AS INTEGER))) END AS bin "
        "FROM d CROSS JOIN rg)",
        "bins AS (SELECT bin, count(q) AS bookings, avg(q) AS avg_nights, avg(p) AS avg_price, "
        "count(q) * avg(q) AS demand, avg(p) * (count(q) * avg(q)) AS revenue_proxy, "
        "CASE WHEN max(hi) = max(lo) THEN max(lo) - CASE WHEN max(lo) = 0 THEN 0.001 ELSE abs(max(lo)) * 0.001 END "
        "WHEN bin = 1 THEN max(lo) - (max(hi) - max(lo)) * 0.001 "
        f"ELSE max(lo) + CAST(bin - 1 AS DOUBLE) * ((max(hi) - max(lo)) / CAST({n} AS DOUBLE)) END AS bin_lo, "
        "CASE WHEN max(hi) = max(lo) THEN max(hi) + CASE WHEN max(lo) = 0 THEN 0.001 ELSE abs(max(lo)) * 0.001 END "
        f"WHEN bin = {n} THEN max(hi) "
        f"ELSE max(lo) + CAST(bin AS DOUBLE) * ((max(hi) - max(lo)) / CAST({n} AS DOUBLE)) END AS bin_hi "
        "FROM db GROUP BY bin)",
    ]


ELAST_SQL = elast_sql()
BIN_OUT = ["bin_lo", "bin_hi", "avg_nights", "avg_price", "demand", "revenue_proxy"]


@register("elasticity_bins", with_bookings(
    "SELECT bin, bookings, " + ", ".join(f"{rnd(c, 4)} AS {c}" for c in BIN_OUT) + " FROM bins", *ELAST_SQL))
def q_elasticity_bins(spark, sf):
    b = ST.price_bins(FX.bookings(spark, sf))
    return b.select("bin", "bookings", *[r2(F.col(c), 4).alias(c) for c in BIN_OUT])


def _pvalue_sql(t: str, dof: str) -> str:
    theta = f"atan(abs({t}) / sqrt(CAST({dof} AS DOUBLE)))"
    c2 = f"pow(cos({theta}), 2)"
    # C(2k, k) / 4^k by the log gamma function, for any k
    ratio = "exp(lgamma(2 * k + 1.0) - 2 * lgamma(k + 1.0) - k * ln(4.0))"
    even = (f"coalesce(list_sum(list_transform(range(0, CAST(({dof} - 2) / 2 AS BIGINT) + 1), "
            f"lambda k: {ratio} * pow({c2}, k))), 0.0)")
    odd = (f"coalesce(list_sum(list_transform(range(0, CAST(greatest(({dof} - 3) / 2 + 1, 0) AS BIGINT)), "
           f"lambda k: 1.0 / ((2 * k + 1) * {ratio}) * pow({c2}, k))), 0.0)")
    a_even = f"sin({theta}) * {even}"
    a_odd = (f"CASE WHEN {dof} = 1 THEN 2 * {theta} / pi() "
             f"ELSE 2 / pi() * ({theta} + sin({theta}) * cos({theta}) * {odd}) END")
    return f"1 - CASE WHEN {dof} % 2 = 0 THEN {a_even} ELSE {a_odd} END"


FIT_SQL = [
    "xy AS (SELECT bin, avg_price, revenue_proxy, ln(avg_price + 1) AS x, ln(demand + 1) AS y FROM bins)",
    "fit0 AS (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, "
    "corr(x, y) AS r, stddev_pop(x) AS sx, arg_min(avg_price, (-revenue_proxy, bin)) AS sweet, "
    "min(x) AS x_min, max(x) AS x_max FROM xy)",
    "fit AS (SELECT *, n >= 3 AND sx > 0 AND r IS NOT NULL AS ok, "
    "r * sqrt(CAST(n - 2 AS DOUBLE) / ((1.0 - r + 1e-20) * (1.0 + r + 1e-20))) AS t FROM fit0)",
]
LABEL_SQL = ("CASE WHEN s > -0.5 THEN '" + S.ELASTICITY_LABELS[0] + "' WHEN s > -1.0 THEN '"
             + S.ELASTICITY_LABELS[1] + "' ELSE '" + S.ELASTICITY_LABELS[2] + "' END")


def _fit_sql(n: int) -> str:
    return with_bookings(f"""
SELECT {rnd('s', 3)} AS elasticity, {rnd('rsq', 3)} AS r_squared, {rnd('p', 4)} AS p_value,
       {rnd('coalesce(sweet, 0.0)', 2)} AS sweet_spot, n AS n_bins, {LABEL_SQL} AS interpretation
FROM (SELECT CASE WHEN ok THEN slope ELSE 0.0 END AS s, CASE WHEN ok THEN r * r ELSE 0.0 END AS rsq,
             CASE WHEN ok THEN {_pvalue_sql('t', '(n - 2)')} ELSE 1.0 END AS p, sweet, n FROM fit)""",
                         *elast_sql(n), *FIT_SQL)


def _fit(spark, sf, n: int) -> DataFrame:
    f = ST.elasticity_fit(FX.bookings(spark, sf), n)
    return f.select(r2(F.col("elasticity"), 3).alias("elasticity"), r2(F.col("r_squared"), 3).alias("r_squared"),
                    r2(F.col("p_value"), 4).alias("p_value"), r2(F.col("sweet_spot")).alias("sweet_spot"), "n_bins", "interpretation")


@register("elasticity_fit", _fit_sql(10))
def q_elasticity_fit(spark, sf):
    return _fit(spark, sf, 10)


@register("elasticity_fit_30_bins", _fit_sql(30))
def q_elasticity_fit_30(spark, sf):
    return _fit(spark, sf, 30)


@register("elasticity_trend_line", with_bookings(f"""
SELECT i, {rnd('exp(xr) - 1')} AS price, {rnd('exp(intercept + slope * xr) - 1')} AS demand_pred
FROM (SELECT CAST(i AS INTEGER) AS i, slope, intercept,
             CASE WHEN i = 49 THEN x_max ELSE x_min + CAST(i AS DOUBLE) * ((x_max - x_min) / CAST(49 AS DOUBLE)) END AS xr
      FROM fit CROSS JOIN range(0, 50) AS g(i) WHERE ok)""", *ELAST_SQL, *FIT_SQL))
def q_elasticity_trend(spark, sf):
    t = ST.elasticity_trend_line(FX.bookings(spark, sf))
    return rcols(t, ["price", "demand_pred"])


# ---------------------------------------------------------------------------
# Forecast (A9, A29, N1-N7)
# ---------------------------------------------------------------------------

FORECAST_SQL = [
    "ts AS (SELECT year_month, CAST(year_month || '-01' AS DATE) AS period, "
    f"coalesce({XSUM}, 0.0) AS y FROM bookings WHERE year_month IS NOT NULL GROUP BY year_month)",
    "t2 AS (SELECT *, month(period) AS month, year(period) AS year, "
    "row_number() OVER (ORDER BY period DESC) AS rn FROM ts)",
    "st AS (SELECT count(*) AS n, max(period) AS last_period, avg(y) AS overall, "
    "avg(y) FILTER (WHERE rn <= 12) AS base, count(y) FILTER (WHERE rn <= 12) AS base_n FROM t2)",
    "se AS (SELECT month, avg(y) AS m_avg FROM t2 GROUP BY month)",
    "an AS (SELECT year, sum(y) AS total FROM t2 GROUP BY year)",
    "tr AS (SELECT coalesce(regr_slope(total, CAST(year - (SELECT min(year) FROM an) AS DOUBLE)), 0.0) AS slope FROM an)",
    "steps AS (SELECT i, CAST(last_period + to_months(CAST(i AS INTEGER)) AS DATE) AS period, "
    "CASE WHEN base_n >= 3 THEN base END AS baseline, overall, slope / 12 AS step "
    "FROM st CROSS JOIN tr CROSS JOIN range(1, 13) AS g(i) WHERE n >= 12)",
    "fc AS (SELECT s.period, month(s.period) AS month, greatest(0.0, s.baseline * "
    "CASE WHEN se.m_avg IS NULL THEN 1.0 ELSE coalesce(se.m_avg / CASE WHEN s.overall = 0 THEN NULL "
    "ELSE s.overall END, 1.0) END + s.step * s.i) AS pt FROM steps s LEFT JOIN se ON se.month = month(s.period))",
]


@register("forecast_12m", with_bookings(f"""
SELECT period, strftime(period, '%Y-%m') AS year_month, CAST(month AS INTEGER) AS month,
       {rnd('pt')} AS forecast, {rnd('pt * 0.8')} AS ci_low, {rnd('pt * 1.2')} AS ci_high,
       month IN (7, 8) AS is_peak FROM fc""", *FORECAST_SQL))
def q_forecast(spark, sf):
    return FC.seasonal_naive_forecast(FX.bookings(spark, sf), 12, "ingresos")


_OPP = S.OPPORTUNITY_LABELS


@register("opportunity_calendar", with_bookings(f"""
SELECT p.*, {rnd('f.pt')} AS forecast_ingresos, f.month IN (7, 8) AS is_peak,
  CASE WHEN (SELECT count(*) FROM fc) > 0 THEN
    CASE p.demand_tier WHEN 'Pico' THEN '{_OPP['Pico']}' WHEN 'Alto' THEN '{_OPP['Alto']}'
         WHEN 'Normal' THEN '{_OPP['Normal']}' ELSE '{_OPP['Valle']}' END END AS oportunidad
FROM pricing p LEFT JOIN fc f ON f.month = p.month""",
    MONTHLY_SQL, _tier_sql(), PRICING_SQL, *FORECAST_SQL))
def q_opportunity(spark, sf):
    return FC.price_opportunity_calendar(FX.bookings(spark, sf))


@register("growth_metrics", with_bookings(f"""
SELECT CASE WHEN (SELECT count(*) FROM an) >= 2 THEN {rnd('(y1 - y2) / y2 * 100', 1)} ELSE 0.0 END AS yoy_growth_pct,
       CASE WHEN n >= 2 THEN {rnd('(m1 - m2) / m2 * 100', 1)} ELSE 0.0 END AS mom_growth_pct,
       {rnd('total')} AS total_revenue, {rnd('mean')} AS avg_monthly, coalesce(best, '-') AS best_month
FROM (SELECT count(*) AS n, {xsum('y')} AS total,
             {xsum('y')} / count(y) AS mean,
             max(y) FILTER (WHERE rn = 1) AS m1, max(y) FILTER (WHERE rn = 2) AS m2,
             arg_min(year_month, (-y, period)) AS best FROM t2) CROSS JOIN
     (SELECT max(total) FILTER (WHERE yr = 1) AS y1, max(total) FILTER (WHERE yr = 2) AS y2
      FROM (SELECT *, row_number() OVER (ORDER BY year DESC) AS yr FROM an))""", *FORECAST_SQL[:5]))
def q_growth(spark, sf):
    return FC.growth_metrics(FX.bookings(spark, sf))


# ---------------------------------------------------------------------------
# Per property
# ---------------------------------------------------------------------------

KPI_SQL = f"""kpi AS (
  SELECT property, coalesce({XSUM}, 0.0) AS total_ingresos, {XAVG} AS ingresos_mes,
    {XPPN} / count(price_per_night) AS precio_medio, count(*) AS total_reservas,
    coalesce(sum(nights), 0.0) AS total_noches,
    least(coalesce(sum(nights), 0.0) / greatest(floor(date_diff('second', min(arrival), max(arrival)) / 86400.0), 1)
          * 100, 100.0) AS ocupacion_pct
  FROM bookings WHERE property IS NOT NULL GROUP BY property)"""
KPI_COLS = ["total_ingresos", "ingresos_mes", "precio_medio", "total_noches", "ocupacion_pct"]


@register("property_kpis", with_bookings(
    "SELECT property, total_reservas, " + ", ".join(f"{rnd(c)} AS {c}" for c in KPI_COLS) + " FROM kpi", KPI_SQL))
def q_property_kpis(spark, sf):
    return rcols(PR.property_kpis(FX.bookings(spark, sf)), KPI_COLS)


PMONTH_SQL = f"""pmon AS (SELECT property, month, month_short, coalesce({XSUM}, 0.0) AS ingresos,
  coalesce(sum(nights), 0.0) AS noches FROM bookings WHERE property IS NOT NULL AND month IS NOT NULL
  GROUP BY property, month, month_short)"""
DAYS = "[31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]"


@register("occupancy_month", with_bookings(f"""
SELECT property, month, month_short, {rnd('noches')} AS noches, {DAYS}[month] AS dias_mes,
       {rnd(f'least(greatest(noches / {DAYS}[month] * 100, 0.0), 100.0)')} AS ocupacion_pct FROM pmon""",
    PMONTH_SQL))
def q_occupancy_month(spark, sf):
    return rcols(PR.occupancy_by_month(FX.bookings(spark, sf)), ["noches", "ocupacion_pct"])


@register("occupancy_quarter", with_bookings(f"""
SELECT property, quarter, {rnd('noches')} AS noches, {rnd('ingresos')} AS ingresos, dias,
       {rnd('least(greatest(noches / dias * 100, 0.0), 100.0)')} AS ocupacion
FROM (SELECT property, quarter, coalesce(sum(nights), 0.0) AS noches, coalesce({XSUM}, 0.0) AS ingresos,
             CASE quarter WHEN 'Q1' THEN 90 WHEN 'Q2' THEN 91 WHEN 'Q3' THEN 92 WHEN 'Q4' THEN 92 END AS dias
      FROM bookings WHERE property IS NOT NULL AND quarter IS NOT NULL GROUP BY property, quarter)"""))
def q_occupancy_quarter(spark, sf):
    return rcols(PR.occupancy_by_quarter(FX.bookings(spark, sf)), ["noches", "ingresos", "ocupacion"])


@register("golden_month", with_bookings(f"""
SELECT property, arg_min(month_short, (-ingresos, month)) AS gold_month, {rnd('max(ingresos)')} AS gold_value
FROM pmon GROUP BY property""", PMONTH_SQL))
def q_golden_month(spark, sf):
    return rcols(PR.golden_month(FX.bookings(spark, sf)), ["gold_value"])


PEER_SQL = f"""
SELECT propiedad_sel, property, {rnd('ingresos')} AS ingresos, reservas, {rnd('precio')} AS precio FROM (
  SELECT s.property AS propiedad_sel, l.property, l.ingresos, l.reservas, l.precio,
         row_number() OVER (PARTITION BY s.property ORDER BY l.ingresos DESC, l.property) AS r
  FROM k s JOIN (SELECT * FROM k ORDER BY ingresos DESC, property LIMIT 11) l ON s.property <> l.property)
WHERE r <= 10
UNION ALL
SELECT property AS propiedad_sel, '{S.PEER_PREFIX}' || property AS property, {rnd('ingresos')} AS ingresos,
       reservas, {rnd('precio')} AS precio FROM k"""


@register("peer_comparison", with_bookings(
    PEER_SQL, KPI_SQL,
    "k AS (SELECT property, total_ingresos AS ingresos, total_reservas AS reservas, precio_medio AS precio FROM kpi)"))
def q_peer_comparison(spark, sf):
    return rcols(PR.peer_comparison(FX.bookings(spark, sf)), ["ingresos", "precio"])


GAP_SQL = f"""gap AS (
  SELECT property, precio_medio, media_cartera,
         CASE WHEN precio_medio > 0 THEN
           CASE WHEN media_cartera IS NULL THEN NULL WHEN media_cartera <> 0
                THEN (precio_medio - media_cartera) / media_cartera * 100 ELSE 0.0 END END AS diff_pct
  FROM (SELECT o.property, o.precio_medio,
               (t.s - coalesce(o.s, 0.0)) / CASE WHEN t.c - o.c = 0 THEN NULL ELSE t.c - o.c END AS media_cartera
        FROM (SELECT property, {XPPN} / count(price_per_night) AS precio_medio, {XPPN} AS s,
                     count(price_per_night) AS c FROM bookings WHERE property IS NOT NULL GROUP BY property) o
        CROSS JOIN (SELECT {XPPN} AS s, count(price_per_night) AS c FROM bookings) t))"""


@register("price_gap_rules", with_bookings(f"""
SELECT property, {rnd('precio_medio')} AS precio_medio, {rnd('media_cartera')} AS media_cartera,
       {rnd('diff_pct', 4)} AS diff_pct,
       CASE WHEN diff_pct < -10 THEN 'raise' WHEN diff_pct > 15 THEN 'review' END AS regla FROM gap""", GAP_SQL))
def q_price_gap(spark, sf):
    g = PR.price_gap(FX.bookings(spark, sf))
    return g.select("property", r2(F.col("precio_medio")).alias("precio_medio"),
                    r2(F.col("media_cartera")).alias("media_cartera"), r2(F.col("diff_pct"), 4).alias("diff_pct"),
                    "regla")


def _sql_text(template: str, **fills: str) -> str:
    """SQL string expression for a template with {name} holes."""
    parts, rest = [], template
    while "{" in rest:
        a = rest.index("{")
        b = rest.index("}", a)
        parts.append("'" + rest[:a].replace("'", "''") + "'")
        parts.append(f"({fills[rest[a + 1:b]]})")
        rest = rest[b + 1:]
    parts.append("'" + rest.replace("'", "''") + "'")
    return " || ".join(parts)


def _title(key: str) -> str:
    return "'" + S.RECOMMENDATIONS[key][0].replace("'", "''") + "'"


def _f0(x: str) -> str:
    """{:,.0f}"""
    return f"format('{{:,.0f}}', {rnd(x, 0)})"


def _p0(x: str) -> str:
    """{:.0f}"""
    return f"printf('%.0f', {rnd(x, 0)})"


_R = S.RECOMMENDATIONS
RECS_SQL = f"""
SELECT property, CAST(row_number() OVER (PARTITION BY property ORDER BY o) AS INTEGER) AS rec_no, title, text FROM (
  SELECT property, 1 AS o, {_title('raise')} AS title, {_sql_text(_R['raise'][1], top3='top3')} AS text
    FROM j WHERE top3 IS NOT NULL
  UNION ALL SELECT property, 2, {_title('low_season')}, {_sql_text(_R['low_season'][1], bot3='bot3')}
    FROM j WHERE top3 IS NOT NULL
  UNION ALL SELECT property, 3, {_title('price_up')},
    {_sql_text(_R['price_up'][1], ppn=_f0('precio_medio'), pct=_p0('abs(diff_pct)'), media=_f0('media_cartera'))}
    FROM j WHERE diff_pct < -10
  UNION ALL SELECT property, 4, {_title('price_review')}, {_sql_text(_R['price_review'][1], pct=_p0('diff_pct'))}
    FROM j WHERE diff_pct > 15
  UNION ALL SELECT property, 5, {_title('reviews')}, {_sql_text(_R['reviews'][1])} FROM j
  UNION ALL SELECT property, 6, {_title('min_stay')}, {_sql_text(_R['min_stay'][1], gold="coalesce(gold, 'N/A')")}
    FROM j)"""
RECS_CTES = [
    GAP_SQL,
    "pr AS (SELECT *, row_number() OVER (PARTITION BY property ORDER BY ingresos DESC, month) AS t, "
    "row_number() OVER (PARTITION BY property ORDER BY ingresos, month) AS b FROM pmon)",
    "mf AS (SELECT property, string_agg(month_short, ', ' ORDER BY t) FILTER (WHERE t <= 3) AS top3, "
    "string_agg(month_short, ', ' ORDER BY b) FILTER (WHERE b <= 3) AS bot3, "
    "arg_min(month_short, (-ingresos, month)) AS gold FROM pr GROUP BY property)",
    "j AS (SELECT g.*, mf.top3, mf.bot3, mf.gold FROM gap g LEFT JOIN mf USING (property))",
]


@register("recommendations", with_bookings(RECS_SQL, PMONTH_SQL, *RECS_CTES))
def q_recommendations(spark, sf):
    return PR.recommendations(FX.bookings(spark, sf)).withColumn("rec_no", F.col("rec_no").cast("int"))


@register("projection", with_bookings(f"""
SELECT property, {rnd('ingresos_mes * (1 + 0.12)')} AS proy_ingreso_mensual,
       {rnd('total_ingresos * (1 + 0.12)')} AS proy_ingreso_anual,
       {rnd('least(ocupacion_pct * 1.07, 100.0)')} AS ocupacion_objetivo FROM kpi""", KPI_SQL))
def q_projection(spark, sf):
    return rcols(PR.projection(FX.bookings(spark, sf)),
                 ["proy_ingreso_mensual", "proy_ingreso_anual", "ocupacion_objetivo"])


@register("projection_monthly", with_bookings(f"""
SELECT property, month, month_short, {rnd('ingresos')} AS ingresos, {rnd('ingresos * (1 + 0.12)')} AS proyeccion
FROM pmon""", PMONTH_SQL))
def q_projection_monthly(spark, sf):
    return rcols(PR.projection_monthly(FX.bookings(spark, sf)), ["ingresos", "proyeccion"])


_T = S.DIAGNOSIS_TEXT


def _esc(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DIAG_CTES = [
    "d AS (SELECT * FROM bookings WHERE property IS NOT NULL)",
    f"base AS (SELECT property, {XPPN} / count(price_per_night) AS ppn, coalesce({XSUM}, 0.0) AS rev_total, "
    "count(*) AS bookings, count(amount) AS n_amount FROM d GROUP BY property)",
    f"g AS (SELECT {XPPN} / count(price_per_night) AS gppn FROM bookings)",
    "mn AS (SELECT avg(n_amount) AS mean_n FROM base)",
    "ch0 AS (SELECT property, channel, count(*) AS c FROM d GROUP BY property, channel)",
    "ch AS (SELECT property, arg_min(channel, (-c, channel)) AS top_channel, max(c) / sum(c) AS top_share "
    "FROM ch0 GROUP BY property)",
    f"mo0 AS (SELECT property, month, coalesce({XSUM}, 0.0) AS rev, count(amount) AS cnt FROM d "
    "WHERE month IS NOT NULL GROUP BY property, month)",
    "mo1 AS (SELECT *, {MED} AS med FROM mo0)",
    f"mo AS (SELECT property, stddev_samp(rev) / CASE WHEN avg(rev) = 0 THEN NULL ELSE avg(rev) END AS cv, "
    f"list_transform(list_sort(list(month) FILTER (WHERE cnt >= med)), lambda x: {MONTHS_LONG}[x]) AS raise_months "
    f"FROM mo1 GROUP BY property)",
]


def _diag_sql() -> str:
    from stayspark.plans.oracle import q_list
    med = q_list("(list_sort(list(CAST(cnt AS DOUBLE)) OVER (PARTITION BY property)))", 0.5)
    ctes = [c.replace("{MED}", med) for c in DIAG_CTES]
    pros = (f"list_filter([CASE WHEN ppn > gppn * 1.1 THEN 'ADR Superior: Su precio por noche (' || "
            f"printf('%.0f', {rnd('ppn', 0)}) || '€) es un ' || printf('%.1f', {rnd('(ppn / gppn - 1) * 100', 1)}) "
            f"|| '% superior a la media.' END, CASE WHEN bookings > mean_n THEN {_esc(_T['rotation'])} END, "
            f"CASE WHEN top_share < 0.5 THEN {_esc(_T['diversified'])} END], lambda x: x IS NOT NULL)")
    cons = (f"list_filter([CASE WHEN ppn < gppn * 0.9 THEN 'ADR Bajo: El precio por noche está por debajo de la "
            f"media global (' || printf('%.0f', {rnd('gppn', 0)}) || '€).' END, "
            f"CASE WHEN cv > 0.5 THEN {_esc(_T['volatile'])} END, "
            f"CASE WHEN top_share > 0.7 THEN 'Riesgo de Dependencia: El ' || printf('%.0f', {rnd('top_share * 100', 0)}) "
            f"|| '% de reservas vienen de ' || top_channel || '.' END], lambda x: x IS NOT NULL)")
    sql = f"""
SELECT property,
  array_to_string(CASE WHEN len(pros) > 0 THEN pros ELSE [{_esc(_T['no_pros'])}] END, ' | ') AS pros,
  array_to_string(CASE WHEN len(cons) > 0 THEN cons ELSE [{_esc(_T['no_cons'])}] END, ' | ') AS cons,
  array_to_string(coalesce(raise_months, []), ', ') AS raise_months,
  {rnd('rev_total')} AS rev_total, {rnd('ppn')} AS ppn, bookings
FROM (SELECT base.*, {pros} AS pros, {cons} AS cons, mo.raise_months
      FROM base CROSS JOIN g CROSS JOIN mn LEFT JOIN ch USING (property) LEFT JOIN mo USING (property))"""
    return with_bookings(sql, *ctes)


@register("property_diagnosis", _diag_sql())
def q_property_diagnosis(spark, sf):
    d = PR.property_diagnosis(FX.bookings(spark, sf))
    return d.select("property", F.array_join("pros", " | ").alias("pros"), F.array_join("cons", " | ").alias("cons"),
                    F.array_join("raise_months", ", ").alias("raise_months"),
                    r2(F.col("rev_total")).alias("rev_total"), r2(F.col("ppn")).alias("ppn"), "bookings")


MKT_STATS_SQL = (f"mstats AS (SELECT avg(precio_noche) AS m_mean, {q_agg('precio_noche', 0.5)} AS m_median, "
                 f"{q_agg('precio_noche', 0.75)} AS m_p75, count(precio_noche) AS n_listings "
                 f"FROM market WHERE precio_noche IS NOT NULL)")
ADV_COLS = ["total_ingresos", "precio_medio", "ocupacion_pct", "gold_value", "m_mean", "m_median", "diff_m"]


@register("advisor_facts", with_bookings(
    "SELECT property, total_reservas, gold_month, " + ", ".join(f"{rnd(c)} AS {c}" for c in ADV_COLS) + f""" FROM (
  SELECT kpi.property, total_ingresos, precio_medio, ocupacion_pct, total_reservas,
         coalesce(gm.gold_month, 'N/A') AS gold_month, coalesce(gm.gold_value, 0.0) AS gold_value, m_mean, m_median,
         CASE WHEN m_mean <> 0 THEN (precio_medio - m_mean) / m_mean * 100 ELSE 0.0 END AS diff_m
  FROM kpi LEFT JOIN (SELECT property, arg_min(month_short, (-ingresos, month)) AS gold_month,
                             max(ingresos) AS gold_value FROM pmon GROUP BY property) gm USING (property)
  CROSS JOIN mstats)""", KPI_SQL, PMONTH_SQL, MARKET, MKT_STATS_SQL))
def q_advisor_facts(spark, sf):
    a = PR.advisor_facts(FX.bookings(spark, sf), FX.market(spark, sf))
    return rcols(a, ADV_COLS)


# ---------------------------------------------------------------------------
# Market (K1, N8, A30-A32, W7, W8, X1-X3)
# ---------------------------------------------------------------------------

UPSERT_ORDER = ["l_orderkey", "l_linenumber", "precio_noche", "rating", "ciudad"]
MARKET_PAYLOAD = ["url", "checkin", "nombre", "precio_noche", "rating", "num_reviews", "tipo", "capacidad", "ciudad"]


@register("market_upsert", with_views(f"""
SELECT {', '.join(MARKET_PAYLOAD[:3])}, coalesce(TRY_CAST(precio_noche AS INTEGER), 0) AS precio_noche,
       {', '.join(MARKET_PAYLOAD[4:])} FROM (
  SELECT *, row_number() OVER (PARTITION BY url, checkin ORDER BY l_orderkey DESC, l_linenumber DESC,
                               precio_noche DESC, rating DESC NULLS LAST, ciudad DESC) AS rn FROM market)
WHERE rn = 1""", MARKET))
def q_market_upsert(spark, sf):
    return MK.upsert_listings(None, FX.market(spark, sf), order=UPSERT_ORDER,
                              drop=["l_orderkey", "l_linenumber"]).select(*MARKET_PAYLOAD)


MK_COLS = ["precio_medio", "m_mean", "m_median", "m_p75", "pos_pct", "diff_vs_mean"]


@register("market_kpis", with_bookings(
    "SELECT property, n_listings, " + ", ".join(f"{rnd(c)} AS {c}" for c in MK_COLS) + """ FROM (
  SELECT k.property, k.precio_medio, m_mean, m_median, m_p75, n_listings,
    CASE WHEN n_listings > 1 THEN (SELECT count(*) FROM market mk WHERE mk.precio_noche IS NOT NULL
                                   AND mk.precio_noche < k.precio_medio) / n_listings * 100 ELSE 0.0 END AS pos_pct,
    CASE WHEN m_mean <> 0 THEN (k.precio_medio - m_mean) / m_mean * 100 ELSE 0.0 END AS diff_vs_mean
  FROM kpi k CROSS JOIN mstats)""", KPI_SQL, MARKET, MKT_STATS_SQL))
def q_market_kpis(spark, sf):
    own = PR.property_kpis(FX.bookings(spark, sf)).select("property", "precio_medio")
    k = MK.market_kpis(own, FX.market(spark, sf))
    return rcols(k.select("property", "n_listings", *MK_COLS), MK_COLS)


@register("market_histogram", with_views(f"""
SELECT bin, {rnd('lo + bin * ((hi - lo) / 20.0)')} AS lo, {rnd('lo + (bin + 1) * ((hi - lo) / 20.0)')} AS hi,
       count(*) AS n FROM (
  SELECT CASE WHEN (hi - lo) / 20.0 = 0 THEN 0
              ELSE CAST(least(floor((precio_noche - lo) / ((hi - lo) / 20.0)), 19) AS INTEGER) END AS bin, lo, hi
  FROM (SELECT CAST(precio_noche AS DOUBLE) AS precio_noche FROM market WHERE precio_noche IS NOT NULL)
  CROSS JOIN (SELECT CAST(min(precio_noche) AS DOUBLE) AS lo, CAST(max(precio_noche) AS DOUBLE) AS hi
              FROM market WHERE precio_noche IS NOT NULL))
GROUP BY bin, lo, hi""".replace("20.0", "CAST(20 AS DOUBLE)"), MARKET))
def q_market_histogram(spark, sf):
    return rcols(MK.price_histogram(FX.market(spark, sf), 20), ["lo", "hi"])


@register("market_by_type", with_views(f"""
SELECT tipo, {rnd('avg(precio_noche)')} AS precio_noche FROM market WHERE precio_noche IS NOT NULL GROUP BY tipo""".replace(" GROUP BY", " AND tipo IS NOT NULL GROUP BY"),
    MARKET))
def q_market_by_type(spark, sf):
    return rcols(MK.price_by_type(FX.market(spark, sf)), ["precio_noche"])


BOX = [("p0", 0.0), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p100", 1.0)]
BOX_SQL = ("SELECT 'Mercado' AS origen, " + ", ".join(f"{rnd(q_agg('precio_noche', p))} AS {n}" for n, p in BOX)
           + " FROM market UNION ALL SELECT 'Tu Propiedad' AS origen, "
           + ", ".join(f"{rnd('p')} AS {n}" for n, _ in BOX)
           + " FROM (SELECT avg(price_per_night) AS p FROM bookings)")


@register("market_box", with_bookings(BOX_SQL, MARKET))
def q_market_box(spark, sf):
    """A31 box summary: market prices vs the portfolio's mean nightly price."""
    own = FX.bookings(spark, sf).agg(F.avg("price_per_night").alias("p"))
    box = MK.price_box(FX.market(spark, sf), own)
    return rcols(box, [n for n, _ in BOX])


@register("direct_competitors", with_bookings("""
SELECT nombre, precio_noche, rating, tipo, url FROM market CROSS JOIN (SELECT avg(price_per_night) AS p FROM bookings)
WHERE precio_noche IS NOT NULL AND precio_noche >= p * (1 - 0.3) AND precio_noche <= p * (1 + 0.3)""", MARKET))
def q_direct_competitors(spark, sf):
    from stayspark.operators.quantiles import attach
    m = attach(FX.market(spark, sf), "_own", FX.bookings(spark, sf).agg(F.avg("price_per_night").alias("p")))
    return MK.direct_competitors(m, F.col("_own.p"), 0.30)


@register("market_season_filter", with_views("""
SELECT nombre, precio_noche, url, checkin, ciudad FROM market
WHERE precio_noche IS NOT NULL AND ((SELECT count(checkin) FROM market WHERE precio_noche IS NOT NULL) = 0
      OR month(checkin) IN (7, 8))""", MARKET))
def q_market_season(spark, sf):
    m = MK.season_filter(MK.coerce_market(FX.market(spark, sf)), "Alta (Jul-Ago)")
    return m.select("nombre", F.col("precio_noche").cast("int").alias("precio_noche"), "url", "checkin", "ciudad")


CARDS_X = FX.CARD_CHECKIN
CARD_SQL = f"""cx AS (SELECT l_orderkey, l_linenumber, title_raw, price_raw, text, href,
  DATE '{FX.CARD_CHECKIN}' AS checkin, CAST(DATE '{FX.CARD_CHECKIN}' + to_days(CAST(nights AS INTEGER)) AS DATE) AS checkout,
  ciudad, ciudad AS propiedad_referencia, DATE '{FX.CARD_SCRAPED_ON}' AS scraped_on FROM cards)"""


def _card_sql() -> str:
    generic = " OR ".join(f"contains(lower(x), '{g}')" for g in S.GENERIC_TITLE_WORDS)
    noise = " OR ".join(f"contains(lower(x), '{w}')" for w in S.CARD_NOISE_WORDS)
    ws = __import__("stayspark.plans.oracle", fromlist=["WS"]).WS
    strip = lambda e: f"regexp_replace({e}, '^{ws}+|{ws}+$', '', 'g')"
    types = " ".join(f"WHEN contains(lower(text), '{t.lower()}') THEN '{t}'" for t in S.LODGING_TYPES)
    return f"""
t1 AS (SELECT *, title_raw IS NOT NULL AND title_raw <> '' AS has_title,
  CASE WHEN title_raw IS NOT NULL AND title_raw <> '' THEN string_split({strip('title_raw')}, chr(10))[1]
       ELSE '{S.NO_TITLE}' END AS name0,
  list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}),
                          lambda x: length(x) > 5), lambda x: NOT ({noise})) AS cands FROM cx),
t2 AS (SELECT *, list_position(list_transform(cands, lambda x: NOT ({generic}) AND length(x) > 8), true) AS good,
  list_filter(cands, lambda x: x <> name0 AND length(x) > 15) AS longer FROM t1),
t3 AS (SELECT *, CASE WHEN (NOT has_title OR {generic.replace('x)', 'name0)')}) AND text IS NOT NULL AND text <> ''
  THEN CASE WHEN good IS NOT NULL AND good > 0 THEN cands[good]
            WHEN len(longer) > 0 AND list_max(list_transform(longer, lambda x: length(x))) > length(name0)
            THEN longer[list_position(list_transform(longer, lambda x: length(x)),
                                      list_max(list_transform(longer, lambda x: length(x))))]
            ELSE name0 END ELSE name0 END AS nombre,
  CASE WHEN price_raw IS NOT NULL AND price_raw <> '' THEN price_raw
       WHEN text IS NOT NULL AND text <> '' THEN nullif(regexp_extract(text, '(\\d[\\d.\\s,]*)\\s*€', 0), '') END AS ptxt,
  greatest(coalesce(date_diff('day', checkin, checkout), 1), 1) AS stay FROM t2),
t4 AS (SELECT *, TRY_CAST(nullif(regexp_extract(replace(translate(ptxt, '.,', ''), chr(160), ' '), '(\\d{{2,5}})', 1), '')
                          AS INTEGER) AS p1 FROM t3),
t5 AS (SELECT *, CASE WHEN ptxt IS NULL OR ptxt = '' THEN NULL
  WHEN (contains(lower(ptxt), 'total') OR contains(lower(ptxt), 'estancia')) AND stay > 1 AND p1 IS NOT NULL
  THEN greatest(1, CAST(floor(p1 / stay) AS INTEGER)) ELSE p1 END AS precio_noche FROM t4)
SELECT l_orderkey, l_linenumber, nombre, precio_noche,
  CASE WHEN regexp_matches(text, '(\\d)[,.](\\d{{2}})\\s*\\((\\d+)\\)')
       THEN TRY_CAST(regexp_extract(text, '(\\d)[,.](\\d{{2}})\\s*\\((\\d+)\\)', 1) || '.' ||
                     regexp_extract(text, '(\\d)[,.](\\d{{2}})\\s*\\((\\d+)\\)', 2) AS DOUBLE)
       WHEN regexp_matches(text, '(\\d)[,.](\\d{{2}})\\s*(?:sobre|out)')
       THEN TRY_CAST(regexp_extract(text, '(\\d)[,.](\\d{{2}})\\s*(?:sobre|out)', 1) || '.' ||
                     regexp_extract(text, '(\\d)[,.](\\d{{2}})\\s*(?:sobre|out)', 2) AS DOUBLE) END AS rating,
  CASE WHEN regexp_matches(text, '(\\d)[,.](\\d{{2}})\\s*\\((\\d+)\\)')
       THEN TRY_CAST(regexp_extract(text, '(\\d)[,.](\\d{{2}})\\s*\\((\\d+)\\)', 3) AS INTEGER) END AS num_reviews,
  CASE {types} ELSE '{S.UNKNOWN_TYPE}' END AS tipo,
  TRY_CAST(nullif(regexp_extract(text, '(?i)(\\d+)\\s*(?:huésped|huesped|guest)', 1), '') AS INTEGER) AS capacidad,
  CASE WHEN href IS NULL OR href = '' THEN '' WHEN starts_with(href, 'http') THEN href
       ELSE '{S.LISTING_SITE_ROOT}' || href END AS url,
  scraped_on AS fecha_scraping, checkin, checkout, ciudad, propiedad_referencia
FROM t5 WHERE precio_noche IS NOT NULL AND precio_noche <> 0"""


@register("card_extract", "WITH " + CARDS + ",\n" + CARD_SQL + ",\n" + _card_sql())
def q_card_extract(spark, sf):
    return MK.extract_cards(FX.captured_cards(spark, sf), keep=["l_orderkey", "l_linenumber"])


def _page_sql() -> str:
    li = r"(?is)<li\b[^>]*>(.*?)</li>"
    p = r"(?is)<p\b[^>]*>(.*?)</p>"
    return f"""
SELECT page_id, CAST(k - 1 AS INTEGER) AS card_no,
       trim(regexp_replace(regexp_replace(blocks[k], '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text
FROM (SELECT page_id, blocks, generate_subscripts(blocks, 1) AS k FROM (
  SELECT page_id, CASE WHEN len(regexp_extract_all(html, '{li}', 1)) > 0 THEN regexp_extract_all(html, '{li}', 1)
                       WHEN len(regexp_extract_all(html, '{p}', 1)) > 0 THEN regexp_extract_all(html, '{p}', 1)
                       ELSE [] END AS blocks FROM pages))"""


@register("page_cards", _page_sql())
def q_page_cards(spark, sf):
    pages = FX.table(spark, sf, "pages").select("page_id", "html")
    return MK.page_cards(pages, FX.PAGE_MARKERS).withColumn("card_no", F.col("card_no").cast("int"))


@register("robot_page_flag", f"""
SELECT count(*) AS n_pages,
  count_if((contains(lower(html), 'captcha') OR contains(lower(html), 'are you a robot'))
           AND NOT (contains(html, '{S.LISTING_PAGE_MARKERS[0]}') OR contains(html, '{S.LISTING_PAGE_MARKERS[1]}')))
    AS n_robot,
  count_if(contains(html, '{S.LISTING_PAGE_MARKERS[0]}') OR contains(html, '{S.LISTING_PAGE_MARKERS[1]}'))
    AS n_with_listings
FROM pages""")
def q_robot_flag(spark, sf):
    pages = FX.table(spark, sf, "pages").select("html")
    listing = F.lit(False)
    for m in S.LISTING_PAGE_MARKERS:
        listing = listing | F.col("html").contains(m)
    return pages.agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(MK.robot_page_flag(pages)).alias("n_robot"),
                     F.count_if(listing).alias("n_with_listings"))


# ---------------------------------------------------------------------------
# Search planner (N9, N10) and text tables
# ---------------------------------------------------------------------------

def _city_sql(col: str) -> str:
    arms = " ".join(f"WHEN contains(lower({col}), '{k}') THEN '{v}'" for k, v in FX.FIXTURE_CITY_KEYWORDS)
    return f"CASE {arms} END"


def _search_inputs_sql() -> str:
    from stayspark.plans.oracle import strip
    prop = strip("CAST(R_PROPERTY_NAME AS VARCHAR)")
    date = strip("R_ARRIVAL")
    parsed = f"coalesce(try_strptime({date}, '%d/%m/%Y'), try_strptime({date}, '%Y-%m-%d'), try_strptime({date}, '%d-%m-%Y'))"
    nights = "greatest(coalesce(TRY_CAST(TRY_CAST(replace(R_NIGHTS, ',', '.') AS DOUBLE) AS INTEGER), 1), 1)"
    return f"""si AS (SELECT propiedad, ciudad, checkin, CAST(checkin + to_days(noches) AS DATE) AS checkout, noches FROM (
  SELECT {prop} AS propiedad, {_city_sql(prop)} AS ciudad, CAST({parsed} AS DATE) AS checkin, {nights} AS noches
  FROM bookings_raw WHERE R_STATUS IN ('Booked', 'Fact.', 'Confirmada'))
  WHERE ciudad IS NOT NULL AND checkin IS NOT NULL)"""


@register("search_inputs", with_views("SELECT * FROM si", BOOKINGS_RAW, _search_inputs_sql()))
def q_search_inputs(spark, sf):
    return PL.search_inputs(FX.bookings_raw(spark, sf), FX.FIXTURE_CITY_KEYWORDS)


def _search_plan_sql(as_of: str) -> str:
    return with_views("""
SELECT ciudad, checkin, checkout, propiedad AS propiedad_referencia FROM pd
WHERE (has_future AND future AND fk <= 3) OR (NOT has_future AND coalesce(before, 0) < 3)""",
                      BOOKINGS_RAW, _search_inputs_sql(),
                      f"""pd0 AS (SELECT propiedad, checkin, min(checkout) AS checkout, min(ciudad) AS ciudad, count(*) AS n,
  checkin >= DATE '{as_of}' AS future FROM si GROUP BY propiedad, checkin)""",
                      """pd AS (SELECT *, max(CAST(future AS INTEGER)) OVER (PARTITION BY propiedad) = 1 AS has_future,
  row_number() OVER (PARTITION BY propiedad, future ORDER BY checkin) AS fk,
  sum(n) OVER (PARTITION BY propiedad ORDER BY checkin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM pd0)""")


SEARCH_AS_OF, SEARCH_AFTER_ALL = "2001-01-01", "2100-01-01"


@register("search_plan", _search_plan_sql(SEARCH_AS_OF))
def q_search_plan(spark, sf):
    return PL.search_plan(PL.search_inputs(FX.bookings_raw(spark, sf), FX.FIXTURE_CITY_KEYWORDS), SEARCH_AS_OF)


@register("search_plan_past", _search_plan_sql(SEARCH_AFTER_ALL))
def q_search_plan_past(spark, sf):
    """N9 where every stay is past."""
    return PL.search_plan(PL.search_inputs(FX.bookings_raw(spark, sf), FX.FIXTURE_CITY_KEYWORDS), SEARCH_AFTER_ALL)


def _text_lines_sql() -> str:
    from stayspark.plans.oracle import WS
    return f"""
SELECT doc_id, CAST(k - 1 AS INTEGER) AS line_no, len(cells) AS n_cells, array_to_string(cells, chr(31)) AS cells
FROM (SELECT doc_id, k, regexp_split_to_array(regexp_replace(lines[k], '^{WS}+|{WS}+$', '', 'g'), '{WS}+') AS cells,
             regexp_replace(lines[k], '^{WS}+|{WS}+$', '', 'g') AS s
      FROM (SELECT doc_id, lines, generate_subscripts(lines, 1) AS k
            FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))
WHERE s <> ''"""


@register("text_table_lines", _text_lines_sql())
def q_text_table_lines(spark, sf):
    from stayspark.sources.text_table import text_table_lines
    t = text_table_lines(FX.table(spark, sf, "documents").select("doc_id", "text"))
    return t.select("doc_id", "line_no", F.size("cells").alias("n_cells"),
                    F.array_join("cells", "\u001f").alias("cells"))


# ---------------------------------------------------------------------------
# Cases that the shared views don't hold (F2, F24, F25, P6, W4, O5, U2, A11,
# A14, A30, K1, X2 -> X1, X3)
# ---------------------------------------------------------------------------

DATE_COLUMNS = {"d0": "dd/MM/yyyy", "d1": "yyyy-MM-dd", "d2": "dd-MM-yyyy", "d3": "MM/dd/yyyy", "d4": "dd/MM/yyyy HH:mm:ss"}
DATE_SQL = ["%d/%m/%Y", "%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y", "%d/%m/%Y %H:%M:%S"]
MIXED_DATES = ["dd.MM.yyyy", "yyyyMMdd", "dd MMM yyyy", "MMM dd, yyyy", "dd-MMM-yyyy HH:mm", "yyyy/MM/dd HH:mm:ss.SSS", "dd MM yyyy", "d.M.yy h:mm a"]
MIXED_SQL = ["%d.%m.%Y", "%Y%m%d", "%d %b %Y", "%b %d, %Y"]


@register("parse_dates_formats", "SELECT o_orderkey, " + ", ".join(
    f"CAST(o_orderdate AS DATE) AS {c}" for c in [*DATE_COLUMNS, "mixed"]) + ", CAST(NULL AS DATE) AS none FROM orders")
def q_parse_dates_formats(spark, sf):
    """a column in each elected format, one in eight layouts so that none
    wins (read by their shapes), and one that is no date."""
    day = F.to_date("o_orderdate")
    mixed = F.element_at(F.array(*[F.date_format(day, f) for f in MIXED_DATES]), (F.col("o_orderkey") % len(MIXED_DATES) + 1).cast("int"))
    text = FX.table(spark, sf, "orders").select("o_orderkey", *[F.date_format(day, f).alias(c) for c, f in DATE_COLUMNS.items()],
                                                mixed.alias("mixed"), F.lit("soon").alias("none"))
    parsed = CL.parse_dates(text, [*DATE_COLUMNS, "mixed", "none"])
    return text.select("o_orderkey", *[F.to_date(x).alias(c) for c, x in parsed.items()])


@register("rating_and_reviews", r"""
SELECT l_orderkey, l_linenumber,
  TRY_CAST(regexp_extract(t, '(\d+)[,.](\d+)', 1) || '.' || regexp_extract(t, '(\d+)[,.](\d+)', 2) AS DOUBLE) AS rating,
  TRY_CAST(list_extract(regexp_extract_all(t, '\d+'), -1) AS INTEGER) AS reviews
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'Nuevo'
        ELSE '4,' || lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') || ' (' || CAST(l_partkey % 300 AS VARCHAR) || ')' END AS t
      FROM lineitem)""")
def q_rating_reviews(spark, sf):
    """F24, F25."""
    t = F.expr("""CASE WHEN l_partkey % 5 = 0 THEN 'Nuevo' ELSE concat('4,', lpad(CAST(l_partkey % 100 AS STRING), 2, '0'), ' (',
                  CAST(l_partkey % 300 AS STRING), ')') END""")
    d = FX.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"))
    return d.select("l_orderkey", "l_linenumber", rating_value("t").alias("rating"), review_count("t").alias("reviews"))


@register("raw_mode_properties", f"""
SELECT n_name AS property, count(o_totalprice) AS reservas, {rnd(xsum('o_totalprice'))} AS ingresos,
  {rnd(xsum('o_totalprice') + ' / count(o_totalprice)')} AS ticket_medio
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def q_raw_mode(spark, sf):
    """Uncleaned bookings (numeric amounts, no nights) through a property
    operator."""
    o, c, n = (FX.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    raw = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
           .select(F.col("n_name").alias("R_PROPERTY_NAME"), F.col("o_totalprice").alias("R_TOTAL_AMOUNT")))
    return SM.grouped(CL.raw_mode_frame(raw), [], ["property"], ["reservas", "ingresos", "ticket_medio"])


SUMMER = ["Jul", "Ago"]
KPI_MONTHS_SQL = KPI_SQL.replace("WHERE property IS NOT NULL", "WHERE property IS NOT NULL AND month_short IN ('Jul', 'Ago')")


@register("property_kpis_months", with_bookings(
    "SELECT property, total_reservas, " + ", ".join(f"{rnd(c)} AS {c}" for c in KPI_COLS) + " FROM kpi", KPI_MONTHS_SQL))
def q_property_kpis_months(spark, sf):
    """The dashboard's month selection."""
    return rcols(PR.property_kpis(FX.bookings(spark, sf), SUMMER), KPI_COLS)


@register("property_list", with_bookings("SELECT DISTINCT property FROM bookings WHERE property IS NOT NULL"))
def q_property_list(spark, sf):
    return PR.property_list(FX.bookings(spark, sf))


@register("months_available", with_bookings("""
SELECT DISTINCT property, month, month_short FROM bookings WHERE property IS NOT NULL AND month IS NOT NULL"""))
def q_months_available(spark, sf):
    return PR.months_available(FX.bookings(spark, sf))


#: The calendar of the matrix' columns: the months that orders can fall in.
MATRIX_MONTHS = [f"{y}-{m:02d}" for y in range(1992, 1999) for m in range(1, 13)]
_MATRIX = ", ".join(f"""{rnd(f"coalesce(max(ingresos) FILTER (WHERE year_month = '{m}'), 0.0)")} AS "{m}\"""" for m in MATRIX_MONTHS)


@register("property_month_matrix_wide", with_bookings(f"SELECT property, {_MATRIX} FROM pm GROUP BY property", PM_SQL))
def q_matrix_wide(spark, sf):
    """A11 in its wide form: one column per month of a given calendar."""
    return rcols(SM.property_month_matrix(FX.bookings(spark, sf), MATRIX_MONTHS), [f"`{m}`" for m in MATRIX_MONTHS])


@register("unconfirmed_statuses_listed", with_bookings(
    "SELECT DISTINCT CAST(status AS VARCHAR) AS status FROM bookings_clean WHERE status_group <> 'Confirmada'"))
def q_unconfirmed_listed(spark, sf):
    """A14 on bookings none of which is confirmed."""
    return CL.unconfirmed_statuses(FX.bookings_clean(spark, sf).where("status_group <> 'Confirmada'"))


@register("customer_price_rank", with_views("""
SELECT o_orderkey, (SELECT count(*) FROM market WHERE precio_noche < p) AS n_below
FROM (SELECT o_orderkey, o_totalprice / (1 + o_orderkey % 7) AS p FROM orders WHERE o_orderkey % 3 <> 1)
UNION ALL SELECT o_orderkey, CAST(NULL AS BIGINT) FROM orders WHERE o_orderkey % 3 = 1""".replace(
    "(SELECT count(*) FROM market WHERE precio_noche < p)",
    "coalesce((SELECT max(upto) FROM ranks WHERE ranks.v < p), 0)"), MARKET,
    """ranks AS (SELECT v, sum(c) OVER (ORDER BY v) AS upto
  FROM (SELECT CAST(precio_noche AS DOUBLE) AS v, count(*) AS c FROM market WHERE precio_noche IS NOT NULL GROUP BY 1))"""))
def q_customer_price_rank(spark, sf):
    """A30's rank lookup with every order as a probe, a third without a price."""
    price = F.when(F.col("o_orderkey") % 3 != 1, F.col("o_totalprice") / (1 + F.col("o_orderkey") % 7))
    probes = FX.table(spark, sf, "orders").select("o_orderkey", price.alias("p"))
    return MK.count_below(FX.market(spark, sf), "precio_noche", probes, "p").select("o_orderkey", "n_below")


@register("market_upsert_two_batches", with_views(f"""
SELECT {', '.join(MARKET_PAYLOAD[:3])}, coalesce(TRY_CAST(precio_noche AS INTEGER), 0) AS precio_noche,
       {', '.join(MARKET_PAYLOAD[4:])} FROM (
  SELECT *, row_number() OVER (PARTITION BY url, checkin ORDER BY l_orderkey % 2 DESC, l_orderkey DESC, l_linenumber DESC,
                               precio_noche DESC, rating DESC NULLS LAST, ciudad DESC) AS rn FROM market)
WHERE rn = 1""", MARKET))
def q_market_upsert_two(spark, sf):
    """K1 + N8: a later capture over an existing store."""
    old, new = FX.store_batches(spark, sf)
    return MK.upsert_listings(old, new, order=UPSERT_ORDER, drop=["l_orderkey", "l_linenumber"]).select(*MARKET_PAYLOAD)


@register("page_listings", rf"""
SELECT page_id, CAST(card_no AS INTEGER) AS card_no, title AS nombre, price AS precio_noche,
       CAST('4.' || CAST(page_id % 90 + 10 AS VARCHAR) AS DOUBLE) AS rating, CAST(page_id % 500 AS INTEGER) AS num_reviews,
       CASE WHEN page_id % 2 = 0 THEN 'Casa entera' ELSE 'Habitación privada' END AS tipo,
       '{S.LISTING_SITE_ROOT}/rooms/' || CAST(page_id AS VARCHAR) || '-' || CAST(card_no + 1 AS VARCHAR) AS url
FROM (SELECT page_id, card_no, trim(t || ' vista al mar') AS title,
             CASE card_no WHEN 0 THEN CASE WHEN page_id % 400 >= 10 THEN CAST(page_id % 400 AS INTEGER) END
                          ELSE greatest(1, CAST(floor((CASE WHEN page_id + 200 > 99999 THEN CAST(left(CAST(page_id + 200 AS VARCHAR), 5) AS BIGINT)
                                                       ELSE page_id + 200 END) / 3) AS INTEGER)) END AS price
      FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'),
                                                '\s+', ' ', 'g')) AS t FROM pages WHERE page_id % 7 <> 0)
           CROSS JOIN (VALUES (0), (1)) AS c(card_no))
WHERE price IS NOT NULL AND price <> 0""")
def q_page_listings(spark, sf):
    """X2 -> X1: title, price and link cut from each page's cards; a card ends
    with its element, so footers and texts between cards belong to none."""
    out = MK.page_listings(FX.pages_with_cards(spark, sf), "2026-07-15", "2026-07-18", "2026-07-01", F.lit("X"), F.lit("Y"))
    return out.select("page_id", F.col("card_no").cast("int").alias("card_no"), "nombre", "precio_noche", "rating", "num_reviews", "tipo", "url")


def _block_sql(name: str) -> str:
    """Outermost elements of a kind, from the running count of its open and
    closed tags: an element ends at the first later closing tag with the count
    from before it."""
    return rf"""
WITH token AS (
  SELECT page_id, unnest(t) AS tok, unnest(range(len(t))) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|[^<]+|<') AS t FROM pages)),
step AS (
  SELECT *, CASE WHEN regexp_matches(tok, '(?i)^<{name}\b') THEN 1 WHEN regexp_matches(tok, '(?i)^</{name}\b') THEN -1 ELSE 0 END AS s FROM token),
run AS (SELECT *, sum(s) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM step),
opened AS (SELECT page_id, i, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS card_no FROM run WHERE s = 1 AND depth = 1),
closed AS (SELECT o.page_id, o.card_no, o.i AS lo, min(r.i) AS hi FROM opened o JOIN run r ON r.page_id = o.page_id AND r.i > o.i AND r.s = -1 AND r.depth = 0 GROUP BY ALL)
SELECT c.page_id, CAST(card_no AS INTEGER) AS card_no,
       trim(regexp_replace(regexp_replace(coalesce(string_agg(tok, '' ORDER BY i), ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
FROM closed c LEFT JOIN run r ON r.page_id = c.page_id AND r.i > c.lo AND r.i < c.hi GROUP BY c.page_id, card_no"""


@register("page_blocks", _block_sql("div"))
def q_page_blocks(spark, sf):
    """X2's depth scan on the pages as they are: every outermost ``div``."""
    pages = FX.table(spark, sf, "pages").select("page_id", "html")
    return MK.page_cards(pages, ["div"]).withColumn("card_no", F.col("card_no").cast("int"))


@register("city_by_keyword", with_views("""
SELECT propiedad, arg_min(ciudad, prio) AS ciudad FROM names JOIN words ON contains(lower(propiedad), keyword) GROUP BY propiedad""",
    BOOKINGS_RAW, MARKET, """names AS (
  SELECT DISTINCT propiedad FROM (SELECT R_PROPERTY_NAME AS propiedad FROM bookings_raw UNION ALL SELECT nombre || ' en ' || ciudad FROM market)
  WHERE propiedad IS NOT NULL)""", """words AS (
  SELECT n_nationkey * 2 AS prio, lower(n_name) AS keyword, 'City ' || CAST(n_nationkey AS VARCHAR) AS ciudad FROM nation
  UNION ALL SELECT n_nationkey * 2 + 1, lower(substr(n_name, 2, 4)), 'City ' || CAST(n_nationkey AS VARCHAR) FROM nation
  UNION ALL SELECT p_partkey % 40 * 100000 + p_partkey, lower(p_name), 'Zone ' || CAST(p_partkey AS VARCHAR) FROM part)"""))
def q_city_by_keyword(spark, sf):
    """Containment join with a keyword table."""
    names, words = FX.names_and_keywords(spark, sf)
    return PL.detect_city_join(names, words)


_STORE = """SELECT {cols} FROM (
  SELECT *, row_number() OVER (PARTITION BY url, checkin ORDER BY l_orderkey DESC, l_linenumber DESC, precio_noche DESC,
                               rating DESC NULLS LAST, ciudad DESC) AS rn FROM market {where})
WHERE rn = 1"""


@register("market_store_merge", with_views(_STORE.format(cols=f"{', '.join(MARKET_PAYLOAD[:3])}, coalesce(TRY_CAST(precio_noche AS INTEGER), 0) AS precio_noche, "
                                                         f"{', '.join(MARKET_PAYLOAD[4:])}", where=""), MARKET))
def q_market_store_merge(spark, sf):
    """K1 + N8 through the bucketed store: two batches merged, one read."""
    from stayspark.session import run_folder
    from stayspark.sources.market_store import ListingStore
    old, new = FX.store_batches(spark, sf)
    store = ListingStore(spark, f"{run_folder(spark)}/listing-store-{uuid.uuid4().hex}", UPSERT_ORDER)
    store.merge(new, "captures", 1)
    store.merge(old, "captures", 0)
    return store.listings().select(*MARKET_PAYLOAD)


@register("market_snapshot_diff", with_views("""
SELECT coalesce(a.url, b.url) AS url, coalesce(a.checkin, b.checkin) AS checkin,
       CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'gone' ELSE 'repriced' END AS change,
       a.precio_noche AS old_price, b.precio_noche AS new_price
FROM a FULL JOIN b ON a.url = b.url AND a.checkin = b.checkin
WHERE a.url IS NULL OR b.url IS NULL OR a.precio_noche IS DISTINCT FROM b.precio_noche""", MARKET,
    "a AS (" + _STORE.format(cols="url, checkin, precio_noche", where="WHERE l_orderkey % 2 = 0") + ")",
    "b AS (" + _STORE.format(cols="url, checkin, precio_noche", where="WHERE l_orderkey % 2 = 1") + ")"))
def q_market_snapshot_diff(spark, sf):
    """K2: two dated snapshots, written and compared as of later days."""
    import datetime as dt

    from stayspark.session import run_folder
    from stayspark.sources.market_store import snapshot, snapshot_at, snapshot_diff
    root = f"{run_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    for day, batch in zip((dt.date(2026, 7, 1), dt.date(2026, 7, 8)), FX.store_batches(spark, sf)):
        snapshot(MK.upsert_listings(None, batch, order=UPSERT_ORDER), root, day)
    return snapshot_diff(snapshot_at(spark, root, dt.date(2026, 7, 5)), snapshot_at(spark, root, dt.date(2026, 7, 30)))


@register("robot_page_flag_mixed", """
SELECT page_id, page_id % 5 = 0 AND page_id % 7 = 0 AS is_robot FROM pages""")
def q_robot_mixed(spark, sf):
    """X3 where pages hold robot checks, listings, both or neither (a card
    page carries the listing marker)."""
    p = FX.pages_with_cards(spark, sf)
    p = p.withColumn("html", F.regexp_replace("html", 'itemprop="x"', 'itemprop="itemListElement"'))
    return p.select("page_id", MK.robot_page_flag(p).alias("is_robot"))


# ---------------------------------------------------------------------------
# Files (S1-S3): written from the tables, read back by the readers
# ---------------------------------------------------------------------------

_CSV_COLS = ["R_STATUS", "R_ARRIVAL", "R_DEPARTURE", "R_NIGHTS", "R_PROPERTY_NAME", "R_SOURCE", "R_GUEST_NAME"]


def _as_csv(df, name: str, sep: str) -> str:
    """A folder of Latin-1 files, as an upload would deliver them."""
    from stayspark.session import run_folder
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.csv"
    df.write.options(header=True, sep=sep, quote='"', escape='"', encoding="ISO-8859-1", emptyValue="", nullValue="").csv(path)
    return path


@register("csv_bookings", with_views(f"""
SELECT CAST(R_ID AS VARCHAR) AS R_ID, {', '.join(_CSV_COLS)}, replace(R_TOTAL_AMOUNT, '€', 'EUR') AS R_TOTAL_AMOUNT,
       CASE R_ID % 3 WHEN 0 THEN concat('Llegada; tarde', chr(10), chr(10), 'habitación "', CAST(R_ID AS VARCHAR), '"')
                     WHEN 1 THEN concat('5" ', R_GUEST_NAME) END AS note
FROM bookings_raw""", BOOKINGS_RAW))
def q_csv_bookings(spark, sf):
    """S1 + S2: bookings with notes that hold line breaks, separators and
    quotes, written as CSV and loaded by suffix, separator and header."""
    from stayspark.sources.files import load_file
    raw = FX.bookings_raw(spark, sf)
    note = (F.when(F.col("R_ID") % 3 == 0, F.concat(F.lit('Llegada; tarde\n\nhabitación "'), F.col("R_ID").cast("string"), F.lit('"')))
            .when(F.col("R_ID") % 3 == 1, F.concat(F.lit('5" '), F.col("R_GUEST_NAME"))))
    out = raw.select("R_ID", *_CSV_COLS, F.replace("R_TOTAL_AMOUNT", F.lit("€"), F.lit("EUR")).alias("R_TOTAL_AMOUNT"), note.alias("note"))
    return load_file(spark, _as_csv(out, "bookings", ";"))


@register("csv_planner_inputs", with_views("SELECT * FROM si", BOOKINGS_RAW, _search_inputs_sql()))
def q_csv_planner_inputs(spark, sf):
    """S3 -> N10: the planner's read of a comma-separated file."""
    from stayspark.sources.files import read_planner_bookings
    raw = FX.bookings_raw(spark, sf).select("R_ID", *_CSV_COLS)
    return PL.search_inputs(read_planner_bookings(spark, _as_csv(raw, "planner", ",")), FX.FIXTURE_CITY_KEYWORDS)
