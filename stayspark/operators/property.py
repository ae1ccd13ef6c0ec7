"""Per-property dashboard facts for all properties at once (A15-A19, A28,
A33-A36, W3, W4, O3, U1).

A dashboard shows these for one selected property; here each output
has one row (or a few rows) per property and a selection is just a filter.
Group sizes are bounded where windows are used (<= 12 months, <= 11 peers).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayspark import schema as S
from stayspark.functions.labels import clip_pct, days_in_month, days_in_quarter
from stayspark.operators.quantiles import attach, small_quantile
from stayspark.operators.summary import exact_avg, exact_sum

P = "property"


def select_months(df: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Keep the given short month labels; empty / None = no filter."""
    return df.where(F.col("month_short").isin(list(months))) if months else df


def property_list(df: DataFrame) -> DataFrame:
    """Sorted distinct properties."""
    return df.select(P).where(F.col(P).isNotNull()).distinct().orderBy(P)


def months_available(df: DataFrame) -> DataFrame:
    """O5 + U2: (property, month, month_short) present, in month order (the
    month choices of each property); ``dropDuplicates`` on the key."""
    return (df.where(F.col(P).isNotNull() & F.col("month").isNotNull())
            .select(P, "month", "month_short").dropDuplicates([P, "month"]).orderBy(P, "month"))


def property_kpis(df: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """A15 + A16: revenue, mean booking value, mean nightly price, bookings,
    nights and occupancy over the arrival span (capped at 100)."""
    d = select_months(df.where(F.col(P).isNotNull()), months)
    g = d.groupBy(P).agg(
        F.coalesce(exact_sum("amount"), F.lit(0.0)).alias("total_ingresos"),
        exact_avg("amount").alias("ingresos_mes"),
        exact_avg("price_per_night").alias("precio_medio"),
        F.count(F.lit(1)).alias("total_reservas"),
        F.coalesce(F.sum("nights"), F.lit(0.0)).alias("total_noches"),
        F.min("arrival").alias("_a0"), F.max("arrival").alias("_a1"))
    days = F.greatest(F.floor((F.unix_seconds("_a1") - F.unix_seconds("_a0")) / F.lit(86400.0)), F.lit(1))
    return g.withColumn("ocupacion_pct", F.least(F.col("total_noches") / days * 100, F.lit(100.0))
                        ).drop("_a0", "_a1")


def property_monthly(df: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Revenue and nights per (property, month number), years merged."""
    d = select_months(df.where(F.col(P).isNotNull() & F.col("month").isNotNull()), months)
    return d.groupBy(P, "month", "month_short").agg(
        F.coalesce(exact_sum("amount"), F.lit(0.0)).alias("ingresos"),
        F.coalesce(F.sum("nights"), F.lit(0.0)).alias("noches"))


def golden_month(df: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Month of maximum revenue per property (earliest month on ties)."""
    m = property_monthly(df, months)
    return m.groupBy(P).agg(
        F.min_by("month_short", F.struct(-F.col("ingresos"), F.col("month"))).alias("gold_month"),
        F.max("ingresos").alias("gold_value"))


def occupancy_by_month(df: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Nights sold / days of the month (Feb = 28), clipped to 0..100."""
    m = property_monthly(df, months)
    return m.select(P, "month", "month_short", "noches", days_in_month("month").alias("dias_mes"),
                    clip_pct(F.col("noches") / days_in_month("month") * 100).alias("ocupacion_pct"))


def occupancy_by_quarter(df: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Nights / 90, 91, 92, 92 days per quarter, clipped; plus revenue."""
    d = select_months(df.where(F.col(P).isNotNull() & F.col("quarter").isNotNull()), months)
    g = d.groupBy(P, "quarter").agg(F.coalesce(F.sum("nights"), F.lit(0.0)).alias("noches"),
                                    F.coalesce(exact_sum("amount"), F.lit(0.0)).alias("ingresos"))
    return g.select(P, "quarter", "noches", "ingresos", days_in_quarter("quarter").alias("dias"),
                    clip_pct(F.col("noches") / days_in_quarter("quarter") * 100).alias("ocupacion"))


def peer_comparison(df: DataFrame, months: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """For every property, its own row (marked with a star) and the
    ``top`` other properties by revenue (W3, O4, U1).

    The candidates are the global top ``top + 1`` (a bounded list), attached
    to each property as one sorted array: its own row leaves the array, the
    first ``top`` stay. No join on an inequality, no shuffle of partner rows.
    """
    k = property_kpis(df, months).select(P, F.col("total_ingresos").alias("ingresos"),
                                         F.col("total_reservas").alias("reservas"),
                                         F.col("precio_medio").alias("precio"))
    leaders = k.orderBy(F.desc("ingresos"), P).limit(top + 1)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("ingresos")).alias("o"), P, "ingresos", "reservas", "precio")))
    sel = attach(k.select(F.col(P).alias("propiedad_sel")), "_l", leaders.agg(ranked.alias("a")))
    others = F.slice(F.filter("_l.a", lambda x: x[P] != F.col("propiedad_sel")), 1, top)
    pairs = sel.select("propiedad_sel", F.explode(others).alias("x")).select("propiedad_sel", "x.*")
    own = k.select(F.col(P).alias("propiedad_sel"), F.concat(F.lit(S.PEER_PREFIX), F.col(P)).alias(P),
                   "ingresos", "reservas", "precio")
    return own.unionByName(pairs.select("propiedad_sel", P, "ingresos", "reservas", "precio"))


def price_gap(df: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Own mean nightly price vs the row-level mean of all other bookings
    (total minus own; those without a property are among the others), and the
    rule outcome."""
    d = select_months(df, months)
    own = d.where(F.col(P).isNotNull()).groupBy(P).agg(exact_avg("price_per_night").alias("precio_medio"),
                           exact_sum("price_per_night").alias("_s"), F.count("price_per_night").alias("_c"))
    own = attach(own, "_t", d.agg(exact_sum("price_per_night").alias("s"), F.count("price_per_night").alias("c")))
    media = F.try_divide(F.col("_t.s") - F.coalesce(F.col("_s"), F.lit(0.0)), F.col("_t.c") - F.col("_c"))
    own = own.withColumn("media_cartera", media)
    diff = F.when(F.col("media_cartera") != 0,
                  (F.col("precio_medio") - F.col("media_cartera")) / F.col("media_cartera") * 100
                  ).otherwise(F.lit(0.0))
    own = own.withColumn("diff_pct", F.when(F.col("precio_medio") > 0, diff))
    rule = (F.when(F.col("diff_pct") < -10, F.lit("raise")).when(F.col("diff_pct") > 15, F.lit("review")))
    return own.select(P, "precio_medio", "media_cartera", "diff_pct", rule.alias("regla"))


def _filled(template: str, **fills: Column) -> Column:
    """A fixed text with its ``{name}`` holes filled by columns."""
    parts = [F.lit(p) if i % 2 == 0 else fills[p] for i, p in enumerate(re.split(r"[{}]", template))]
    return F.concat(*parts)


def _fmt0(c: Column) -> Column:
    """``{:,.0f}``: half-even to units, thousands separators."""
    return F.format_number(F.bround(c, 0), 0)


def recommendations(df: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Numbered recommendation rows (rec_no, title, text) per property."""
    R = S.RECOMMENDATIONS
    m = property_monthly(df, months)
    w_top = Window.partitionBy(P).orderBy(F.desc("ingresos"), "month")  # <= 12 rows
    w_bot = Window.partitionBy(P).orderBy(F.asc("ingresos"), "month")
    m = m.withColumn("_t", F.row_number().over(w_top)).withColumn("_b", F.row_number().over(w_bot))
    months_f = m.groupBy(P).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_t") <= 3, F.struct("_t", "month_short")))),
                                 lambda s: s["month_short"]), ", ").alias("top3"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_b") <= 3, F.struct("_b", "month_short")))),
                                 lambda s: s["month_short"]), ", ").alias("bot3"),
        F.min_by("month_short", F.struct(-F.col("ingresos"), F.col("month"))).alias("gold"))
    gap = price_gap(df, months)
    j = gap.join(months_f, P, "left")

    def txt(key: str, **fills) -> Column:
        return _filled(R[key][1], **fills)

    def rec(key: str, text: Column, cond: Column | None = None) -> Column:
        r = F.struct(F.lit(R[key][0]).alias("title"), text.alias("text"))
        return r if cond is None else F.when(cond, r)

    has_months = F.col("top3").isNotNull()
    recs = F.array(
        rec("raise", txt("raise", top3=F.col("top3")), has_months),
        rec("low_season", txt("low_season", bot3=F.col("bot3")), has_months),
        rec("price_up", txt("price_up", ppn=_fmt0(F.col("precio_medio")), pct=_fmt(F.abs(F.col("diff_pct")), 0),
                                   media=_fmt0(F.col("media_cartera"))), F.col("regla") == "raise"),
        rec("price_review", txt("price_review", pct=_fmt(F.col("diff_pct"), 0)), F.col("regla") == "review"),
        rec("reviews", F.lit(R["reviews"][1])),
        rec("min_stay", txt("min_stay", gold=F.coalesce(F.col("gold"), F.lit("N/A")))),
    )
    j = j.select(P, F.filter(recs, lambda x: x.isNotNull()).alias("recs"))
    return j.select(P, F.posexplode("recs").alias("rec_no", "r")).select(
        P, (F.col("rec_no") + 1).alias("rec_no"), F.col("r.title").alias("title"), F.col("r.text").alias("text"))


def projection(df: DataFrame, months: Sequence[str] | None = None, growth: float = S.GROWTH_RATE,
               occupancy_uplift: float = S.OCCUPANCY_UPLIFT) -> DataFrame:
    """+growth on the monthly mean and total, occupancy target capped."""
    k = property_kpis(df, months)
    return k.select(P, (F.col("ingresos_mes") * (1 + growth)).alias("proy_ingreso_mensual"),
                    (F.col("total_ingresos") * (1 + growth)).alias("proy_ingreso_anual"),
                    F.least(F.col("ocupacion_pct") * occupancy_uplift, F.lit(100.0)).alias("ocupacion_objetivo"))


def projection_monthly(df: DataFrame, months: Sequence[str] | None = None,
                       growth: float = S.GROWTH_RATE) -> DataFrame:
    """Real vs projected revenue per property and month."""
    m = property_monthly(df, months)
    return m.select(P, "month", "month_short", "ingresos", (F.col("ingresos") * (1 + growth)).alias("proyeccion"))


def _fmt(c: Column, d: int) -> Column:
    """``{:.df}`` without separators (half-even)."""
    return F.format_string(f"%.{d}f", F.bround(c, d))


def property_diagnosis(df: DataFrame, prop_name: str | None = None) -> DataFrame:
    """Pros, cons, months to raise prices and metrics for every
    property, from four small group-bys joined on the property."""
    T = S.DIAGNOSIS_TEXT
    d = df.where(F.col(P).isNotNull())
    base = d.groupBy(P).agg(exact_avg("price_per_night").alias("ppn"),
                            F.coalesce(exact_sum("amount"), F.lit(0.0)).alias("rev_total"),
                            F.count(F.lit(1)).alias("bookings"), F.count("amount").alias("_n_amount"))
    # the portfolio's mean is taken over all bookings, with or without a property
    glob = df.agg(exact_avg("price_per_night").alias("gppn"))
    base = attach(base, "_g", glob)
    base = attach(base, "_mn", base.agg(F.avg("_n_amount").alias("v")))
    base = base.withColumn("_mean_n", F.col("_mn.v")).drop("_mn")
    ch = d.groupBy(P, "channel").agg(F.count(F.lit(1)).alias("c"))
    ch = ch.groupBy(P).agg(F.min_by("channel", F.struct(-F.col("c"), F.col("channel"))).alias("top_channel"),
                           (F.max("c") / F.sum("c")).alias("top_share"))
    mo = d.where(F.col("month").isNotNull()).groupBy(P, "month").agg(
        F.coalesce(exact_sum("amount"), F.lit(0.0)).alias("rev"), F.count("amount").alias("cnt"))
    w = Window.partitionBy(P)  # <= 12 months per property
    mo = mo.withColumn("_med", small_quantile("cnt", 0.5, w))
    mo_agg = mo.groupBy(P).agg(
        F.try_divide(F.stddev_samp("rev"), F.avg("rev")).alias("cv"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("cnt") >= F.col("_med"), F.col("month")))),
                    lambda x: F.element_at(F.array(*[F.lit(n) for n in S.MONTH_ES]), x)).alias("raise_months"))
    j = base.join(ch, P, "left").join(mo_agg, P, "left")
    g = F.col("_g.gppn")
    pros = F.filter(F.array(
        F.when(F.col("ppn") > g * 1.1, _filled(T["adr_high"], ppn=_fmt(F.col("ppn"), 0), pct=_fmt((F.col("ppn") / g - 1) * 100, 1))),
        F.when(F.col("bookings") > F.col("_mean_n"), F.lit(T["rotation"])),
        F.when(F.col("top_share") < 0.5, F.lit(T["diversified"])),
    ), lambda x: x.isNotNull())
    cons = F.filter(F.array(
        F.when(F.col("ppn") < g * 0.9, _filled(T["adr_low"], gppn=_fmt(g, 0))),
        F.when(F.col("cv") > 0.5, F.lit(T["volatile"])),
        F.when(F.col("top_share") > 0.7, _filled(T["dependent"], share=_fmt(F.col("top_share") * 100, 0), channel=F.col("top_channel"))),
    ), lambda x: x.isNotNull())
    out = j.select(
        P,
        F.when(F.size(pros) > 0, pros).otherwise(F.array(F.lit(T["no_pros"]))).alias("pros"),
        F.when(F.size(cons) > 0, cons).otherwise(F.array(F.lit(T["no_cons"]))).alias("cons"),
        F.coalesce(F.col("raise_months"), F.array().cast("array<string>")).alias("raise_months"),
        "rev_total", "ppn", "bookings")
    return out.where(F.col(P) == prop_name) if prop_name is not None else out


def advisor_facts(df: DataFrame, market: DataFrame, months: Sequence[str] | None = None,
                  stats: DataFrame | None = None) -> DataFrame:
    """Per property KPIs, golden month and the market mean / median
    (whole market, before any season filter) with the relative position.
    ``stats`` reuses a market_price_stats row of the same market."""
    from stayspark.operators.market import coerce_market, market_price_stats
    k = property_kpis(df, months).join(golden_month(df, months), P, "left")
    k = attach(k, "_m", stats if stats is not None else market_price_stats(coerce_market(market)))
    diff = F.when(F.col("_m.m_mean") != 0,
                  (F.col("precio_medio") - F.col("_m.m_mean")) / F.col("_m.m_mean") * 100).otherwise(0.0)
    return k.select(P, "total_ingresos", "precio_medio", "ocupacion_pct", "total_reservas",
                    F.coalesce(F.col("gold_month"), F.lit("N/A")).alias("gold_month"),
                    F.coalesce(F.col("gold_value"), F.lit(0.0)).alias("gold_value"),
                    F.col("_m.m_mean").alias("m_mean"), F.col("_m.m_median").alias("m_median"),
                    diff.alias("diff_m"))


__all__ = ["property_list", "months_available", "property_kpis", "property_monthly", "golden_month", "occupancy_by_month",
           "occupancy_by_quarter", "peer_comparison", "price_gap", "recommendations", "projection",
           "projection_monthly", "property_diagnosis", "advisor_facts"]
