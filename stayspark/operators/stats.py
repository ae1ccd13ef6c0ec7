"""Outliers, demand peaks, price elasticity and demand tiers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayspark import schema as S
from stayspark.functions.labels import elasticity_label
from stayspark.operators.quantiles import attach, exact_quantiles, small_quantile
from stayspark.operators.summary import monthly_summary, r2


def outlier_report(df: DataFrame, col: str = "amount", factor: float = 1.5,
                   threshold: float = 3.0) -> DataFrame:
    """Rows flagged by IQR or Z-score, largest value first. Both sets
    of statistics come from the base rows (two one-row aggregates)."""
    from stayspark.operators.clean import iqr_bounds
    z = df.agg(F.avg(col).alias("mu"), F.stddev_pop(col).alias("sd"))
    f = attach(attach(df, "_q", iqr_bounds(df, col, factor)), "_z", z)
    x = F.col(col)
    f = f.withColumns({
        "is_outlier_iqr": F.coalesce((x < F.col("_q.lo")) | (x > F.col("_q.hi")), F.lit(False)),
        "is_outlier_z": F.coalesce(F.abs(F.try_divide(x - F.col("_z.mu"), F.col("_z.sd"))) > threshold,
                                   F.lit(False)),
    }).drop("_q", "_z")
    f = f.withColumn("is_outlier", F.col("is_outlier_iqr") | F.col("is_outlier_z"))
    return f.where("is_outlier").orderBy(F.desc(col), *[c for c in ("id",) if c in df.columns])


def demand_peaks(df: DataFrame, keys: Sequence[str] = (), cut: float = 0.8) -> DataFrame:
    """Monthly summary with z of the booking counts (sample std);
    ``is_peak`` z > cut, ``is_valley`` z < -cut."""
    m = monthly_summary(df, keys)
    w = Window.partitionBy(*keys)  # at most 12 months per key
    z = F.try_divide(F.col("reservas") - F.avg("reservas").over(w), F.stddev_samp("reservas").over(w))
    m = m.withColumn("z_score", z)
    return m.withColumn("is_peak", F.coalesce(F.col("z_score") > cut, F.lit(False))) \
            .withColumn("is_valley", F.coalesce(F.col("z_score") < -cut, F.lit(False)))


def demand_peaks_summary(df: DataFrame, keys: Sequence[str] = (), cut: float = 0.8) -> DataFrame:
    """A23 as one row per key: arrays of peak and valley month names."""
    m = demand_peaks(df, keys, cut)
    return m.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("is_peak"), F.struct("month", "month_name")))),
                    lambda s: s["month_name"]).alias("peaks"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("is_valley"), F.struct("month", "month_name")))),
                    lambda s: s["month_name"]).alias("valleys"))


# -- A24-A26 -----------------------------------------------------------------

def _positive_prices(df: DataFrame, price: str, qty: str) -> DataFrame:
    """Rows with a positive price and a quantity."""
    return df.select(F.col(price).alias("p"), F.col(qty).alias("q")).where(
        F.col("p").isNotNull() & F.col("q").isNotNull() & (F.col("p") > 0))


def _capped_range(d: DataFrame, cap_quantile: float) -> DataFrame:
    """One row: the cap (W6) and the min / max of the values kept under it,
    all from one quantile pass. The largest kept value is the upper rank
    neighbour of the cap when the cap reaches it, else the lower one."""
    q = exact_quantiles(d, "p", {"cap": cap_quantile, "p0": 0.0}, neighbors=True)
    return q.select("cap", F.col("p0").alias("lo"),
                    F.when(F.col("cap") >= F.col("cap_b"), F.col("cap_b")).otherwise(F.col("cap_a")).alias("hi"))


def price_sample(df: DataFrame, price: str = "price_per_night", qty: str = "nights",
                 cap_quantile: float = 0.95) -> DataFrame:
    """W5 + W6: positive prices with a quantity, rows above the price
    quantile dropped."""
    d = attach(_positive_prices(df, price, qty), "_r", _capped_range(_positive_prices(df, price, qty), cap_quantile))
    return d.where(F.col("p") <= F.col("_r.cap")).drop("_r")


def price_bins(df: DataFrame, n_bins: int = 10, price: str = "price_per_night",
               qty: str = "nights", cap_quantile: float = 0.95) -> DataFrame:
    """Equal-width, right-closed bins over [min, max]; the first edge
    is lowered by 0.1 % of the range (so the minimum falls in bin 1)."""
    d0 = _positive_prices(df, price, qty)
    d = attach(d0, "_r", _capped_range(d0, cap_quantile)).where(F.col("p") <= F.col("_r.cap"))
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    step = (hi - lo) / F.lit(float(n_bins))
    # bin = 1 + number of inner edges (lo + i*step, i = 1..n-1) below the
    # value: estimated by division, then corrected by one step against the
    # very same edge expressions (so it equals the edge-by-edge count)
    p = F.col("p")
    edge = lambda k: k.cast("double") * F.col("_step") + lo
    k = F.least(F.greatest(F.ceil((p - lo) / F.col("_step")) - 1, F.lit(0)), F.lit(n_bins - 1))
    d = d.withColumn("_step", step).withColumn("_k", F.when(hi == lo, F.lit(0)).otherwise(k))
    d = d.withColumn("_k", F.when((F.col("_k") < n_bins - 1) & (p > edge(F.col("_k") + 1)), F.col("_k") + 1)
                     .otherwise(F.col("_k")))
    d = d.withColumn("_k", F.when((F.col("_k") > 0) & (p <= edge(F.col("_k"))), F.col("_k") - 1)
                     .otherwise(F.col("_k")))
    d = d.withColumn("bin", (F.col("_k") + 1).cast("int"))
    g = d.groupBy("bin").agg(
        F.count("q").alias("bookings"), F.avg("q").alias("avg_nights"), F.avg("p").alias("avg_price"),
        F.first("_r").alias("_r"))
    adj = (F.col("_r.hi") - F.col("_r.lo")) * 0.001
    stepc = (F.col("_r.hi") - F.col("_r.lo")) / F.lit(float(n_bins))
    const_adj = F.when(F.col("_r.lo") == 0, F.lit(0.001)).otherwise(F.abs(F.col("_r.lo")) * 0.001)
    g = g.withColumn("bin_lo", F.when(F.col("_r.hi") == F.col("_r.lo"), F.col("_r.lo") - const_adj)
                     .when(F.col("bin") == 1, F.col("_r.lo") - adj)
                     .otherwise(F.col("_r.lo") + (F.col("bin") - 1).cast("double") * stepc))
    g = g.withColumn("bin_hi", F.when(F.col("_r.hi") == F.col("_r.lo"), F.col("_r.hi") + const_adj)
                     .when(F.col("bin") == n_bins, F.col("_r.hi"))
                     .otherwise(F.col("_r.lo") + F.col("bin").cast("double") * stepc))
    g = g.withColumn("demand", F.col("bookings") * F.col("avg_nights"))
    g = g.withColumn("revenue_proxy", F.col("avg_price") * F.col("demand"))
    return g.drop("_r")


def _t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value for any integer degrees of freedom, by the
    closed finite series of the t distribution (no UDF). Each term follows
    from the one before it, so no factorial limits the degrees of freedom."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    c2 = F.pow(F.cos(theta), 2)

    def series(last: Column, ratio) -> Column:
        """1 + the terms up to ``last``, each the one before times ratio(k) * cos^2."""
        start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))
        steps = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1)).cast("int")), lambda k: k <= last)

        def add(acc: Column, k: Column) -> Column:
            term = acc["term"] * ratio(k.cast("double")) * c2
            return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))
        return F.aggregate(steps, start, add)["sum"]

    even = series((df - 2) / 2, lambda k: (2 * k - 1) / (2 * k))
    odd = series((df - 3) / 2, lambda k: 2 * k / (2 * k + 1))
    a_even = F.sin(theta) * even
    a_odd = F.when(df == 1, 2 * theta / F.lit(math.pi)).otherwise(
        2 / F.lit(math.pi) * (theta + F.sin(theta) * F.cos(theta) * odd))
    return 1 - F.when(df % 2 == 0, a_even).otherwise(a_odd)


def elasticity_fit(df: DataFrame, n_bins: int = 10, price: str = "price_per_night",
                   qty: str = "nights", bins: DataFrame | None = None) -> DataFrame:
    """A25 + A26 summary: log-log OLS over the bins, sweet spot, label.
    Fewer than 3 bins or identical x -> slope 0, r2 0, p 1. ``bins`` reuses
    an already computed :func:`price_bins` result."""
    b = (bins if bins is not None else price_bins(df, n_bins, price, qty)).select(
        "bin", "avg_price", "revenue_proxy",
        F.log(F.col("avg_price") + 1).alias("x"), F.log(F.col("demand") + 1).alias("y"))
    g = b.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.corr("x", "y").alias("r"), F.stddev_pop("x").alias("sx"),
        F.min_by("avg_price", F.struct(-F.col("revenue_proxy"), F.col("bin"))).alias("sweet"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    ok = (F.col("n") >= 3) & (F.col("sx") > 0) & F.col("r").isNotNull()
    dof = F.col("n") - 2
    t = F.col("r") * F.sqrt(dof.cast("double") / ((1.0 - F.col("r") + 1e-20) * (1.0 + F.col("r") + 1e-20)))
    g = g.select(
        F.when(ok, F.col("slope")).otherwise(0.0).alias("slope"),
        F.when(ok, F.col("intercept")).otherwise(0.0).alias("intercept"),
        F.when(ok, F.col("r") * F.col("r")).otherwise(0.0).alias("r2"),
        F.when(ok, _t_two_sided_p(t, dof)).otherwise(1.0).alias("p"),
        F.coalesce(F.col("sweet"), F.lit(0.0)).alias("sweet"), "n", "x_min", "x_max",
        ok.alias("fitted"))
    return g.select(
        F.col("slope").alias("elasticity"), F.col("r2").alias("r_squared"), F.col("p").alias("p_value"),
        F.col("sweet").alias("sweet_spot"),
        F.col("n").alias("n_bins"), elasticity_label(F.col("slope")).alias("interpretation"),
        "slope", "intercept", "x_min", "x_max", "fitted")


def elasticity_trend_line(df: DataFrame, n_bins: int = 10, points: int = 50,
                          price: str = "price_per_night", qty: str = "nights",
                          fit: DataFrame | None = None) -> DataFrame:
    """``points`` evenly spaced log prices, back in original units."""
    f = (fit if fit is not None else elasticity_fit(df, n_bins, price, qty)).where("fitted")
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    f = f.select("*", i)
    xr = F.when(F.col("i") == points - 1, F.col("x_max")).otherwise(
        F.col("x_min") + F.col("i").cast("double") * ((F.col("x_max") - F.col("x_min")) / F.lit(float(points - 1))))
    f = f.withColumn("xr", xr)
    return f.select("i", (F.exp("xr") - 1).alias("price"),
                    (F.exp(F.col("intercept") + F.col("slope") * F.col("xr")) - 1).alias("demand_pred"))


def price_elasticity(df: DataFrame, n_bins: int = 10, points: int = 50, price: str = "price_per_night",
                     qty: str = "nights") -> dict[str, DataFrame]:
    """The bins (at most ``n_bins`` rows) are the input of the fit and
    the trend line. Lazy; a caller that reads several of the results may cache
    ``binned``."""
    bins = price_bins(df, n_bins, price, qty)
    fit = elasticity_fit(df, n_bins, price, qty, bins=bins)
    return {"binned": bins, "fit": fit, "trend_line": elasticity_trend_line(df, n_bins, points, fit=fit)}


# -- A27 ---------------------------------------------------------------------

def dynamic_pricing(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Demand tier per month from the quantiles of the monthly counts
    and a price from the median monthly price (both over <= 12 rows/key)."""
    m = monthly_summary(df, keys)
    w = Window.partitionBy(*keys)
    m = m.withColumn("_base", small_quantile("ppn_medio", 0.5, w))
    for name, q, _ in S.DEMAND_TIERS:
        m = m.withColumn(f"_t{name}", small_quantile("reservas", q, w))
    tier = None
    mult = None
    for name, _, k in S.DEMAND_TIERS:
        cond = F.col("reservas") >= F.col(f"_t{name}")
        tier = (F.when if tier is None else tier.when)(cond, F.lit(name))
        mult = (F.when if mult is None else mult.when)(cond, F.lit(k))
    tier = tier.otherwise(F.lit(S.LOW_TIER[0]))
    mult = mult.otherwise(F.lit(S.LOW_TIER[1]))
    m = m.withColumn("demand_tier", tier).withColumn(
        "precio_sugerido_ppn", r2(F.col("_base") * mult))
    m = m.withColumn("delta_pct", r2(F.try_divide(F.col("precio_sugerido_ppn") - F.col("_base"),
                                                  F.col("_base")) * 100, 1))
    m = m.withColumn("base_ppn", r2(F.col("_base")))
    return m.drop("_base", *[f"_t{n}" for n, _, _ in S.DEMAND_TIERS])
