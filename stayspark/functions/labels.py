"""Labels and lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayspark import schema as S
from stayspark.functions.text import col_or_lit

__all__ = ["elasticity_label", "opportunity_label", "channel_commission",
           "days_in_month", "days_in_quarter", "clip_pct", "market_season_months",
           "month_in_season"]


def elasticity_label(e) -> Column:
    """F32."""
    e = col_or_lit(e)
    return (F.when(e > -0.5, S.ELASTICITY_LABELS[0])
            .when(e > -1.0, S.ELASTICITY_LABELS[1])
            .otherwise(S.ELASTICITY_LABELS[2]))


def opportunity_label(tier) -> Column:
    """F33."""
    t = col_or_lit(tier)
    return (F.when(t == "Pico", S.OPPORTUNITY_LABELS["Pico"])
            .when(t == "Alto", S.OPPORTUNITY_LABELS["Alto"])
            .when(t == "Normal", S.OPPORTUNITY_LABELS["Normal"])
            .otherwise(S.OPPORTUNITY_LABELS["Valle"]))


def channel_commission(channel) -> Column:
    """estimated commission, 0 for channels not listed (J4: literal map)."""
    m = F.create_map(*[x for k, v in S.CHANNEL_COMMISSION.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, col_or_lit(channel)), F.lit(0.0))


def days_in_month(month) -> Column:
    """days per month number, February = 28."""
    return F.try_element_at(F.array(*[F.lit(d) for d in S.DAYS_PER_MONTH]), col_or_lit(month))


def days_in_quarter(q) -> Column:
    m = F.create_map(*[x for k, v in S.DAYS_PER_QUARTER.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, col_or_lit(q))


def clip_pct(x) -> Column:
    return F.least(F.greatest(col_or_lit(x), F.lit(0.0)), F.lit(100.0))


def market_season_months(label: str) -> list[int]:
    """'alta' | 'media' | 'baja' (a label containing one of them)."""
    low = label.lower()
    for key, months in S.MARKET_SEASONS.items():
        if key in low:
            return months
    raise ValueError(f"unknown market season: {label}")


def month_in_season(checkin, label: str) -> Column:
    return F.month(col_or_lit(checkin)).isin(market_season_months(label))
