"""Booking cleaning and calendar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayspark import schema as S
from stayspark.functions.text import bind, col_or_lit, plain_number, py_strip, py_title

__all__ = [
    "clean_money", "parse_timestamp", "nights_filled",
    "classify_status", "normalize_channel", "price_per_night", "month_name",
    "month_short", "quarter_label", "season", "dow_es", "iso_week",
    "is_weekend", "is_holiday", "year_month", "any_null", "confirmed_paid",
]


def clean_money(c) -> Column:
    """F1: money text -> double; blank / unparsable -> 0.0, never null.

    Everything but digits, signs and separators goes first (one regex); which
    separator is the decimal one depends on their order.
    """
    def plain(d: Column) -> Column:
        dot, comma = F.instr(d, "."), F.instr(d, ",")
        return (F.when((dot > 0) & (dot < comma), F.translate(d, ",.", "."))
                .when((dot > 0) & (comma > 0), F.translate(d, ",", ""))
                .otherwise(F.translate(d, ",", ".")))

    kept = F.regexp_replace(col_or_lit(c).cast("string"), r"[^0-9.,\-]+", "")
    return F.coalesce(bind(kept, plain).try_cast("double"), F.lit(0.0))


def parse_timestamp(c, fmt: str) -> Column:
    """``try_to_timestamp`` that is only attempted when the text contains the
    pattern's separators (a necessary condition, so the result is the same;
    it skips the cost of failed parses on the other layouts)."""
    s = col_or_lit(c).cast("string")
    guard = F.lit(True)
    for sep in sorted({ch for ch in fmt if ch in "/-:"}):
        guard = guard & (F.instr(s, sep) > 0)
    return F.when(guard, F.try_to_timestamp(s, F.lit(fmt)))


def nights_filled(nights, arrival, departure) -> Column:
    """numeric nights; missing ones from whole days between the dates."""
    days = F.floor((F.unix_seconds(departure) - F.unix_seconds(arrival)) / F.lit(86400.0))
    num = plain_number(nights) if nights is not None else F.lit(None).cast("double")
    if arrival is None or departure is None:
        return num
    return F.coalesce(num, days.cast("double"))


def classify_status(c) -> Column:
    """exact, case-sensitive status group."""
    c = col_or_lit(c)
    return (F.when(c.isNull(), "Desconocido")
            .when(c.isin(S.STATUS_CONFIRMED), "Confirmada")
            .when(c.isin(S.STATUS_CANCELLED), "Cancelada")
            .when(c.isin(S.STATUS_BLOCKED), "Bloqueada")
            .when(c.isin(S.STATUS_OPEN), "Abierta")
            .otherwise("Otro"))


def normalize_channel(c) -> Column:
    """channel label; ordered patterns, else Python-style title case."""
    c = col_or_lit(c).cast("string")
    out = F.when(c.isNull() | py_strip(c).isin(S.CHANNEL_BLANK), S.CHANNEL_NONE)
    for pattern, label in S.CHANNEL_PATTERNS:
        out = out.when(c.rlike(pattern), label)
    return out.otherwise(py_title(py_strip(c)))


def price_per_night(amount, nights) -> Column:
    """amount / nights when both are positive, else NULL."""
    a, n = col_or_lit(amount), col_or_lit(nights)
    return F.when((n > 0) & (a > 0), a / n)


def _pick(labels, one_based_idx) -> Column:
    """Dictionary lookup as a literal array (no join)."""
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), one_based_idx)


def month_name(ts) -> Column:
    return _pick(S.MONTH_ES, F.month(ts))


def month_short(ts) -> Column:
    return _pick(S.MONTH_ES_SHORT, F.month(ts))


def quarter_label(ts) -> Column:
    return F.concat(F.lit("Q"), F.quarter(ts).cast("string"))


def season(ts) -> Column:
    return _pick(S.SEASON_BY_MONTH, F.month(ts))


def dow_es(ts) -> Column:
    return _pick(S.DOW_ES, F.weekday(ts) + 1)


def iso_week(ts) -> Column:
    return F.weekofyear(ts)


def is_weekend(ts) -> Column:
    """Friday to Sunday; NULL date -> false."""
    return F.coalesce(F.weekday(ts) >= 4, F.lit(False))


def is_holiday(ts) -> Column:
    return F.coalesce(F.date_format(ts, "MM-dd").isin(S.HOLIDAYS_MM_DD), F.lit(False))


def year_month(ts) -> Column:
    return F.date_format(ts, "yyyy-MM")


def any_null(cols) -> Column:
    """true when any of the columns is NULL."""
    out = F.lit(False)
    for c in cols:
        out = out | col_or_lit(c).isNull()
    return out


def confirmed_paid() -> Column:
    """W1 predicate."""
    return (F.col("status_group") == "Confirmada") & (F.col("amount") > 0)
