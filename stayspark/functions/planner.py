"""Search planner functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayspark import schema as S
from stayspark.functions.text import col_or_lit, plain_number, py_strip

__all__ = ["planner_date", "detect_city", "nights_int", "checkout_date", "stay_nights"]


def planner_date(c, formats=S.PLANNER_DATE_FORMATS) -> Column:
    """first of the formats that parses the stripped text; else NULL."""
    s = py_strip(c)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])


def detect_city(c, keywords=S.CITY_KEYWORDS) -> Column:
    """first keyword (in list order) contained in the lower-cased name."""
    low = F.lower(col_or_lit(c).cast("string"))
    out = None
    for key, city in keywords:
        out = (F.when if out is None else out.when)(low.contains(key), city)
    return out


def nights_int(c) -> Column:
    """comma -> dot, truncate, at least 1; unparsable -> 1."""
    if c is None:
        return F.lit(1)
    txt = F.replace(col_or_lit(c).cast("string"), F.lit(","), F.lit("."))
    n = plain_number(txt).try_cast("int")
    return F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))


def checkout_date(checkin, nights) -> Column:
    """F21."""
    return F.date_add(col_or_lit(checkin).cast("date"), col_or_lit(nights))


def stay_nights(checkin, checkout) -> Column:
    """whole days between two ISO dates, at least 1; bad dates -> 1."""
    def d(x):
        x = col_or_lit(x)
        return F.try_to_date(x.cast("string"), "yyyy-MM-dd")
    return F.greatest(F.coalesce(F.datediff(d(checkout), d(checkin)), F.lit(1)), F.lit(1))
