"""Listing card extraction functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayspark import schema as S
from stayspark.functions.text import PY_WS, bind, col_or_lit, py_strip

__all__ = ["listing_price", "listing_price_digits", "listing_price_from", "rating_value", "review_count",
           "card_title", "card_title_name0", "card_title_generic", "card_title_from", "card_rating_match",
           "card_price_text", "card_price", "card_rating", "card_reviews", "lodging_type",
           "capacity", "absolute_url", "nonblank"]


def nonblank(c) -> Column:
    c = col_or_lit(c)
    return c.isNotNull() & (c != "")


def listing_price_digits(text) -> Column:
    """F23 step 1: the first run of 2-5 digits after removing ``.``/``,``."""
    cleaned = F.replace(F.translate(col_or_lit(text), ".,", ""), F.lit("\u00a0"), F.lit(" "))
    return F.nullif(F.regexp_extract(cleaned, r"(\d{2,5})", 1), F.lit("")).try_cast("int")


def listing_price_from(text, digits, nights) -> Column:
    """F23 step 2: total prices ('total' / 'estancia') are divided by the
    nights (floor, at least 1); no text or no digits -> NULL."""
    t, first, n = col_or_lit(text), col_or_lit(digits), col_or_lit(nights)
    low = F.lower(t)
    is_total = low.contains("total") | low.contains("estancia")
    per_night = F.when(is_total & (n > 1) & first.isNotNull(), F.greatest(F.lit(1), F.floor(first / n).cast("int")))
    return F.when(nonblank(t), F.coalesce(per_night, first))


def listing_price(text, nights) -> Column:
    """first 2-5 digit run; total prices are divided by the nights."""
    return listing_price_from(text, listing_price_digits(text), nights)


def rating_value(text) -> Column:
    """'4,85 (203)' -> 4.85."""
    t = col_or_lit(text)
    pat = r"(\d+)[,.](\d+)"
    return F.when(t.rlike(pat), F.concat(F.regexp_extract(t, pat, 1), F.lit("."),
                                         F.regexp_extract(t, pat, 2)).try_cast("double"))


def review_count(text) -> Column:
    """the last integer in the text."""
    return F.try_element_at(F.regexp_extract_all(col_or_lit(text), F.lit(r"(\d+)"), 1),
                            F.lit(-1)).try_cast("int")


def _any_contains(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def card_title_name0(title_raw) -> Column:
    """First line of the selector title, or the placeholder when missing."""
    tr = col_or_lit(title_raw)
    return F.when(nonblank(tr), F.split(py_strip(tr), "\n").getItem(0)).otherwise(S.NO_TITLE)


def _line_regex(min_len: int, exclude: list[str]) -> str:
    """Multi-line regex whose group 1 is a stripped line of at least
    ``min_len`` characters containing none of ``exclude`` (any case). Only
    ``\\n`` ends a line, as ``str.split('\\n')``."""
    nws = "[^" + PY_WS[1:]
    words = "|".join(re.escape(w) for w in exclude)
    guard = f"(?![^\\n]*?(?:{words}))" if exclude else ""
    body = f"{nws}[^\\n]{{{max(min_len - 2, 0)},}}{nws}" if min_len >= 2 else f"{nws}(?:[^\\n]*{nws})?"
    return f"(?imdu)^{PY_WS}*{guard}({body})"


def card_title_generic(name0) -> Column:
    return bind(F.lower(col_or_lit(name0)), lambda low: _any_contains(low, S.GENERIC_TITLE_WORDS))


def card_title_from(title_raw, text, name0, generic0) -> Column:
    """F26 given the first title line and whether it is generic."""
    tr, tx, n0 = col_or_lit(title_raw), col_or_lit(text), col_or_lit(name0)
    good = F.regexp_extract(tx, _line_regex(9, S.CARD_NOISE_WORDS + S.GENERIC_TITLE_WORDS), 1)
    longs = F.filter(F.regexp_extract_all(tx, F.lit(_line_regex(16, S.CARD_NOISE_WORDS)), 1),
                     lambda c: c != n0)
    # each walk of the text is bound: in a branch, an expression that is used twice is computed twice
    longest = bind(longs, lambda ls: bind(F.array_max(F.transform(ls, F.length)), lambda top: F.when(
        top > F.length(n0), F.get(F.filter(ls, lambda c: F.length(c) == top), F.lit(0)))))
    picked = bind(good, lambda g: F.when(g != "", g).otherwise(F.coalesce(longest, n0)))
    return F.when((~nonblank(tr) | col_or_lit(generic0)) & nonblank(tx), picked).otherwise(n0)


def card_title(title_raw, text) -> Column:
    """keep the first title line unless it is missing or generic; then
    take the first card-text line (stripped, > 5 chars, no noise word) that is
    not generic and longer than 8; failing that, the first of the longest
    such lines longer than 15 that differ from the title, if longer than it.

    (The original walks the lines keeping a running "longest so far", which
    ends on the first line of maximum length; the regexes find the same
    lines in one pass each, without per-line lambdas.) In a wide projection
    prefer computing ``card_title_name0`` / ``card_title_generic`` first and
    calling :func:`card_title_from`, so they are evaluated once per row.
    """
    name0 = card_title_name0(title_raw)
    return card_title_from(title_raw, text, name0, card_title_generic(name0))


def card_price_text(price_raw, text) -> Column:
    """selector price text, else '<digits> €' found in the card text."""
    pr, tx = col_or_lit(price_raw), col_or_lit(text)
    found = F.regexp_extract(tx, r"(?U)(\d[\d.\s,]*)\s*€", 0)
    return F.nullif(F.when(nonblank(pr), pr).when(nonblank(tx), found), F.lit(""))


def card_price(price_raw, text, nights) -> Column:
    """F23 on F27: the nightly price of a card, its texts read once."""
    raw, tx = col_or_lit(price_raw), col_or_lit(text)
    price = lambda t: bind(listing_price_digits(t), lambda d: listing_price_from(t, d, nights))
    return bind(raw, lambda r: bind(card_price_text(r, tx), price))


_RATING_FULL = r"(\d)[,.](\d{2})\s*\((\d+)\)"
_RATING_ONLY = r"(\d)[,.](\d{2})\s*(?:sobre|out)"


def card_rating_match(text) -> Column:
    """The 'd,dd (n)' match, else the 'd,dd sobre|out' match, else ''."""
    t = col_or_lit(text)
    only = F.regexp_extract(t, _RATING_ONLY, 0)
    return bind(F.regexp_extract(t, _RATING_FULL, 0), lambda full: F.when(full != "", full).otherwise(only))


def card_rating(text, match=None) -> Column:
    """rating from 'd,dd (n)' or 'd,dd sobre|out'; groups are read from
    the (short) match."""
    m = col_or_lit(match) if match is not None else card_rating_match(text)
    return F.when(m != "", F.concat(F.regexp_extract(m, r"(\d)[,.](\d{2})", 1), F.lit("."),
                                    F.regexp_extract(m, r"(\d)[,.](\d{2})", 2)).try_cast("double"))


def card_reviews(text, match=None) -> Column:
    """review count, only from the 'd,dd (n)' form."""
    m = col_or_lit(match) if match is not None else card_rating_match(text)
    return F.when(m.rlike(r"\)$"), F.regexp_extract(m, r"\((\d+)\)", 1).try_cast("int"))


def lodging_type(text) -> Column:
    """first keyword found (case-insensitive), else 'Desconocido'."""
    def first(low: Column) -> Column:
        out = None
        for k in S.LODGING_TYPES:
            out = (F.when if out is None else out.when)(low.contains(k.lower()), k)
        return out.otherwise(S.UNKNOWN_TYPE)
    return bind(F.lower(F.coalesce(col_or_lit(text), F.lit(""))), first)


def capacity(text) -> Column:
    """'n huéspedes' / 'n guests'."""
    return F.nullif(F.regexp_extract(col_or_lit(text), r"(?iU)(\d+)\s*(?:huésped|huesped|guest)", 1),
                    F.lit("")).try_cast("int")


def absolute_url(href, root: str = S.LISTING_SITE_ROOT) -> Column:
    """keep absolute links, prefix relative ones; missing -> ''."""
    h = col_or_lit(href)
    return (F.when(~nonblank(h), F.lit(""))
            .when(h.startswith("http"), h)
            .otherwise(F.concat(F.lit(root), h)))
