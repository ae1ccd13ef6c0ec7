"""Dates of unknown layout (F2): layouts are inferred from value shapes.

A value's shape has its digits as ``9`` and each run of letters as ``a``
(``3 Oct 2024 10:30`` -> ``9 a 9999 99:99``). A column has few date shapes
however many rows it has; each is resolved once, by the grammar below, to the
layouts it can stand for (day first where both readings are possible, month
first for the values that no day-first reading fits). A row is then parsed by
the layouts of its own shape only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayspark.functions.text import bind, py_strip

__all__ = ["date_shape", "is_date_shape", "shape_layouts", "parse_shapes"]

_SEP = r"[/.\- ]"
_DAY = rf"(?:9{{1,2}}{_SEP}9{{1,2}}{_SEP}(?:9999|99)|9999{_SEP}9{{1,2}}{_SEP}9{{1,2}}|9{{8}}|9{{1,2}}{_SEP}a\.?{_SEP}9999|a\.? 9{{1,2}},? 9999)"
_TIME = r"9{1,2}:99(?::99(?:[.,]9{1,9})?)?"
_ZONE = r"(?: ?[+\-]99:?99| ?a)"
#: Shapes of dates, with an optional weekday before and a time after them.
DATE_SHAPE = rf"(a,? )?({_DAY})(?:([ a]|, )({_TIME})({_ZONE})?)?"


def date_shape(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "0123456789", "9" * 10), r"\p{L}+", "a")


def is_date_shape(shape: Column) -> Column:
    return F.regexp_like(shape, F.lit(f"^{DATE_SHAPE}$"))


def _day_layouts(day: str) -> list[str]:
    parts = re.split(f"({_SEP})", day) if "a" not in day else None
    if day == "9" * 8:
        return ["yyyyMMdd"]
    if parts and len(parts) == 5:
        a, s, b, t, c = parts
        if len(a) == 4:
            return [f"yyyy{s}M{t}d", f"yyyy{s}d{t}M"]
        y = "yyyy" if len(c) == 4 else "yy"
        return [f"d{s}M{t}{y}", f"M{s}d{t}{y}"]
    if day.startswith("a"):
        dot, comma = "." if day[1] == "." else "", "," if "," in day else ""
        return [f"{m}{dot} d{comma} yyyy" for m in ("MMM", "MMMM")]
    m = re.fullmatch(rf"9+({_SEP})a(\.?)({_SEP})9999", day)
    return [f"d{m[1]}{name}{m[2]}{m[3]}yyyy" for name in ("MMM", "MMMM")] if m else []


def shape_layouts(shape: str) -> list[str]:
    """Layouts of a date shape, the preferred reading first; none for others.
    A weekday before the date isn't part of the layout."""
    m = re.fullmatch(DATE_SHAPE, shape)
    if not m:
        return []
    _, day, gap, time, zone = m.groups()
    days = _day_layouts(day)
    if not time:
        return days
    clock = "H:m" + (":s" if time.count(":") == 2 else "")
    if f := re.search(r"([.,])(9+)$", time):
        clock += f[1] + "S" * len(f[2])
    ends = [""]
    if zone:
        space = " " if zone.startswith(" ") else ""
        ends = [space + ("XXX" if ":" in zone else "XX")] if zone.strip() != "a" else [space + "a"] if space else ["XXX", "a"]
    gap = "'T'" if gap == "a" else gap
    # a 12-hour clock where half of the day is named
    return [d + gap + (clock.replace("H", "h") if e.strip() == "a" else clock) + e for d in days for e in ends]


def _in_century(ts: Column, layout: str) -> Column:
    """Two-digit years from 69 on are of the last century."""
    if re.search(r"(?<!y)yy(?!y)", layout) is None:
        return ts
    return bind(ts, lambda t: F.when(F.year(t) >= 2069, t - F.expr("INTERVAL 100 YEARS")).otherwise(t))


def parse_shapes(c, shapes: Sequence[str]) -> Column:
    """Timestamp of a text by the layouts of its shape; NULL for other shapes
    and for values that none of them fits."""
    by_layouts: dict[tuple, list[str]] = {}
    for s in sorted(set(shapes)):
        if layouts := shape_layouts(s):
            weekday = re.fullmatch(DATE_SHAPE, s)[1] is not None
            by_layouts.setdefault((weekday, *layouts), []).append(s)

    def parsed(text: Column) -> Column:
        def of_shape(shape: Column) -> Column:
            out = None
            for (weekday, *layouts), mine in by_layouts.items():
                x = F.regexp_replace(text, r"^\p{L}+,? ", "") if weekday else text
                value = F.coalesce(*[_in_century(F.try_to_timestamp(x, F.lit(f)), f) for f in layouts])
                out = (F.when if out is None else out.when)(shape.isin(mine), value)
            return out
        return bind(date_shape(text), of_shape)

    if not by_layouts:
        return F.lit(None).cast("timestamp")
    return bind(py_strip(c), parsed)
