"""Small text helpers shared by the scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"
# Characters Python's str.strip()/str.split() treat as blanks, written out so
# that Java and RE2 regexes agree on them.
PY_WS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


#: The same characters as a plain text.
PY_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col_or_lit(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def bind(value: Column, body) -> Column:
    """``let``: ``body`` applied to a value that is computed once, however
    often the body uses it and wherever the optimizer copies the result."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def py_strip(c) -> Column:
    """Remove leading/trailing Unicode blanks (like Python ``str.strip``)."""
    return F.btrim(col_or_lit(c).cast("string"), F.lit(PY_BLANKS))


def plain_number(c) -> Column:
    """Text that is a plain decimal number (sign, digits, point, exponent) as
    a double; anything else is NULL. A bare cast would also take Java's type
    suffixes (``5d``) and the words for infinity."""
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return bind(py_strip(c), lambda s: F.when(s.rlike(number), s.try_cast("double")))


def py_split(c) -> Column:
    """Python ``str.split()``: split on runs of blanks, no empty parts."""
    return F.split(py_strip(c), f"{PY_WS}+")


def py_title(c) -> Column:
    """Python ``str.title``: a cased letter after a non-cased char is upper.

    ``initcap`` only capitalises after blanks; this walks the characters with
    higher-order functions, so it stays a JVM expression (no UDF).
    """
    chars = F.split(col_or_lit(c), "")
    return F.array_join(
        F.transform(
            chars,
            lambda ch, i: F.when(
                (i == 0) | ~F.element_at(chars, i).rlike(_CASED), F.upper(ch)
            ).otherwise(F.lower(ch)),
        ),
        "",
    )
