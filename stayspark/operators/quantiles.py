"""Exact, distributed quantiles (linear interpolation, as pandas/numpy).

Spark's ``percentile`` keeps every distinct value of a group in one buffer,
so a global percentile over row-level data funnels the whole column into a
single task. Here values are found by radix selection:

1. the columns are written once as order-preserving 64-bit keys of their
   doubles (a narrow table, nothing else of the rows);
2. a pass counts the keys by their first 16 bits, all columns together, and
   finds the bin of every wanted rank;
3. further passes count, by the next 16 bits, only the keys that share a
   wanted bin's bits, until a bin holds one value (four passes at most;
   bins carry their least and greatest key, so it mostly takes two or three).

A pass shuffles counts, at most 65,536 for each wanted bin, never values;
hot values collapse in the map-side count; two rows for each quantile
reach the driver. The result is a row of literals, so the plan that uses it
reads its input once more and no quantile is computed twice.

Use it for row-level quantiles; small bounded groups (<= 12 months, per
property months) can use ``F.percentile`` directly.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayspark.session import drop_written, written

#: Bits of a radix pass.
DIGIT = 16


def bucket_count(spark: SparkSession) -> int:
    """Buckets to balance a rank computation over: the shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def order_key(x: Column) -> Column:
    """A long that orders like the double ``x``: its bits, with those below
    the sign turned over for negative numbers; NULL for NULL and NaN. Both
    zeros have one key."""
    x = x.cast("double")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + 0.0).cast("bigint")
    key = bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit(2 ** 63 - 1)))
    return F.when(x.isNotNull() & ~F.isnan(x), key)


def key_value(key: int) -> float:
    """The double of an order key."""
    bits = key if key >= 0 else key ^ (2 ** 63 - 1)
    return struct.unpack(">d", struct.pack(">q", bits))[0]


class _Wanted:
    """A rank that is looked for: its column, the bits known so far (a bin's
    keys without their last ``left`` bits) and its place within that bin."""

    def __init__(self, col: int, rank: int):
        self.col, self.rank, self.prefix, self.key = col, rank, None, None


def _pass(keys: DataFrame, left: int, wanted: Sequence[_Wanted] | None, probs: Sequence[float]) -> list:
    """Bins of the next digit that hold a wanted rank: (col, prefix, bin, n of
    the prefix, keys before the bin, keys in it, least and greatest key)."""
    x = keys
    if wanted is None:
        slot = F.lit(0).cast("bigint")
    else:
        slot = F.shiftright("key", left + DIGIT)
        among = F.lit(False)
        for col in {w.col for w in wanted}:
            among = among | ((F.col("col") == col) & slot.isin(sorted({w.prefix for w in wanted if w.col == col})))
        x = x.where(among)
    bins = x.groupBy("col", slot.alias("prefix"), F.shiftright("key", left).alias("bin")).agg(
        F.count(F.lit(1)).alias("c"), F.min("key").alias("least"), F.max("key").alias("most"))
    # At most 2**DIGIT bins of a column and prefix.
    of = Window.partitionBy("col", "prefix")
    before = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns({"n": F.sum("c").over(of), "before": F.coalesce(F.sum("c").over(before), F.lit(0))})
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))
    hit = F.lit(False)
    if wanted is None:
        for p in probs:
            h = (F.col("n") - 1) * F.lit(float(p))
            hit = hit | holds(F.floor(h)) | holds(F.ceil(h))
    else:
        for w in wanted:
            hit = hit | ((F.col("col") == w.col) & (F.col("prefix") == w.prefix) & holds(F.lit(w.rank)))
    return bins.where(hit).collect()


def _selected(df: DataFrame, cols: Sequence[Column], probs: Sequence[float]) -> list[tuple[int, list[tuple[float, float, float]]]]:
    """For each column: its count of values, and for each of ``probs`` (the
    place between its two neighbouring ranks, their values)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), order_key(c).alias("key")) for i, c in enumerate(cols)]))
    keys = written(df.select(pairs.alias("x")).select("x.col", "x.key").where(F.col("key").isNotNull()), "order_keys")
    left = 64 - DIGIT
    rows = _pass(keys, left, None, probs)
    n = {r.col: r.n for r in rows}
    ranks = {c: [(h - math.floor(h), math.floor(h), math.ceil(h)) for h in ((n[c] - 1) * float(p) for p in probs)] for c in n}
    wanted = {(c, r): _Wanted(c, r) for c in n for _, *pair in ranks[c] for r in pair}
    open_ = list(wanted.values())
    while open_:
        for w in open_:
            for r in rows:
                if r.col == w.col and (w.prefix is None or r.prefix == w.prefix) and r.before <= w.rank < r.before + r.c:
                    w.found = (r.bin, w.rank - r.before, r.least if r.least == r.most else None)
        for w in open_:
            w.prefix, w.rank, w.key = w.found
        open_ = [w for w in open_ if w.key is None]
        if open_:
            left -= DIGIT
            rows = _pass(keys, left, open_, probs)
    drop_written(df.sparkSession, keys)
    value = {at: key_value(w.key) for at, w in wanted.items()}
    return [(n.get(c, 0), [(t, value[c, a], value[c, b]) for t, a, b in ranks.get(c, [])]) for c in range(len(cols))]


def _lerp(t: float, a: float, b: float) -> float:
    """numpy's lerp: a + (b - a) * t, computed from the upper end when t >= 0.5."""
    return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t


def one_row(spark: SparkSession, values: Mapping[str, tuple[object, str]]) -> DataFrame:
    """A row of literals, by name: (value, type)."""
    return spark.range(1).select(*[F.lit(v).cast(t).alias(name) for name, (v, t) in values.items()])


def exact_quantiles(df: DataFrame, col: str | Column, probs: Mapping[str, float], neighbors: bool = False) -> DataFrame:
    """One-row DataFrame: ``n`` plus one column per entry of ``probs``
    (with ``neighbors``, also ``<name>_a`` / ``<name>_b``: the values at the
    two ranks the quantile interpolates between).

    NULL and NaN are ignored; with no values every quantile is NULL. Runs when
    called: a write of the keys and at most four counting passes.
    """
    c = col if isinstance(col, Column) else F.col(col)
    (n, found), = _selected(df, [c], list(probs.values()))
    out: dict[str, tuple[object, str]] = {"n": (n, "bigint")}
    for name, x in zip(probs, found or [None] * len(probs)):
        out[name] = (_lerp(*x) if x else None, "double")
        if neighbors:
            out |= {f"{name}_a": (x and x[1], "double"), f"{name}_b": (x and x[2], "double")}
    return one_row(df.sparkSession, out)


def column_quantiles(df: DataFrame, cols: Sequence[str], p: float) -> DataFrame:
    """One-row DataFrame with the quantile of every column (NULL where a
    column has no values), all from the same passes."""
    found = _selected(df, [F.col(c) for c in cols], [p])
    return one_row(df.sparkSession, {c: (_lerp(*x[0]) if x else None, "double") for c, (_, x) in zip(cols, found)})


def as_scalar(one_row: DataFrame) -> Column:
    """Struct-valued scalar subquery of a one-row DataFrame (fields by name)."""
    return one_row.select(F.struct(*one_row.columns).alias("s")).scalar()


def attach(df: DataFrame, name: str, one_row: DataFrame) -> DataFrame:
    """Add a one-row result to every row as the struct column ``name``.

    This is the broadcast of a scalar (J2): the one-row side is computed
    once and broadcast; every input row meets exactly one row, so nothing
    multiplies. Unlike a scalar subquery, the optimizer cannot copy the
    aggregate into each filter that uses it. A caller's frame is reduced to
    its one row by an aggregate that fails if there are more; without a row,
    the struct is NULL.
    """
    row = F.struct(*one_row.columns)
    more = F.raise_error(F.lit(f"{name}: more than one row")).cast(one_row.select(row.alias("r")).schema["r"].dataType)
    scalar = one_row.agg(F.when(F.count(F.lit(1)) > 1, more).otherwise(F.first(row)).alias(name))
    return df.crossJoin(F.broadcast(scalar))


def lerp_quantile(sorted_values: Column, p: float) -> Column:
    """numpy 'linear' quantile of a sorted array column (NULL if empty)."""
    n = F.size(sorted_values)
    h = (n - 1) * F.lit(float(p))
    lo, hi = F.floor(h), F.ceil(h)
    a = F.element_at(sorted_values, (lo + 1).cast("int"))
    b = F.element_at(sorted_values, (hi + 1).cast("int"))
    t = h - lo
    return F.when(n == 0, F.lit(None)).when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)


def small_quantile(col: str | Column, p: float, over=None) -> Column:
    """Aggregate (or, with ``over``, window) quantile for small, bounded
    groups such as the <= 12 months of a monthly summary: sorts the group's
    values in one buffer, so never use it on row-level groups."""
    c = col if isinstance(col, Column) else F.col(col)
    values = F.collect_list(c.cast("double"))
    if over is not None:
        values = values.over(over)
    return lerp_quantile(F.sort_array(values), p)
