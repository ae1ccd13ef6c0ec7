"""Column binding, cleaning and enrichment of bookings (P1-P3, P9, P10,
F2, F17, F18, W1, A13, A14)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayspark import functions as SF
from stayspark import schema as S
from stayspark.functions.text import plain_number
from stayspark.operators.quantiles import as_scalar, attach, column_quantiles, exact_quantiles

DATE_COLUMNS = ["arrival", "departure", "created"]


# -- P1 / P2 / P3 ------------------------------------------------------------

def find_col(columns: Sequence[str], candidates: Sequence[str],
             case_insensitive: bool = True) -> str | None:
    """The column with the best rank: place of its candidate first, then
    an exact name before one that differs in case, then the last such column."""
    place = {c: i for i, c in reversed(list(enumerate(candidates)))}
    folded = {c.lower(): i for i, c in reversed(list(enumerate(candidates)))}
    ranks = [(place[c], 0, -i, c) for i, c in enumerate(columns) if c in place]
    if case_insensitive:
        ranks += [(folded[c.lower()], 1, -i, c) for i, c in enumerate(columns) if c.lower() in folded]
    return min(ranks)[-1] if ranks else None


def map_columns(df_or_cols, aliases: Mapping[str, Sequence[str]] = S.BOOKING_ALIASES
                ) -> dict[str, str | None]:
    """Logical name -> physical column (or None). Metadata only."""
    names = getattr(df_or_cols, "columns", df_or_cols)
    return {logical: find_col(list(names), known) for logical, known in aliases.items()}


def mapping_report(df: DataFrame) -> DataFrame:
    """P2 as a small table (logical, physical, found)."""
    rows = [(k, v, v is not None) for k, v in map_columns(df).items()]
    schema = "logical string, physical string, found boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def rename_canonical(df: DataFrame, mapping: Mapping[str, str | None] | None = None) -> DataFrame:
    """One projection renaming physical columns to logical names.

    A column that already carries a logical name taken by another physical
    column is dropped (it would otherwise become a duplicate name).
    """
    mapping = map_columns(df) if mapping is None else mapping
    target = {phys: logical for logical, phys in mapping.items() if phys}
    taken = set(target.values())
    # renamed by position (toDF), so names that differ only in case (Name /
    # NAME) never make a reference ambiguous
    names, dropped = [], []
    for i, c in enumerate(df.columns):
        if c in target:
            names.append(target[c])
        elif c in taken:
            names.append(f"__shadowed_{i}")
            dropped.append(f"__shadowed_{i}")
        else:
            names.append(c)
    out = df.toDF(*names)
    return out.drop(*dropped) if dropped else out


# -- F2: column-level date format election -----------------------------------

def elect_date_formats(df: DataFrame, cols: Sequence[str],
                       formats: Sequence[str] = S.DATE_FORMATS) -> dict[str, int]:
    """For each column the index of the first format that parses more than
    half of *all* rows, else -1.

    One aggregation pass (partial counts per task; 1 + cols x formats
    numbers reach the driver). Callers curate the cleaned table once, so
    the pass runs once per input.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        for i, f in enumerate(formats):
            aggs.append(F.count_if(SF.parse_timestamp(c, f).isNotNull()).alias(f"{c}__{i}"))
    row = df.agg(*aggs).first()
    n = row["n"]
    return {c: next((i for i in range(len(formats)) if row[f"{c}__{i}"] * 2 > n), -1) for c in cols}


def date_shapes(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """F2 where no format wins: the date shapes of each column, by one
    aggregate over the shapes of all rows. Only shapes that the date grammar
    knows come back, so the list doesn't grow with the data."""
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), SF.date_shape(SF.py_strip(c)).alias("shape")) for i, c in enumerate(cols)]))
    found = df.select(pairs.alias("x")).select("x.*").where(SF.is_date_shape(F.col("shape"))).distinct().collect()
    return {c: sorted(r.shape for r in found if r.i == i) for i, c in enumerate(cols)}


def parse_elected(c: str, elected: int, formats: Sequence[str] = S.DATE_FORMATS, shapes: Sequence[str] = ()) -> Column:
    """The column by its elected format, or row by row by its shapes."""
    return SF.parse_timestamp(c, formats[elected]) if elected >= 0 else SF.parse_shapes(c, shapes)


def parse_dates(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """election, then shapes for the columns that elect no format."""
    elected = elect_date_formats(df, cols)
    shapes = date_shapes(df, [c for c in cols if elected[c] < 0])
    return {c: parse_elected(c, elected[c], shapes=shapes.get(c, ())) for c in cols}


# -- P10 ---------------------------------------------------------------------

def clean_and_enrich(df: DataFrame, date_formats: Mapping[str, str] | None = None,
                     outlier_factor: float = 3.0, approx_quantiles: bool = False,
                     outlier_flag: bool = True) -> DataFrame:
    """P10: rename -> amount -> dates -> nights -> status -> channel -> ppn ->
    calendar -> flags. The output columns depend on the input columns.

    ``date_formats`` pins a format per date column and skips the election
    pass (useful when the layout is known).
    """
    df = rename_canonical(df)
    cols = set(df.columns)
    if "amount" in cols:
        df = df.withColumn("amount", SF.clean_money("amount"))
    present_dates = [c for c in DATE_COLUMNS if c in cols]
    if present_dates:
        given = {c: SF.parse_timestamp(c, date_formats[c]) for c in present_dates if c in (date_formats or {})}
        others = [c for c in present_dates if c not in given]
        df = df.withColumns({**given, **(parse_dates(df, others) if others else {})})
    has_span = "arrival" in cols and "departure" in cols
    if "nights" in cols:
        df = df.withColumn("nights", SF.nights_filled(
            "nights", F.col("arrival") if has_span else None,
            F.col("departure") if has_span else None))
    elif has_span:
        df = df.withColumn("nights", SF.nights_filled(None, F.col("arrival"), F.col("departure")))
    cols = set(df.columns)
    new: dict[str, Column] = {}
    if "status" in cols:
        new["status_group"] = SF.classify_status("status")
    new["channel"] = SF.normalize_channel("source") if "source" in cols else F.lit(S.CHANNEL_UNKNOWN)
    if "amount" in cols and "nights" in cols:
        new["price_per_night"] = SF.price_per_night("amount", "nights")
    if "arrival" in cols:
        a = F.col("arrival")
        new.update({
            "month": F.month(a), "month_name": SF.month_name(a), "month_short": SF.month_short(a),
            "year": F.year(a), "quarter": SF.quarter_label(a), "season": SF.season(a),
            "dow": SF.dow_es(a), "week_num": SF.iso_week(a), "is_weekend": SF.is_weekend(a),
            "is_holiday": SF.is_holiday(a), "year_month": SF.year_month(a),
        })
    df = df.withColumns(new)
    # _is_outlier is never NULL, so it is left out of the null check; this
    # also keeps the quantile subquery out of _has_nulls (pruned when unused)
    df = df.withColumn("_has_nulls", SF.any_null(df.columns))
    if not outlier_flag:
        return df
    return add_outlier_flag(df, outlier_factor, approx_quantiles)


def add_outlier_flag(df: DataFrame, outlier_factor: float = 3.0, approx_quantiles: bool = False) -> DataFrame:
    """``_is_outlier`` on ``amount`` (k x IQR over all rows), placed
    before ``_has_nulls``. A scalar subquery: queries that do not read the
    column never compute the quantiles."""
    if "amount" in df.columns:
        b = as_scalar(iqr_bounds(df, "amount", outlier_factor, approx_quantiles))
        x = F.col("amount")
        flag = F.coalesce((x < b["lo"]) | (x > b["hi"]), F.lit(False))
    else:
        flag = F.lit(False)
    df = df.withColumn("_is_outlier", flag)
    return df.select(*[c for c in df.columns if c not in ("_is_outlier", "_has_nulls")], "_is_outlier",
                     *[c for c in ("_has_nulls",) if c in df.columns])


def iqr_bounds(df: DataFrame, col: str, factor: float = 1.5, approx: bool = False) -> DataFrame:
    """One row: ``lo = Q1 - k*IQR`` and ``hi = Q3 + k*IQR`` of the column."""
    if approx:
        q = df.agg(F.percentile_approx(F.col(col).cast("double"), [0.25, 0.75], 10000).alias("a")
                   ).select(F.col("a")[0].alias("q1"), F.col("a")[1].alias("q3"))
    else:
        q = exact_quantiles(df, col, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select((F.col("q1") - factor * iqr).alias("lo"), (F.col("q3") + factor * iqr).alias("hi"))


def with_iqr_flag(df: DataFrame, col: str, out: str, factor: float = 1.5,
                  approx: bool = False) -> DataFrame:
    """``x < Q1 - k*IQR or x > Q3 + k*IQR`` with whole-column
    quantiles (one scalar subquery, referenced twice); NULL never flagged."""
    df = attach(df, "_q", iqr_bounds(df, col, factor, approx))
    x = F.col(col)
    flag = F.coalesce((x < F.col("_q.lo")) | (x > F.col("_q.hi")), F.lit(False))
    return df.withColumn(out, flag).drop("_q")


def with_zscore_flag(df: DataFrame, col: str, out: str, threshold: float = 3.0) -> DataFrame:
    """|x - mean| / population std > threshold; NULL and constant
    columns never flagged."""
    df = attach(df, "_z", df.agg(F.avg(col).alias("mu"), F.stddev_pop(col).alias("sd")))
    z = F.abs(F.try_divide(F.col(col) - F.col("_z.mu"), F.col("_z.sd")))
    return df.withColumn(out, F.coalesce(z > threshold, F.lit(False))).drop("_z")


# -- W1 ----------------------------------------------------------------------

def filter_confirmed_paid(df: DataFrame) -> DataFrame:
    """Confirmed with revenue; missing columns -> empty result."""
    if "status_group" not in df.columns or "amount" not in df.columns:
        return df.where(F.lit(False))
    return df.where(SF.confirmed_paid())


# -- P9 ----------------------------------------------------------------------

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def impute_missing(df: DataFrame, strategy: str = "mean") -> DataFrame:
    """Fill NULLs of every numeric column with its mean / median / 0.

    Medians of all columns come from one exact distributed quantile pass.
    """
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    if not num or strategy not in ("mean", "median", "zero"):
        return df
    base = df
    if strategy == "zero":
        fills = {c: F.lit(0) for c in num}
    elif strategy == "mean":
        df = attach(df, "_fill", base.agg(*[F.avg(c).alias(c) for c in num]))
        fills = {c: F.col("_fill")[c] for c in num}
    else:
        df = attach(df, "_fill", column_quantiles(base, num, 0.5))
        fills = {c: F.col("_fill")[c] for c in num}
    out = {}
    for c in num:
        dt = df.schema[c].dataType
        # integer columns become double when a fractional fill is possible
        target = dt if strategy == "zero" or isinstance(dt, (T.FloatType, T.DoubleType)) else T.DoubleType()
        out[c] = F.coalesce(F.col(c).cast(target), fills[c].cast(target))
    return df.withColumns(out).select(*base.columns)


# -- A13 / A14 ---------------------------------------------------------------

def quality_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One-row data quality summary (absent columns -> 0 / NULL)."""
    cols = set(clean.columns)

    def count_if_present(col, cond):
        return F.count_if(cond) if col in cols else F.lit(0).cast("bigint")

    aggs = [
        count_if_present("status_group", F.col("status_group") == "Confirmada").alias("confirmed"),
        count_if_present("amount", F.col("amount") > 0).alias("with_revenue"),
        count_if_present("guest", F.col("guest").isNull()).alias("null_guest"),
        count_if_present("source", F.col("source").isNull()).alias("null_source"),
        count_if_present("arrival", F.col("arrival").isNull()).alias("null_dates"),
        (F.min("arrival") if "arrival" in cols else F.lit(None).cast("timestamp")).alias("date_range_min"),
        (F.max("arrival") if "arrival" in cols else F.lit(None).cast("timestamp")).alias("date_range_max"),
        (F.count_distinct("property") if "property" in cols else F.lit(0).cast("bigint")).alias("properties"),
        (F.count_distinct("channel") if "channel" in cols else F.lit(0).cast("bigint")).alias("channels"),
    ]
    total = raw.agg(F.count(F.lit(1))).scalar()
    return clean.agg(*aggs).select(total.alias("total_rows"), "*")


def unconfirmed_statuses(clean: DataFrame) -> DataFrame:
    """Distinct raw statuses when nothing is confirmed although rows
    exist; empty otherwise."""
    if "status" not in clean.columns:
        return clean.sparkSession.createDataFrame([], "status string")
    gate = attach(clean, "_g", clean.agg(F.count(F.lit(1)).alias("n"),
                                         F.count_if(F.col("status_group") == "Confirmada").alias("c")))
    return (gate.where((F.col("_g.n") > 0) & (F.col("_g.c") == 0))
            .select(F.col("status").cast("string").alias("status")).distinct())


def amount_sample(clean: DataFrame, n: int = 5) -> DataFrame:
    """A few processed amounts (amount, nights, price_per_night) to eyeball."""
    cols = [c for c in ("amount", "nights", "price_per_night") if c in clean.columns]
    return clean.select(*cols).limit(n)


def raw_mode_frame(df: DataFrame) -> DataFrame:
    """A file analysed without cleaning, under the names that the
    operators take: property, amount, price_per_night and nights (NULL where
    the file has none), as numbers; other columns are dropped."""
    c = raw_mode_columns(df)

    def number(name: str | None) -> Column:
        if name is None:
            return F.lit(None).cast("double")
        return F.col(name).cast("double") if isinstance(df.schema[name].dataType, _NUMERIC) else plain_number(name)

    return df.select(F.col(c["property"]).cast("string").alias("property"), number(c["amount"]).alias("amount"),
                     number(c["price"]).alias("price_per_night"), number(c["nights"]).alias("nights"))


def raw_mode_columns(df_or_cols) -> dict[str, str | None]:
    """Columns used when the file is analysed without cleaning: property
    (mandatory), amount, nightly price (falls back to amount), nights."""
    cols = df_or_cols.columns if isinstance(df_or_cols, DataFrame) else list(df_or_cols)
    prop = next((c for c in ["property", "R_PROPERTY_NAME"] if c in cols), None)
    if not prop:
        raise ValueError(f"No property column. Available: {cols}")
    amount = "amount" if "amount" in cols else "R_TOTAL_AMOUNT"
    return {"property": prop, "amount": amount,
            "price": "price_per_night" if "price_per_night" in cols else amount,
            "nights": "nights" if "nights" in cols else None}
