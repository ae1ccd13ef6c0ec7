"""Market search planner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayspark import functions as SF
from stayspark import schema as S


def planner_columns(df: DataFrame) -> dict[str, str | None]:
    """P5: exact-name detection; property and date are mandatory."""
    found = {k: next((c for c in v if c in df.columns), None) for k, v in S.PLANNER_ALIASES.items()}
    if not found["property"]:
        raise ValueError(f"No property column. Available: {df.columns}")
    if not found["date"]:
        raise ValueError(f"No date column. Available: {df.columns}")
    return found


def search_inputs(raw: DataFrame, keywords: Sequence[tuple[str, str]] = S.CITY_KEYWORDS) -> DataFrame:
    """Confirmed bookings with a mapped city, parsed check-in, nights
    and check-out; rows without city or date are dropped."""
    c = planner_columns(raw)
    d = raw
    if c["status"]:
        d = d.where(F.col(c["status"]).isin(S.PLANNER_VALID_STATUS))
    prop = SF.py_strip(F.col(c["property"]).cast("string"))
    d = d.select(prop.alias("propiedad"), SF.detect_city(prop, keywords).alias("ciudad"),
                 F.to_date(SF.planner_date(F.col(c["date"]))).alias("checkin"),
                 SF.nights_int(F.col(c["nights"]) if c["nights"] else None).alias("noches"))
    d = d.where(F.col("ciudad").isNotNull() & F.col("checkin").isNotNull())
    return d.select("propiedad", "ciudad", "checkin", SF.checkout_date("checkin", "noches").alias("checkout"),
                    "noches")


def search_plan(inputs: DataFrame, as_of, per_property: int = 3) -> DataFrame:
    """Up to ``per_property`` searches per property.

    With future stays (check-in >= ``as_of``): the earliest distinct
    check-ins. Otherwise the latest ``per_property`` stays, then distinct.
    Rows sharing a check-in are represented by the one with the earliest
    check-out. Work is done on (property, check-in) aggregates, so the
    windows only see distinct dates, never raw booking rows.
    """
    as_of = F.lit(as_of).cast("date") if not hasattr(as_of, "alias") else as_of
    per_day = inputs.groupBy("propiedad", "checkin").agg(
        F.min_by(F.struct("checkout", "ciudad"), F.struct("checkout", "ciudad")).alias("r"),
        F.count(F.lit(1)).alias("n"))
    per_day = per_day.withColumn("future", F.col("checkin") >= as_of)
    wp = Window.partitionBy("propiedad")
    per_day = per_day.withColumn("has_future", F.max(F.col("future").cast("int")).over(wp) == 1)
    # one ranking serves both branches: future dates from the earliest, and
    # the rows (not dates) that come after a past date
    k = F.row_number().over(Window.partitionBy("propiedad", "future").orderBy("checkin"))
    later = Window.partitionBy("propiedad").orderBy(F.desc("checkin")).rowsBetween(Window.unboundedPreceding, -1)
    per_day = per_day.withColumn("_k", k).withColumn("_before", F.coalesce(F.sum("n").over(later), F.lit(0)))
    keep = F.when(F.col("has_future"), F.col("future") & (F.col("_k") <= per_property)).otherwise(F.col("_before") < per_property)
    return per_day.where(keep).select(F.col("r.ciudad").alias("ciudad"), "checkin", F.col("r.checkout").alias("checkout"),
                                      F.col("propiedad").alias("propiedad_referencia"))


#: Most keywords that are broadcast; a longer table is joined by shuffle.
BROADCAST_KEYWORDS = 100_000


def city_keywords_table(spark, keywords: Sequence[tuple[str, str]] = S.CITY_KEYWORDS) -> DataFrame:
    """J3 table form of the keyword map (priority = list position)."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(keywords)],
                                 "prio int, keyword string, ciudad string")


def detect_city_join(props: DataFrame, keywords: DataFrame, col: str = "propiedad") -> DataFrame:
    """Containment join of distinct names with a keyword table of any
    size, (name, ciudad); the lowest priority wins, names without a keyword
    have no row.

    A substring index in place of a comparison of all pairs: each distinct
    name is exploded to its different substrings of the lengths that keywords
    have, and those meet the keywords by equality. A name of L characters
    gives at most L substrings for each of those lengths (a list of small
    numbers, no longer than the longest keyword). The keywords go to the names
    when there are few of them, else both sides are shuffled by the text;
    a frequent substring is then a skewed key that AQE splits.
    """
    best = keywords.where(F.col("keyword").isNotNull()).groupBy("keyword").agg(F.min_by("ciudad", "prio").alias("ciudad"), F.min("prio").alias("prio"))
    lengths = sorted(r.n for r in best.select(F.length("keyword").alias("n")).distinct().collect())
    names = props.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_low", F.lower(F.col(col).cast("string")))

    def of_length(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        at = F.sequence(F.lit(1), F.greatest(F.length("_low") - (n - 1), F.lit(1)))
        return F.when(F.length("_low") >= n, F.transform(at, lambda i: F.substr(F.col("_low"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    if not lengths:
        return names.select(col, F.lit(None).cast("string").alias("ciudad")).where("false")
    parts = names.select(col, F.explode(F.array_distinct(F.flatten(F.array(*[of_length(n) for n in lengths])))).alias("keyword"))
    side = F.broadcast(best) if best.limit(BROADCAST_KEYWORDS + 1).count() <= BROADCAST_KEYWORDS else best
    return parts.join(side, "keyword").groupBy(col).agg(F.min_by("ciudad", "prio").alias("ciudad"))
