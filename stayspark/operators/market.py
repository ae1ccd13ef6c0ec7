"""Market listings: card extraction, upsert, KPIs (X1-X3, K1, N8, A30-A32,
W7, W8, W10, F36, F37, P7)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayspark import functions as SF
from stayspark import schema as S
from stayspark.functions.text import bind, plain_number
from stayspark.operators.quantiles import attach, bucket_count, exact_quantiles
from stayspark.session import drop_written, written


# -- X1-X3 -------------------------------------------------------------------

def _stay(cards: DataFrame) -> Column:
    """F22 on the cards' dates; those that are dates already aren't parsed."""
    if all(isinstance(cards.schema[c].dataType, T.DateType) for c in ("checkin", "checkout")):
        return F.greatest(F.coalesce(F.datediff("checkout", "checkin"), F.lit(1)), F.lit(1))
    return SF.stay_nights("checkin", "checkout")


def extract_cards(cards: DataFrame, site_root: str = S.LISTING_SITE_ROOT,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Captured cards -> listing rows; cards without a usable price
    (missing, fewer than two digits, or 0) are dropped (W10).

    Input columns: title_raw, price_raw, text, href, checkin, checkout,
    ciudad, propiedad_referencia, scraped_on (dates may be ISO strings).
    """
    # cards without a usable price leave before any other rule runs; they leave
    # by an exploded list, as a filter would be pushed below the projections
    # with a copy of the whole price for each of its conditions; per-row
    # intermediates get their own projection
    s1 = cards.select("*", SF.card_price_text("price_raw", "text").alias("_priced"), _stay(cards).alias("_nights"))
    s1 = s1.select("*", SF.listing_price_digits("_priced").alias("_digits"))
    s1 = s1.select("*", SF.listing_price_from("_priced", "_digits", "_nights").alias("_nightly"))
    s1 = s1.select("*", F.explode(F.when(F.col("_nightly") != 0, F.array("_nightly"))).alias("_price"))
    s2 = s1.select("*", SF.card_title_name0("title_raw").alias("_name0"), SF.card_rating_match("text").alias("_rmatch"))
    s2 = s2.select("*", SF.card_title_generic("_name0").alias("_generic0"))
    return s2.select(
        *keep,
        SF.card_title_from("title_raw", "text", "_name0", "_generic0").alias("nombre"),
        F.col("_price").alias("precio_noche"),
        SF.card_rating("text", "_rmatch").alias("rating"),
        SF.card_reviews("text", "_rmatch").alias("num_reviews"),
        SF.lodging_type("text").alias("tipo"),
        SF.capacity("text").alias("capacidad"),
        SF.absolute_url("href", site_root).alias("url"),
        F.col("scraped_on").cast("date").alias("fecha_scraping"),
        F.col("checkin").cast("date").alias("checkin"),
        F.col("checkout").cast("date").alias("checkout"),
        F.col("ciudad").cast("string").alias("ciudad"),
        F.col("propiedad_referencia").cast("string").alias("propiedad_referencia"),
    )


#: A comment, a script or style with its text, a tag, or the text between two tags.
_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|[^<]+|<"
#: Elements without an end tag of their own.
_VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
_SCAN = "struct<at:int,depth:int,lists:int,start:int,name:string,spans:array<struct<start:int,end:int>>>"


def _inner_spans(html: Column, opens) -> Column:
    """(start, end) of the inner HTML of the outermost elements whose start
    tag ``opens`` accepts (a condition on the tag's text), in order.

    One walk over the page's tags carries the depth of open elements of the
    block's own name, so a block ends where its own element closes, whatever
    it nests; comments, scripts and styles are stepped over. ``p`` and ``li``
    may lack their end tag: a ``p`` ends at the next one, an ``li`` at the next
    one of its list or at the list's end. An element that is never closed
    ends with the page.
    """
    def step(acc: Column, token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        closing = token.startswith("</")
        starting = (name != "") & ~closing & ~name.isin(_VOID) & ~token.endswith("/>") & ~name.isin("script", "style")
        within = acc.start >= 0
        same = within & (name == acc["name"])
        item, para = within & (acc["name"] == "li"), within & (acc["name"] == "p")
        is_list = name.isin("ul", "ol")
        implied = (para & starting & (name == "p")) | (item & (acc.lists == 0) & ((starting & (name == "li")) | (closing & is_list)))
        depth = F.when(same & starting, acc.depth + 1).when(same & closing, acc.depth - 1).otherwise(acc.depth)
        # items of inner lists have their own depth
        depth = F.when(item & (acc.lists > 0), acc.depth).otherwise(depth)
        ends = within & (implied | (depth == 0))
        begins = (~within | ends) & starting & opens(token)
        after = acc.at + F.length(token)
        spans = F.when(ends, F.concat(acc.spans, F.array(F.struct(acc.start.alias("start"), acc.at.alias("end"))))).otherwise(acc.spans)
        lists = F.when(item & is_list & starting, acc.lists + 1).when(item & is_list & closing, acc.lists - 1).otherwise(acc.lists)
        return F.struct(after.alias("at"), F.when(begins, 1).when(ends, 0).otherwise(depth).alias("depth"),
                        F.when(begins | ends, 0).otherwise(lists).alias("lists"),
                        F.when(begins, after).when(ends, -1).otherwise(acc.start).alias("start"),
                        F.when(begins, name).otherwise(acc["name"]).alias("name"), spans.alias("spans")).cast(_SCAN)

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("lists"), F.lit(-1).alias("start"), F.lit("").alias("name"),
                    F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(_SCAN)
    tail = lambda acc: F.when(acc.start >= 0, F.concat(acc.spans, F.array(F.struct(acc.start.alias("start"), acc.at.alias("end"))))
                              ).otherwise(acc.spans)
    return F.aggregate(F.regexp_extract_all(html, F.lit(_MARKUP), 0), zero, step, tail)


def _inner(html: Column, span: Column) -> Column:
    return F.substr(html, span.start + 1, span.end - span.start)


def _start_tag(marker: str) -> str:
    """Regex of the start tags of a card marker: a bare tag name (``li``), or
    a text among the attributes."""
    return rf"(?is)<{marker}\b[^>]*>" if marker.isalnum() else rf"(?is)<\w[^>]*{re.escape(marker)}[^>]*>"


def page_cards(pages: DataFrame, markers: Sequence[str] = S.CARD_MARKERS, html: str = "html",
               page_id: str = "page_id") -> DataFrame:
    """Cards of each page, from the first marker that matches anything
    on that page; tags stripped, blanks collapsed. A card is its element's
    content, nested elements included; a card inside a card belongs to it."""
    x = _page_blocks(pages, markers, html, page_id)
    return x.select(page_id, "card_no", _plain(F.col("block")).alias("text"))


def _page_blocks(pages: DataFrame, markers: Sequence[str], html: str, page_id: str) -> DataFrame:
    """(page_id, card_no, block) of the first marker that a page has."""
    page = F.col(html)
    found = None
    for m in markers:
        pattern = F.lit(_start_tag(m))
        found = (F.when if found is None else found.when)(F.regexp_like(page, pattern), pattern)
    # the page's own pattern is chosen once, then the page is walked once
    chosen = pages.select(F.col(page_id), page.alias("_html"), found.alias("_tag")).where(F.col("_tag").isNotNull())
    spans = chosen.select(page_id, "_html", _inner_spans(F.col("_html"), lambda t: F.regexp_like(t, F.col("_tag"))).alias("_spans"))
    each = spans.select(page_id, "_html", F.posexplode("_spans").alias("card_no", "_span"))
    return each.select(page_id, "card_no", _inner(F.col("_html"), F.col("_span")).alias("block"))


def _element(html: Column, attributes: Sequence[str]) -> Column:
    """Inner HTML of the first element whose start tag matches an attribute
    pattern, up to where that element closes; the first pattern that a tag of
    the page matches counts."""
    found = None
    for a in attributes:
        tag = F.lit(rf"(?is)<\w+\b[^>]*{a}[^>]*>")
        found = (F.when if found is None else found.when)(F.regexp_like(html, tag), tag)
    inner = lambda tag: bind(F.get(_inner_spans(html, lambda t: F.regexp_like(t, tag)), F.lit(0)), lambda s: _inner(html, s))
    return bind(found, lambda tag: F.when(tag.isNotNull(), inner(tag)))


def _plain(html: Column) -> Column:
    """Tags stripped, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def page_listings(pages: DataFrame, checkin, checkout, scraped_on, ciudad: Column, reference: Column,
                  markers: Sequence[str] = S.CARD_MARKERS, html: str = "html", page_id: str = "page_id",
                  site_root: str = S.LISTING_SITE_ROOT) -> DataFrame:
    """X2 + X1: listing rows of captured pages. A card's title and price row
    are the first of the ordered patterns that it has, its link the first
    ``href``; the rules of :func:`extract_cards` do the rest."""
    blocks = _page_blocks(pages, markers, html, page_id)
    first = lambda patterns: bind(_plain(_element(F.col("block"), patterns)), lambda t: F.when(t != "", t))
    cards = blocks.select(
        page_id, "card_no", first(S.CARD_TITLE_ATTRIBUTES).alias("title_raw"), first(S.CARD_PRICE_ATTRIBUTES).alias("price_raw"),
        F.trim(F.regexp_replace(F.regexp_replace("block", r"<[^>]*>", "\n"), r"\n\s*", "\n")).alias("text"),
        F.nullif(F.regexp_extract("block", r'(?is)<a\b[^>]*href="([^"]*)"', 1), F.lit("")).alias("href"),
        F.lit(checkin).cast("date").alias("checkin"), F.lit(checkout).cast("date").alias("checkout"),
        ciudad.alias("ciudad"), reference.alias("propiedad_referencia"), F.lit(scraped_on).cast("date").alias("scraped_on"))
    return extract_cards(cards, site_root, keep=[page_id, "card_no"])


def robot_page_flag(pages: DataFrame, html: str = "html") -> Column:
    """Robot-check text present and no listing marker."""
    low = F.lower(F.col(html))
    robot = F.lit(False)
    for m in S.ROBOT_MARKERS:
        robot = robot | low.contains(m)
    cards = F.lit(False)
    for m in S.LISTING_PAGE_MARKERS:
        cards = cards | F.col(html).contains(m)
    return robot & ~cards


# -- K1 / N8 -----------------------------------------------------------------

def upsert_listings(existing: DataFrame | None, new: DataFrame, order: Sequence[str] = (),
                    drop: Sequence[str] = ()) -> DataFrame:
    """K1 + N8: append ``new`` to ``existing`` and keep the last row per
    (url, checkin); the price becomes int with bad/NULL -> 0.

    "Last" = rows of ``new`` after rows of ``existing``, then the ``order``
    columns ascending (arrival order inside a batch; NULLs first), then the
    row's hash, so that ties keep the same row however partitions are dealt.
    Done as a grouped ``max`` of one struct, rank first and then the other
    columns, so that no column is carried twice and duplicates collapse in the
    map-side partial aggregation: a hot key never reaches one task as raw rows. ``drop``
    removes helper columns (e.g. the arrival keys) from the result.
    """
    parts = [new.withColumn("_seq", F.lit(1))]
    if existing is not None:
        parts.insert(0, existing.withColumn("_seq", F.lit(0)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    cols = [c for c in u.columns if c != "_seq"]
    keep = [c for c in cols if c not in ("url", "checkin")]
    # an order column that isn't one of the row's own (a key, a field of a struct, one named twice) ranks under another name
    rank = [F.col(c).alias(c if c in keep and c not in order[:i] else f"_order{i}") for i, c in enumerate(order)]
    rest = [c for c in keep if c not in order]
    g = u.groupBy("url", "checkin").agg(F.max(F.struct("_seq", *rank, F.xxhash64(*keep).alias("_hash"), *rest)).alias("r"))
    out = g.select("url", "checkin", *[F.col(f"r.{c}").alias(c) for c in keep])
    out = out.withColumn("precio_noche",
                         F.coalesce(F.col("precio_noche").cast("string").try_cast("double").try_cast("int"),
                                    F.lit(0)))
    return out.select(*[c for c in cols if c not in drop])


# -- A30-A32, W7, W8 -----------------------------------------------------------

def coerce_market(m: DataFrame) -> DataFrame:
    """F36 + W5: numeric price / rating, date check-in, rows without price
    dropped."""
    def numeric(c: str):
        # numbers keep their type (as pandas.to_numeric does); text is parsed
        if isinstance(m.schema[c].dataType, T.NumericType):
            return F.col(c)
        return plain_number(c)
    out = m.withColumn("precio_noche", numeric("precio_noche"))
    if "rating" in m.columns:
        out = out.withColumn("rating", numeric("rating"))
    if "checkin" in m.columns:
        out = out.withColumn("checkin", F.try_to_date(F.col("checkin").cast("string")))
    return out.where(F.col("precio_noche").isNotNull())


def season_filter(m: DataFrame, season: str | None) -> DataFrame:
    """Keep check-in months of the season; skipped for "all" or when no
    check-in is known."""
    if not season or "checkin" not in m.columns or "todo" in season.lower():
        return m
    m = attach(m, "_k", m.agg(F.count("checkin").alias("n")))
    keep = (F.col("_k.n") == 0) | SF.month_in_season(F.col("checkin"), season)
    return m.where(keep).drop("_k")


def market_price_stats(m: DataFrame) -> DataFrame:
    """One row: mean, count, latest scrape date and the five-number summary
    of prices (``p0``, ``p25``, ``m_median``, ``m_p75``, ``p100``), from one
    exact quantile pass; the KPIs, the box summary and the advisor facts can
    all share it."""
    q = exact_quantiles(m, "precio_noche", {"p0": 0.0, "p25": 0.25, "m_median": 0.5, "m_p75": 0.75,
                                            "p100": 1.0})
    a = m.agg(F.avg("precio_noche").alias("m_mean"),
              (F.max("fecha_scraping") if "fecha_scraping" in m.columns else F.lit(None).cast("date")
               ).alias("last_scrape"))
    return attach(a, "_q", q).select("m_mean", "_q.m_median", "_q.m_p75", F.col("_q.n").alias("n_listings"),
                                     "last_scrape", "_q.p0", "_q.p25", "_q.p100")


class RankIndex:
    """How many values lie below a number: the distinct values with running
    counts, stored by value range. ``bounds`` (at most one per bucket) and
    ``offsets`` are small lists; the running counts start anew in each bucket."""

    def __init__(self, table: DataFrame, bounds: Sequence[float], offsets: Mapping[int, int]):
        self.table, self.bounds, self.offsets = table, list(bounds), dict(offsets)

    def bucket(self, v: Column) -> Column:
        """Number of bounds below ``v``."""
        if not self.bounds:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(b) for b in self.bounds]), lambda b: b < v))

    def before(self, bucket: Column) -> Column:
        """Values in the buckets before."""
        last, totals = 0, []
        for i in range(len(self.bounds) + 1):
            totals.append(last)
            last += self.offsets.get(i, 0)
        return F.element_at(F.array(*[F.lit(t).cast("bigint") for t in totals]), bucket + 1)


def rank_index(values: DataFrame, col: str, buckets: int | None = None) -> RankIndex:
    """Build (and store) the rank index of a column's values; NULLs are left
    out. Hot values collapse in the map-side count. Bounds come from a bounded
    sketch of the distinct values and only balance the buckets."""
    n = buckets or bucket_count(values.sparkSession)
    v = values.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    counts = written(v.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "value_counts")
    probs = [i / n for i in range(1, n)]
    found = counts.agg(F.percentile_approx("v", probs, 1000).alias("b")).first().b if probs else None
    index = RankIndex(counts, sorted(set(found or [])), {})
    upto = F.sum("c").over(Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    index.table = written(counts.withColumn("bucket", index.bucket(F.col("v"))).select("bucket", "v", upto.alias("upto")), "rank_index")
    index.offsets = {r.bucket: r.n for r in index.table.groupBy("bucket").agg(F.max("upto").alias("n")).collect()}
    drop_written(values.sparkSession, counts)
    return index


def count_below(values: DataFrame | RankIndex, col: str, probes: DataFrame, probe_col: str,
                buckets: int | None = None) -> DataFrame:
    """For each probe row, ``n_below``: the number of ``values`` rows strictly
    below the probe value (an as-of rank lookup without a range join); NULL
    for a NULL probe.

    The values' rank index (:func:`rank_index`, or a stored one) and the
    distinct probes meet sorted by value, bucket by bucket: a probe's rank is
    the last running count before it. Probe rows get it by their value, so a
    price that many rows have is one probe.
    """
    index = values if isinstance(values, RankIndex) else rank_index(values, col, buckets)
    p = probes.select(F.col(probe_col).cast("double").alias("v")).where(F.col("v").isNotNull()).distinct()
    sides = index.table.withColumn("_probe", F.lit(0)).unionByName(
        p.select(index.bucket(F.col("v")).alias("bucket"), "v", F.lit(None).cast("bigint").alias("upto"), F.lit(1).alias("_probe")))
    # at equal values the probe comes first: strictly below
    passed = Window.partitionBy("bucket").orderBy("v", F.desc("_probe")).rowsBetween(Window.unboundedPreceding, 0)
    ranks = sides.withColumn("below", F.coalesce(F.max("upto").over(passed), F.lit(0)) + index.before(F.col("bucket"))).where("_probe = 1")
    ranks = ranks.select(F.col("v").alias("_v"), F.col("below").alias("n_below"))
    return probes.join(ranks, F.col(probe_col).cast("double") == F.col("_v"), "left").drop("_v")


def market_kpis(own: DataFrame, market: DataFrame, price_col: str = "precio_medio",
                season: str | None = None, stats: DataFrame | None = None) -> DataFrame:
    """A30 for every own row (e.g. one per property): market mean, median,
    p75, share of listings strictly cheaper than the own price (0 when the
    market has at most one row), difference vs the mean, latest scrape.
    ``stats`` reuses a :func:`market_price_stats` row of the same market."""
    m = season_filter(coerce_market(market), season)
    stats = stats if stats is not None else market_price_stats(m)
    k = count_below(m, "precio_noche", own, price_col)
    k = attach(k, "_s", stats)
    pos = F.when(F.col("_s.n_listings") > 1,
                 F.coalesce(F.col("n_below"), F.lit(0)) / F.col("_s.n_listings") * 100).otherwise(0.0)
    diff = F.when(F.col("_s.m_mean") != 0,
                  (F.col(price_col) - F.col("_s.m_mean")) / F.col("_s.m_mean") * 100).otherwise(0.0)
    return k.select(*own.columns, F.col("_s.m_mean").alias("m_mean"), F.col("_s.m_median").alias("m_median"),
                    F.col("_s.m_p75").alias("m_p75"), pos.alias("pos_pct"), diff.alias("diff_vs_mean"),
                    F.col("_s.n_listings").alias("n_listings"), F.col("_s.last_scrape").alias("last_scrape"))


def price_histogram(market: DataFrame, bins: int = 20) -> DataFrame:
    """Fixed-width bins over [min, max] of the prices (last bin closed)."""
    m = coerce_market(market)
    m = attach(m, "_r", m.agg(F.min("precio_noche").alias("lo"), F.max("precio_noche").alias("hi")))
    width = (F.col("_r.hi") - F.col("_r.lo")) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("precio_noche") - F.col("_r.lo")) / width), F.lit(bins - 1)).cast("int"))
    g = m.withColumn("bin", b).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("_r").alias("_r"))
    w = (F.col("_r.hi") - F.col("_r.lo")) / F.lit(float(bins))
    return g.select("bin", (F.col("_r.lo") + F.col("bin") * w).alias("lo"),
                    (F.col("_r.lo") + (F.col("bin") + 1) * w).alias("hi"), "n")


def price_box(market: DataFrame, own: DataFrame | float, stats: DataFrame | None = None) -> DataFrame:
    """Five-number summary of market prices, and the own price (a
    one-row DataFrame with column ``p``, or a number) as a flat box."""
    m = coerce_market(market)
    q = stats if stats is not None else market_price_stats(m)
    names = ["p0", "p25", "p50", "p75", "p100"]
    mk = q.select(F.lit("Mercado").alias("origen"), "p0", "p25", F.col("m_median").alias("p50"),
                  F.col("m_p75").alias("p75"), "p100")
    if not isinstance(own, DataFrame):
        own = m.sparkSession.createDataFrame([(float(own),)], "p double")
    me = own.select(F.lit("Tu Propiedad").alias("origen"), *[F.col("p").alias(c) for c in names])
    return mk.unionByName(me)


def price_by_type(market: DataFrame) -> DataFrame:
    """Mean price per accommodation type, ascending; listings without a
    type are in no group (D1)."""
    m = coerce_market(market).where(F.col("tipo").isNotNull())
    return m.groupBy("tipo").agg(F.avg("precio_noche").alias("precio_noche")).orderBy("precio_noche", "tipo")


def direct_competitors(market: DataFrame, own_price: Column, band: float = 0.30) -> DataFrame:
    """W7 + P7: listings within +-band of the own price (inclusive), cheapest
    first, display columns that exist."""
    m = coerce_market(market)
    lo, hi = own_price * (1 - band), own_price * (1 + band)
    m = m.where((F.col("precio_noche") >= lo) & (F.col("precio_noche") <= hi))
    wanted = [c for c in ["nombre", "precio_noche", "rating", "tipo", "url"] if c in m.columns]
    return m.select(*wanted).orderBy("precio_noche", *[c for c in ("url", "nombre") if c in wanted])
