"""Input views built from the driver's tables (see FIXTURES.md §2).

The same views exist as DuckDB SQL in :mod:`stayspark.plans.oracle` so that
every query can be checked against an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.operators.clean import clean_and_enrich, filter_confirmed_paid
from stayspark.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_US_MONEY = "format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2)"


def bookings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text bookings as an upload would deliver them (all fields strings)."""
    configure(spark)
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.col("o_orderkey").alias("R_ID"),
        F.expr("""CASE o_orderkey % 11 WHEN 0 THEN 'Annuled' WHEN 1 THEN 'Unavailable'
                  WHEN 2 THEN 'Open' WHEN 3 THEN 'Pending' WHEN 4 THEN NULL
                  ELSE CASE WHEN o_orderstatus = 'F' THEN 'Fact.' ELSE 'Booked' END END""").alias("R_STATUS"),
        F.expr("date_format(o_orderdate, 'dd/MM/yyyy')").alias("R_ARRIVAL"),
        F.expr("date_format(date_add(CAST(o_orderdate AS DATE), CAST(1 + o_orderkey % 7 AS INT)),"
               " 'dd/MM/yyyy')").alias("R_DEPARTURE"),
        F.expr("""CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN '5d'
                  ELSE CAST(1 + o_orderkey % 7 AS STRING) END""").alias("R_NIGHTS"),
        F.expr(f"""CASE o_orderkey % 4 WHEN 0 THEN concat({_US_MONEY}, ' EUR') WHEN 1 THEN {_US_MONEY}
                   WHEN 2 THEN concat(translate({_US_MONEY}, ',.', '.,'), ' €')
                   ELSE replace({_US_MONEY}, ',', '') END""").alias("R_TOTAL_AMOUNT"),
        F.expr("CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat(n_name, ' ', CAST(c_custkey % 8 AS STRING)) END"
               ).alias("R_PROPERTY_NAME"),
        F.expr("""CASE WHEN o_orderpriority = '1-URGENT' THEN 'booking.com' WHEN o_orderpriority = '2-HIGH' THEN 'AIRBNB es'
                  WHEN o_orderpriority = '3-MEDIUM' THEN 'vrbo' WHEN o_orderpriority = '5-LOW' THEN 'caty'
                  WHEN o_orderkey % 3 = 0 THEN 'agencia DEL sol' ELSE NULL END""").alias("R_SOURCE"),
        F.col("c_name").alias("R_GUEST_NAME"),
    )


# The layout of the view's dates is known; only ``elect`` runs the election.
BOOKING_DATES = {"arrival": "dd/MM/yyyy", "departure": "dd/MM/yyyy"}


def bookings_clean(spark: SparkSession, sf_dir: str, elect: bool = False, outlier_flag: bool = False) -> DataFrame:
    """Cleaned and enriched bookings (all statuses). Lazy: filters and column
    lists of a query reach the scans; ``_is_outlier`` only where asked for."""
    formats = None if elect else BOOKING_DATES
    return clean_and_enrich(bookings_raw(spark, sf_dir), formats, outlier_flag=outlier_flag)


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, confirmed and paid bookings: the input of the analytics."""
    return filter_confirmed_paid(bookings_clean(spark, sf_dir))


def _lineitem_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # the line table meets parts by shuffle at any size, which also spreads a narrow scan
    return (li.join(p.hint("shuffle_hash"), li.l_partkey == p.p_partkey)
            .join(s, li.l_suppkey == s.s_suppkey)
            .join(n, s.s_nationkey == n.n_nationkey))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured market listings (plus the line keys used as arrival order)."""
    configure(spark)
    return _lineitem_dims(spark, sf_dir).select(
        F.col("p_name").alias("nombre"),
        F.floor("l_extendedprice").cast("int").alias("precio_noche"),
        F.expr("CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 4.0E0 + (l_partkey % 100) / 100.0E0 END"
               ).alias("rating"),
        F.expr("CAST(l_partkey % 300 AS INT)").alias("num_reviews"),
        F.expr("CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE p_type END").alias("tipo"),
        F.expr("CAST(1 + p_size % 8 AS INT)").alias("capacidad"),
        F.concat(F.lit("https://example.com/rooms/"), F.col("l_partkey").cast("string")).alias("url"),
        F.expr("CAST(date_trunc('month', l_shipdate) AS DATE)").alias("checkin"),
        "l_orderkey", "l_linenumber",
        F.col("n_name").alias("ciudad"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured listing cards (raw text fields of each card)."""
    configure(spark)
    return _lineitem_dims(spark, sf_dir).select(
        "l_orderkey", "l_linenumber",
        F.expr("""CASE WHEN l_partkey % 3 = 0 THEN NULL
                  WHEN l_partkey % 3 = 1 THEN concat('Apartamento en ', n_name)
                  ELSE concat('Casa ', p_name, ' ', n_name) END""").alias("title_raw"),
        F.expr("""CASE WHEN l_partkey % 5 = 0 THEN NULL
                  ELSE concat(CAST(CAST(floor(l_extendedprice / 100) AS INT) AS STRING), ' € en total')
                  END""").alias("price_raw"),
        F.expr("""concat('Superanfitrión', chr(10), 'Refugio ', p_name, ' con vistas', chr(10),
                  CASE WHEN l_partkey % 7 = 0 THEN 'Valoración media de 4,81 sobre 5'
                       ELSE concat('4,', lpad(CAST(l_partkey % 100 AS STRING), 2, '0'), ' (',
                                   CAST(l_partkey % 300 AS STRING), ')') END,
                  chr(10),
                  CASE p_type WHEN 'ECONOMY' THEN 'Habitación privada' WHEN 'SMALL' THEN 'Cabaña'
                       WHEN 'LARGE' THEN 'Casa entera' WHEN 'PROMO' THEN 'Camping'
                       ELSE 'Apartamento entero' END,
                  chr(10), CAST(1 + p_size % 8 AS STRING), ' huéspedes', chr(10),
                  CAST(CAST(floor(l_extendedprice / 1000) AS INT) AS STRING), ' € noche')""").alias("text"),
        F.expr("""CASE WHEN l_partkey % 2 = 0 THEN concat('/rooms/', CAST(l_partkey AS STRING))
                  ELSE concat('https://example.com/rooms/', CAST(l_partkey AS STRING)) END""").alias("href"),
        F.expr("1 + l_orderkey % 6").alias("nights"),
        F.col("n_name").alias("ciudad"),
    )


# Planner keyword table for these views: property names are NATION_<k>, so
# the map is generated by a rule, in order; NATION_12 meets "nation_1" first.
FIXTURE_CITY_KEYWORDS = [(f"nation_{i}", f"City {i}") for i in range(25)]
CARD_CHECKIN = "2026-07-15"
CARD_SCRAPED_ON = "2026-07-01"
# The driver's pages carry no listing markers; list items, then paragraphs.
PAGE_MARKERS = ["li", "p"]


def captured_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cards`` with the search context a capture carries (dates, place)."""
    c = cards(spark, sf_dir)
    checkin = F.lit(CARD_CHECKIN).cast("date")
    return c.select("l_orderkey", "l_linenumber", "title_raw", "price_raw", "text", "href",
                    checkin.alias("checkin"), F.date_add(checkin, F.col("nights").cast("int")).alias("checkout"),
                    "ciudad", F.col("ciudad").alias("propiedad_referencia"),
                    F.lit(CARD_SCRAPED_ON).cast("date").alias("scraped_on"))


def pages_with_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as a listings site would send them: robot checks (every
    fifth page), card containers whose title, price row and link come from the
    page, with elements of the containers' own kind inside them, and a footer
    with a price of its own; every seventh page has no cards."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    card = lambda i, price: F.concat(
        F.lit('<div itemprop="x" data-testid="card-container"><div class="photo"><div>foto</div></div><a href="/rooms/'), F.col("page_id").cast("string"), F.lit(f"-{i}"),
        F.lit('"><div id="title_'), F.col("page_id").cast("string"), F.lit('">'), title,
        F.lit('<div class="badge"> vista</div> al mar</div></a><!-- </div> --><script>var d = "</div>";</script>'),
        F.lit('<span>4,'), F.lpad((F.col("page_id") % 90 + 10).cast("string"), 2, "0"), F.lit(" ("), (F.col("page_id") % 500).cast("string"), F.lit(")</span> "),
        F.when(F.col("page_id") % 2 == 0, F.lit("Casa entera")).otherwise(F.lit("Habitación privada")), F.lit("<br>"), price, F.lit("</div>"))
    priced = F.concat(F.lit('<div data-testid="price-availability-row"><div><b>'), (F.col("page_id") % 400).cast("string"), F.lit(" € </b></div>noche</div>"))
    total = F.concat(F.lit('<span class="u1 pricingText-x"><span>'), (F.col("page_id") + 200).cast("string"), F.lit("</span> € en total</span>"))
    between = F.lit("<p>Publicidad 777 €</p>")
    cards_html = F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(
        F.concat(card(1, priced), between, card(2, total), card(3, F.lit("agotado"))))
    robot = F.when(F.col("page_id") % 5 == 0, F.lit("<p>Are you a ROBOT? captcha</p>")).otherwise(F.lit(""))
    return p.select("page_id", F.concat(robot, F.lit("<main>"), cards_html, F.lit("</main><footer><div>Tarifas desde 999 € la noche</div></footer>")).alias("html"))


def names_and_keywords(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names to look places up for (properties, listings with their nation)
    and a keyword table from the nations (whole and by their first letters)
    and the parts."""
    configure(spark)
    listings = market(spark, sf_dir).select(F.concat("nombre", F.lit(" en "), "ciudad").alias("propiedad"))
    names = bookings_raw(spark, sf_dir).select(F.col("R_PROPERTY_NAME").alias("propiedad")).unionByName(listings)
    n, p = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    city = F.concat(F.lit("City "), F.col("n_nationkey").cast("string"))
    key = F.col("n_nationkey").cast("bigint")
    words = (n.select((key * 2).alias("prio"), F.lower("n_name").alias("keyword"), city.alias("ciudad"))
             .unionByName(n.select((key * 2 + 1).alias("prio"), F.lower(F.substring("n_name", 2, 4)).alias("keyword"), city.alias("ciudad")))
             .unionByName(p.select((F.col("p_partkey") % 40 * 100000 + F.col("p_partkey")).alias("prio"), F.lower("p_name").alias("keyword"),
                                   F.concat(F.lit("Zone "), F.col("p_partkey").cast("string")).alias("ciudad"))))
    return names, words


def store_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The market listings as an existing store and a later capture."""
    m = market(spark, sf_dir)
    return m.where("l_orderkey % 2 = 0"), m.where("l_orderkey % 2 = 1")
