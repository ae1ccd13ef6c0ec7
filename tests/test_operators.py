"""Operator semantics on small hand-made inputs (FIXTURES.md §3)."""

import datetime as dt
import random
import math

from pyspark.sql import functions as F

from stayspark.operators import clean as CL
from stayspark.operators import forecast as FC
from stayspark.operators import market as MK
from stayspark.operators import planner as PL
from stayspark.operators import stats as ST


def test_date_election_majority(spark):
    vals = ["01/02/2024"] * 51 + ["2024-02-01"] * 49
    df = spark.createDataFrame([(v,) for v in vals], "d string")
    assert CL.elect_date_formats(df, ["d"]) == {"d": 0}
    half = spark.createDataFrame([(v,) for v in ["01/02/2024"] * 50 + [None] * 50], "d string")
    assert CL.elect_date_formats(half, ["d"]) == {"d": -1}


def test_price_bins_right_closed(spark):
    df = spark.createDataFrame([(v, 1.0) for v in [0.5, 2.5, 5.0, 7.0, 10.0]], "p double, q double")
    d = df.select(F.col("p").alias("price_per_night"), F.col("q").alias("nights"))
    # edges 0.5 | 5.25 | 10, right-closed, minimum in bin 1 (cap off)
    got = {r.bin: r.bookings for r in ST.price_bins(d, 2, cap_quantile=1.0).collect()}
    assert got == {1: 3, 2: 2}
    # with W5 + W6: 0 is dropped (price > 0) and 10 is above the 95th percentile
    d0 = spark.createDataFrame([(v, 1.0) for v in [0.0, 2.5, 5.0, 7.0, 10.0]],
                               "price_per_night double, nights double")
    assert {r.bin: r.bookings for r in ST.price_bins(d0, 2).collect()} == {1: 1, 2: 2}
    const = spark.createDataFrame([(5.0, 1.0)] * 4, "price_per_night double, nights double")
    assert [r.bin for r in ST.price_bins(const, 10).collect()] == [1]


def test_p_value_series(spark):
    df = spark.createDataFrame([(2.306004, 8), (12.7062, 1), (3.182446, 3), (2.364624, 7)], "t double, d int")
    got = [r[0] for r in df.select(ST._t_two_sided_p(F.col("t"), F.col("d"))).collect()]
    assert all(math.isclose(p, 0.05, abs_tol=1e-5) for p in got), got


def _monthly_bookings(spark, months):
    rows = []
    for i in range(months):
        y, m = 2020 + i // 12, i % 12 + 1
        rows.append((f"{y}-{m:02d}", 100.0 + i, 2.0, 50.0, m, y))
    return spark.createDataFrame(rows, "year_month string, amount double, nights double, "
                                       "price_per_night double, month int, year int")


def test_forecast_needs_twelve_months(spark):
    assert FC.seasonal_naive_forecast(_monthly_bookings(spark, 11)).count() == 0
    fc = FC.seasonal_naive_forecast(_monthly_bookings(spark, 12), horizon_months=6).collect()
    assert len(fc) == 6 and fc[0].period == dt.date(2021, 1, 1)
    assert all(r.ci_low <= r.forecast <= r.ci_high for r in fc)


def test_planner_past_branch(spark):
    d3, d2, d1 = dt.date(2000, 3, 1), dt.date(2000, 2, 1), dt.date(2000, 1, 1)
    rows = [("P", "C", d3, d3 + dt.timedelta(2), 2), ("P", "C", d3, d3 + dt.timedelta(1), 1),
            ("P", "C", d2, d2 + dt.timedelta(1), 1), ("P", "C", d1, d1 + dt.timedelta(1), 1),
            ("Q", "C", dt.date(2030, 1, 2), dt.date(2030, 1, 3), 1), ("Q", "C", d1, d1, 1)]
    df = spark.createDataFrame(rows, "propiedad string, ciudad string, checkin date, checkout date, noches int")
    plan = PL.search_plan(df, "2025-01-01").collect()
    p = sorted((r.checkin, r.checkout) for r in plan if r.propiedad_referencia == "P")
    assert p == [(d2, d2 + dt.timedelta(1)), (d3, d3 + dt.timedelta(1))]
    assert [r.checkin for r in plan if r.propiedad_referencia == "Q"] == [dt.date(2030, 1, 2)]


def test_upsert_keeps_last_and_is_idempotent(spark):
    old = spark.createDataFrame([("u1", dt.date(2026, 7, 1), "a", 10), ("u2", dt.date(2026, 7, 1), "b", 20)],
                                "url string, checkin date, nombre string, precio_noche int")
    new = spark.createDataFrame([("u1", dt.date(2026, 7, 1), "a2", None)],
                                "url string, checkin date, nombre string, precio_noche int")
    up = MK.upsert_listings(old, new)
    got = {r.url: (r.nombre, r.precio_noche) for r in up.collect()}
    assert got == {"u1": ("a2", 0), "u2": ("b", 20)}
    again = {r.url: (r.nombre, r.precio_noche) for r in MK.upsert_listings(up, new).collect()}
    assert again == got


def test_outlier_flags(spark):
    vals = [10.0] * 20 + [11.0] * 20 + [1000.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, amount double")
    r = ST.outlier_report(df, "amount").collect()
    assert [x.amount for x in r] == [1000.0] and r[0].is_outlier_iqr
    const = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, amount double")
    assert CL.with_zscore_flag(const, "amount", "z").where("z").count() == 0


def test_impute(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (None, 5.0, "c")], "i int, x double, s string")
    mean = {r.s: (r.i, r.x) for r in CL.impute_missing(df, "mean").collect()}
    assert mean["b"][1] == 3.0 and mean["c"][0] == 1.5
    med = {r.s: r.x for r in CL.impute_missing(df, "median").collect()}
    assert med["b"] == 3.0
    assert CL.impute_missing(df, "other").collect() == df.collect()


def test_mapping_and_raw_mode(spark):
    df = spark.createDataFrame([("1", "x", "y", "z")], "r_id string, Name string, NAME string, total string")
    m = CL.map_columns(df)
    assert m["id"] == "r_id" and m["amount"] == "total" and m["owner"] == "NAME"
    rep = {r.logical: (r.physical, r.found) for r in CL.mapping_report(df).collect()}
    assert rep["guest"] == (None, False)
    assert CL.raw_mode_columns(["R_PROPERTY_NAME", "R_TOTAL_AMOUNT"])["price"] == "R_TOTAL_AMOUNT"


def test_city_join_table_form(spark):
    props = spark.createDataFrame([("NATION_12",), ("Casa Oropesa",), ("nada",)], "propiedad string")
    kw = PL.city_keywords_table(spark, [("nation_1", "A"), ("nation_12", "B"), ("oropesa", "O")])
    got = {r.propiedad: r.ciudad for r in PL.detect_city_join(props, kw).collect()}
    assert got == {"NATION_12": "A", "Casa Oropesa": "O"}


def test_rename_with_case_duplicates(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([("1", "ana", "ANA", "10,5", "x")], "R_ID string, Name string, NAME string, "
                                                                        "total string, id string")
        out = CL.rename_canonical(df)
        assert out.columns == ["id", "Name", "owner", "amount"]
        assert tuple(out.first()) == ("1", "ana", "ANA", "10,5")
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_page_cards_markers(spark):
    html = ('<div data-testid="card-container"><div><span>Casa A</span></div><div>120 €</div></div>'
            '<div data-testid="card-container"><div>Casa B</div></div><p>x</p>')
    pages = spark.createDataFrame([(1, html), (2, "<ul><li>uno</li><li><b>dos</b></li></ul>"), (3, "nada")],
                                  "page_id long, html string")
    got = {(r.page_id, r.card_no): r.text for r in MK.page_cards(pages, ['data-testid="card-container"', "li"])
           .collect()}
    assert got == {(1, 0): "Casa A 120 €", (1, 1): "Casa B", (2, 0): "uno", (2, 1): "dos"}
    flags = pages.select(MK.robot_page_flag(pages).alias("f")).collect()
    assert [r.f for r in flags] == [False, False, False]


def test_cards_end_where_their_element_closes(spark):
    m = 'data-testid="card-container"'
    pages = [
        f"<div><div {m}>A <div>b <div>c</div></div> d</div> between <DIV class=x {m}>E<br/><div/>f</DIV><footer><div>999 €</div></footer></div>",
        f"<script>x = '<div {m}>no</div>'</script><!-- <div {m}>no</div> --><section {m}>one <div></section> open <i>x</i>",
        f"<div {m}>outer <div {m}>inner</div> rest</div>tail<div {m}>last <p>never closed",
        "<ul><li>a<ul><li>b</li><li>c</ul> d</li><li>e<li>f</ul>text<p>g<p>h</p>i",
        "no cards", None]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = {}
    for r in MK.page_cards(df, [m, "li", "p"]).orderBy("page_id", "card_no").collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got == {0: ["A b c d", "E f"], 1: ["one"], 2: ["outer inner rest", "last never closed"], 3: ["a b c d", "e", "f"]}
    assert [r.text for r in MK.page_cards(df.where("page_id = 3"), ["p"]).orderBy("card_no").collect()] == ["g", "h"]
    html = f'<div {m}><div id="title_1">Casa <div>azul</div> grande</div><span class="pricingText">80 € <span>noche</span></span></div><p>total 999 €</p>'
    out = MK.page_listings(spark.createDataFrame([(1, html)], "page_id int, html string"), "2026-07-15", "2026-07-18", "2026-07-01", F.lit("X"), F.lit("Y")).first()
    assert (out.nombre, out.precio_noche) == ("Casa azul grande", 80)


def test_keyword_join_of_many_keywords(spark, monkeypatch):
    """100,000 keywords, broadcast or shuffled, against the literal rule."""
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdeé") for _ in range(n))
    words = [word(rnd.randrange(3, 9)) for _ in range(99_990)] + ["a", "casa azul", "", "no such", "ABC", "a", "bb", "é", "cab", "dd"]
    keywords = [(i, k, f"city {i}") for i, k in enumerate(words) if k != ""]
    names = [word(rnd.randrange(0, 14)) for _ in range(120)] + ["Mi Casa Azul", "ABC", "x", None, "Mi Casa Azul"]

    def literal(name):
        return next((c for _, k, c in keywords if k in name.lower()), None)

    want = {n: literal(n) for n in names if n is not None and literal(n)}
    table = spark.createDataFrame(keywords, "prio int, keyword string, ciudad string")
    props = spark.createDataFrame([(n,) for n in names], "propiedad string")
    for most in (100_000, 10):
        monkeypatch.setattr(PL, "BROADCAST_KEYWORDS", most)
        df = PL.detect_city_join(props, table)
        assert {r.propiedad: r.ciudad for r in df.collect()} == want
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    every = spark.createDataFrame([(0, "zz", "Z"), (1, "", "all")], table.schema)
    assert {r.ciudad for r in PL.detect_city_join(props, every).collect()} == {"all"}
    assert PL.detect_city_join(props, table.where("false")).count() == 0


def test_wide_matrix_and_peak_summary(spark):
    from stayspark.operators import summary as SM
    df = spark.createDataFrame([("P", "2024-01", 10.0), ("P", "2024-02", 5.0), ("Q", "2024-02", 7.0)],
                               "property string, year_month string, amount double")
    wide = {r.property: (r["2024-01"], r["2024-02"]) for r in SM.property_month_matrix(df).collect()}
    assert wide == {"P": (10.0, 5.0), "Q": (0.0, 7.0)}
    given = SM.property_month_matrix(df, ["2024-02", "2024-03"])
    assert {tuple(r) for r in given.collect()} == {("P", 5.0, 0.0), ("Q", 7.0, 0.0)}
    assert {r.property: r.ingresos_por_mes for r in SM.property_month_rows(df).collect()} == {"P": {"2024-01": 10.0, "2024-02": 5.0}, "Q": {"2024-02": 7.0}}
    assert SM.property_month_matrix(df.where("false")).columns == ["property"]
    rows = [(m, 1.0, 1.0, 10.0) for m in range(1, 13) for _ in range(10 if m in (7, 8) else (1 if m == 1 else 5))]
    b = spark.createDataFrame(rows, "month int, amount double, nights double, price_per_night double")
    s = ST.demand_peaks_summary(b).first()
    assert list(s.peaks) == ["Jul", "Ago"] and list(s.valleys) == ["Ene"]


def test_price_sample_caps_at_quantile(spark):
    rows = [(float(v), 1.0) for v in range(1, 101)] + [(0.0, 1.0), (None, 1.0), (5.0, None)]
    df = spark.createDataFrame(rows, "price_per_night double, nights double")
    got = sorted(r.p for r in ST.price_sample(df, cap_quantile=0.95).collect())
    # positive prices 1..100; the 95th percentile is 95.05, so 1..95 stay
    assert got == [float(v) for v in range(1, 96)]


def test_card_prices_are_computed_once(spark):
    """No filter repeats the price, and each text of it is read by one regex;
    dates as text and as dates give the same nights."""
    rows = [("a", "300 € en total", None, "2026-07-15", "2026-07-18"), ("b", None, "Casa\n1.250 € noche", "2026-07-15", "2026-07-14"),
            ("c", "0 €", "90 €", "2026-07-15", "2026-07-18"), ("d", "", "00 €", "2026-07-15", None), ("e", None, None, None, None),
            ("f", "80 € total", "x", None, "2026-07-18"), ("g", "10 € total", "", "2026-07-01", "2026-08-30"), ("h", "", "sin precio", None, None)]
    df = spark.createDataFrame([(*r, None, "X", "Y", "2026-07-01") for r in rows],
                               "href string, price_raw string, text string, checkin string, checkout string, title_raw string, "
                               "ciudad string, propiedad_referencia string, scraped_on string")
    dates = df.withColumns({"checkin": F.col("checkin").cast("date"), "checkout": F.col("checkout").cast("date")})
    for cards in (df, dates):
        out = MK.extract_cards(cards, keep=["href"])
        assert {r.href: r.precio_noche for r in out.collect()} == {"a": 100, "b": 1250, "f": 80, "g": 1}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"(\d{2,5})") == plan.count(r"(\d[\d.\s,]*)") == 1


def test_upsert_ranks_by_keys_and_fields(spark):
    """Order columns may be keys, fields of a struct or named twice; what
    ties on them keeps one row; no column is carried twice."""
    rows = [("u", "2026-07-01", 1, "a", 5), ("u", "2026-07-01", 2, "b", 4), ("u", "2026-07-01", 3, "b", 4), ("v", None, None, None, None)]
    df = spark.createDataFrame(rows, "url string, checkin string, precio_noche int, day string, n int").withColumn("at", F.struct("day", "n"))
    for order, price in ((["url", "at.day", "precio_noche"], 3), (["n", "n", "day"], 1), (["day", "precio_noche", "day"], 3)):
        out = MK.upsert_listings(None, df, order=order, drop=["at"])
        assert out.columns == ["url", "checkin", "precio_noche", "day", "n"]
        assert {r.url: r.precio_noche for r in out.collect()} == {"u": price, "v": 0}
    plan = MK.upsert_listings(None, df, order=["day"])._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan
