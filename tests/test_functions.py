"""Edge-case tables for the scalar functions (FIXTURES.md §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stayspark import functions as SF


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


MONEY = [("€ 1.234,56", 1234.56), ("$1,234.56", 1234.56), ("1234,56", 1234.56), ("1234.56", 1234.56),
         ("1.234", 1.234), ("1,234", 1.234), ("1,234,567", 0.0), ("EUR 0", 0.0), ("-50 €", -50.0),
         ("5-3", 0.0), ("", 0.0), ("nan", 0.0), (None, 0.0), ("abc", 0.0), ("1e16", 116.0), ("12.", 12.0),
         ("1.234.567,89", 1234567.89), ("1,234,567.89", 1234567.89), ("  7,5 ", 7.5)]


def test_clean_money(spark):
    df = one_col(spark, [m[0] for m in MONEY]).select("x", SF.clean_money("x").alias("y"))
    got = {r.x: r.y for r in df.collect()}
    for raw, want in MONEY:
        assert got[raw] == want, raw


def test_classify_status(spark):
    cases = {"Booked": "Confirmada", "Fact.": "Confirmada", "booked": "Otro", "annuled": "Cancelada",
             "Cleaning": "Bloqueada", "Tentative": "Abierta", None: "Desconocido"}
    df = one_col(spark, list(cases)).select("x", SF.classify_status("x").alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases


def test_normalize_channel(spark):
    cases = {"BOOKING.COM": "Booking.com", "my airbnb": "Airbnb", "vrbo": "HomeAway/VRBO",
             "OH": "Other Holiday", "ohio": "Ohio", "maria": "Manual / Directo",
             "Limpieza": "Limpieza/Bloqueo", "<NULL>": "Directo / Sin canal", "  ": "Directo / Sin canal",
             None: "Directo / Sin canal", "o'neil-x  web": "O'Neil-X  Web"}
    df = one_col(spark, list(cases)).select("x", SF.normalize_channel("x").alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases


def test_weekend_and_holiday(spark):
    days = [dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 7),
            dt.datetime(2023, 4, 18), dt.datetime(2031, 1, 6), None]
    df = spark.createDataFrame([(d,) for d in days], "x timestamp")
    got = df.select(SF.is_weekend("x").alias("w"), SF.is_holiday("x").alias("h")).collect()
    assert [r.w for r in got] == [False, True, True, False, False, False]
    assert [r.h for r in got] == [False, False, False, True, True, False]


def test_calendar_labels(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30),)], "x timestamp")
    r = df.select(SF.month_name("x").alias("m"), SF.month_short("x").alias("s"), SF.quarter_label("x").alias("q"),
                  SF.season("x").alias("se"), SF.dow_es("x").alias("d"), SF.iso_week("x").alias("w"),
                  SF.year_month("x").alias("ym")).first()
    assert (r.m, r.s, r.q, r.se, r.d, r.w, r.ym) == ("Diciembre", "Dic", "Q4", "Invierno", "Lunes", 1, "2024-12")


def test_nights_filled_uses_floor_of_days(spark):
    df = spark.createDataFrame([(None, dt.datetime(2024, 1, 1, 15), dt.datetime(2024, 1, 3, 10)),
                                ("3", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9))],
                               "n string, a timestamp, d timestamp")
    got = [r[0] for r in df.select(SF.nights_filled("n", F.col("a"), F.col("d"))).collect()]
    assert got == [1.0, 3.0]


def test_listing_price(spark):
    df = spark.createDataFrame([("513 € en total", 5), ("513 €", 5), ("8 €", 1), ("1.234,56 €", 1),
                                ("8 € en total", 3), (None, 2)], "t string, n int")
    got = [r[0] for r in df.select(SF.listing_price("t", "n")).collect()]
    assert got == [102, 513, None, 12345, None, None]


def test_rating_and_reviews(spark):
    df = spark.createDataFrame([("4,85 (203)",), ("(203 reseñas)",)], "t string")
    got = df.select(SF.rating_value("t"), SF.review_count("t")).collect()
    assert got[0][0] == 4.85 and got[1][1] == 203


def test_card_fields(spark):
    text = "Superanfitrión\nRefugio azul con vistas\n4,81 (113)\nCasa entera\n4 huéspedes\n58 € noche"
    df = spark.createDataFrame([(None, text, "/rooms/1"), ("Apartamento en Sitio", text, "http://x/1"),
                                ("Villa Sol", text, None)], "title string, text string, href string")
    got = df.select(SF.card_title("title", "text").alias("t"), SF.card_rating("text").alias("r"),
                    SF.card_reviews("text").alias("n"), SF.lodging_type("text").alias("k"),
                    SF.capacity("text").alias("c"), SF.absolute_url("href").alias("u")).collect()
    assert got[0].t == "Refugio azul con vistas" and got[1].t == "Refugio azul con vistas"
    assert got[2].t == "Villa Sol"
    assert (got[0].r, got[0].n, got[0].k, got[0].c) == (4.81, 113, "Casa entera", 4)
    assert [g.u for g in got] == ["https://www.airbnb.es/rooms/1", "http://x/1", ""]


def test_card_title_generic_longer_lines(spark):
    # no descriptive line: a longer generic line (> 15 chars) replaces the title
    text = "Apartamento en la playa grande\nCasa en X\nnoche 50"
    df = spark.createDataFrame([("Apartamento en Y", text)], "title string, text string")
    assert df.select(SF.card_title("title", "text")).first()[0] == "Apartamento en la playa grande"


def test_planner_functions(spark):
    df = spark.createDataFrame([("Apto Marina del Cid", " 03/10/2024 ", "2,7"), ("Casa Peñiscola", "2024-10-03", "x"),
                                ("Nowhere", "3-10-2024", None)], "p string, d string, n string")
    got = df.select(SF.detect_city("p"), F.to_date(SF.planner_date("d")), SF.nights_int("n")).collect()
    assert [g[0] for g in got] == ["Castellón de la Plana", "Peñíscola", None]
    assert all(g[1] == dt.date(2024, 10, 3) for g in got)
    assert [g[2] for g in got] == [2, 1, 1]


def test_stay_nights(spark):
    df = spark.createDataFrame([("2026-07-15", "2026-07-18"), ("2026-07-15", "2026-07-15"), ("bad", "2026-01-01")],
                               "a string, b string")
    assert [r[0] for r in df.select(SF.stay_nights("a", "b")).collect()] == [3, 1, 1]


@pytest.mark.parametrize("e,label", [(-0.2, 0), (-0.7, 1), (-1.5, 2)])
def test_elasticity_label(spark, e, label):
    from stayspark import schema as S
    assert spark.range(1).select(SF.elasticity_label(F.lit(e))).first()[0] == S.ELASTICITY_LABELS[label]


def test_py_title_matches_python(spark):
    words = ["o'neil-x", "hello world", "ÉCOLE du 3e", "x1y2z", ""]
    df = one_col(spark, words).select("x", SF.py_title("x").alias("y"))
    assert {r.x: r.y for r in df.collect()} == {w: w.title() for w in words}


def test_py_split_matches_python(spark):
    lines = ["  a  b\tc ", " x y　", "solo"]
    df = one_col(spark, lines).select("x", SF.py_split("x").alias("y"))
    assert {r.x: list(r.y) for r in df.collect()} == {s: s.split() for s in lines}


def test_dates_of_unknown_layouts(spark):
    """Layouts come from the shapes that a column has, the old fixed list's
    and others."""
    from stayspark.operators.clean import parse_dates
    t = dt.datetime
    cases = {
        "03/10/2024 10:30:05": t(2024, 10, 3, 10, 30, 5), "3/10/2024 9:05": t(2024, 10, 3, 9, 5), "03/10/2024": t(2024, 10, 3),
        "03-10-2024 10:30:05": t(2024, 10, 3, 10, 30, 5), "3-10-2024": t(2024, 10, 3), "2024-10-03 1:02:03": t(2024, 10, 3, 1, 2, 3),
        "2024-10-03T01:02:03": t(2024, 10, 3, 1, 2, 3), "2024-10-03": t(2024, 10, 3), "3.10.2024": t(2024, 10, 3), "03/10/24": t(2024, 10, 3), "29/02/96": t(1996, 2, 29),
        "20241003": t(2024, 10, 3), "3/10/2024 1:02:03 PM": t(2024, 10, 3, 13, 2, 3), "3/10/2024 1:02 AM": t(2024, 10, 3, 1, 2),
        "2024-10-03T01:02:03+02:00": t(2024, 10, 2, 23, 2, 3), "3 Oct 2024": t(2024, 10, 3), "3 October 2024": t(2024, 10, 3),
        "Oct 3, 2024": t(2024, 10, 3), "October 3, 2024": t(2024, 10, 3),
        # outside the list
        "2024/10/03 10:30": t(2024, 10, 3, 10, 30), "3-Oct-2024 08:15": t(2024, 10, 3, 8, 15), "2024.10.03": t(2024, 10, 3),
        "2024-10-03T01:02:03Z": t(2024, 10, 3, 1, 2, 3), "2024-10-03 01:02:03.250": t(2024, 10, 3, 1, 2, 3, 250000), "Thu, 3 Oct 2024 10:00:00": t(2024, 10, 3, 10),
        "3 10 2024": t(2024, 10, 3), "10/25/2024": t(2024, 10, 25), "  03.10.24 5:07 PM ": t(2024, 10, 3, 17, 7), "2024-10-03T01:02:03.5+0200": t(2024, 10, 2, 23, 2, 3, 500000),
        "soon": None, "": None, None: None, "99/99/2024": None, "31/02/2024": None, "1234": None, "12/2024": None, "Foo 3, 2024": None}
    df = one_col(spark, list(cases))
    got = {r.x: r.y for r in df.select("x", parse_dates(df, ["x"])["x"].alias("y")).collect()}
    assert got == cases


def test_money_keeps_its_rules(spark):
    cases = {"1.234,56 €": 1234.56, "$1,234.56": 1234.56, "99": 99.0, "12,5": 12.5, "1,234,567": 0.0, "-5.5": -5.5, "nan": 0.0, "": 0.0, " ": 0.0, None: 0.0,
             "abc": 0.0, "1 234.5": 1234.5, "EUR\u00a07": 7.0, "1.2.3": 0.0, "1.234.567,89": 1234567.89, "1,234,567.89": 1234567.89, "5-6": 0.0}
    df = one_col(spark, list(cases)).select("x", SF.clean_money("x").alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases
