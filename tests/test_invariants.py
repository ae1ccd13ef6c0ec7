"""Independent checks: pandas recomputation from the same cleaned rows,
invariants, and a property test of the money rule."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from stayspark import functions as SF
from stayspark.operators import summary as SM
from stayspark.plans import fixtures as FX
from tests.conftest import SF_SMALL


def _bookings_pdf(spark):
    cols = ["month", "channel", "amount", "nights", "price_per_night", "year", "property", "year_month"]
    return FX.bookings(spark, SF_SMALL).select(*cols).toPandas()


def test_monthly_summary_matches_pandas(spark):
    pdf = _bookings_pdf(spark)
    want = pdf.groupby("month").agg(reservas=("amount", "count"), ingresos=("amount", "sum"),
                                    ppn_medio=("price_per_night", "mean"))
    got = SM.monthly_summary(FX.bookings(spark, SF_SMALL)).toPandas().set_index("month")
    assert list(got.index) == sorted(want.index)
    assert (got["reservas"] == want["reservas"]).all()
    assert ((got["ingresos"] - want["ingresos"]).abs() <= 0.0051).all()
    assert ((got["ppn_medio"] - want["ppn_medio"]).abs() <= 0.0051).all()
    assert abs(got["pct_ingresos"].sum() - 100) <= 0.05 * len(got)


def test_channel_and_heatmap_invariants(spark):
    b = FX.bookings(spark, SF_SMALL)
    ch = SM.channel_summary(b).toPandas()
    assert ch["ingresos"].is_monotonic_decreasing
    assert (ch["ingresos_netos"] <= ch["ingresos"]).all()
    heat = SM.monthly_heatmap(b).toPandas()
    assert heat.drop(columns="year").to_numpy().sum() == b.count()


def money_rule(s):
    """The money rule restated from its description (FIXTURES.md §3)."""
    if s is None:
        return 0.0
    s = s.strip()
    if not s or s == "nan":
        return 0.0
    if "." in s and "," in s:
        s = s.replace(".", "").replace(",", ".") if s.find(".") < s.find(",") else s.replace(",", "")
    elif "," in s:
        s = s.replace(",", ".")
    s = re.sub(r"[^0-9.\-]", "", s)
    try:
        return float(s)
    except ValueError:
        return 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.,- €$EUR", max_size=12), min_size=200, max_size=200))
def test_clean_money_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(SF.clean_money("x")).collect()]
    want = [money_rule(t) for t in texts]
    # Python float() also takes forms like "1_0" or "inf"; the alphabet avoids them
    assert got == want
