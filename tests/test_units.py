import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthmill.operators.units import FLOOR_AREA, RENT_PER_MONTH, amounts, convert, readings, segment, unit_conflicts, with_common_unit

CASES = {
    "€1,300 per month": 1300,
    "EUR 1,825 monthly": 1825,
    "1350": 1350,
    "€300/fortnight": 650,
    "€300 every two weeks": 650,
    "€300 per 2 weeks": 650,
    "€105 per week": 455,
    "€120 pw": 520,
    "€12,000 p.a.": 1000,
    "€10.2k per year": 850,
    "1.9k pcm": 1900,
    "approx. 1.05 thousand euro a month": 1050,
    "€ 1.000,00 pcm": 1000,
    "9.999,99 € monthly": 9999.99,
    "EUR 16 daily": 16 * 365 / 12,
    "€16 per night": 16 * 365 / 12,
    "EUR 1650 every three months": 550,
    "€1,725 quarterly": 575,
    "410 euro a week, bills extra": 410 * 52 / 12,
    "€235 per week (€1,018 per month)": 235 * 52 / 12,
    "€162525 per month": 162525,
    "€1.225": 1225,
    "1 200 € p/m": 1200,
    "€２５０ per week": 250 * 52 / 12,
}


@pytest.mark.parametrize("text,value", CASES.items())
def test_rent_texts(text, value):
    assert convert(text, RENT_PER_MONTH) == pytest.approx(value, rel=1e-9)


@pytest.mark.parametrize("text", ["", None, "POA", "Price on application", "€", "£900 per month", "80 m2 per month"])
def test_no_amount(text):
    assert convert(text, RENT_PER_MONTH) is None


def test_field_prior_decides_what_m_means():
    assert convert("80 m2", FLOOR_AREA) == pytest.approx(80)
    assert convert("900 sq ft", FLOOR_AREA) == pytest.approx(900 * 0.3048**2)
    assert convert("€1200 pm", RENT_PER_MONTH) == pytest.approx(1200)


def test_readings_of_separators():
    assert {v for v, _ in readings("1.225")} == {1.225, 1225.0}
    assert {v for v, _ in readings("1,234,567")} == {1234567.0}
    assert {v for v, _ in readings("1.234,50")} == {1234.5}


def test_amounts_splits_two_quotes():
    assert [n for n, _ in amounts("€235 per week (€1,018 per month)")] == ["235", "1,018"]
    assert [n for n, _ in amounts("€300 every 2 weeks")] == ["300"]


@given(st.integers(100, 20000), st.sampled_from([("per month", 1), ("weekly", 52 / 12), ("p.a.", 1 / 12), ("/fortnight", 26 / 12), ("per quarter", 1 / 3), ("daily", 365 / 12)]))
@settings(max_examples=80, deadline=None)
def test_any_amount_and_period(n, period):
    assert convert(f"€{n:,} {period[0]}", RENT_PER_MONTH) == pytest.approx(n * period[1])


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_any_text_is_survived(text):
    v = convert(text, RENT_PER_MONTH)
    assert v is None or v >= 0


def test_long_text_is_survived():
    assert convert("x" * 20000 + " €900 per month", RENT_PER_MONTH) == pytest.approx(900)
    assert segment("per month")[0].dims


def test_operator_edges(spark):
    df = spark.createDataFrame(
        [(1, 1000.0, "€1,000 per month"), (2, 1000.0, "€1,021 per month"), (3, 1020.0, "€1,000 per month"), (4, None, "€5 pw"), (5, 5.0, None), (6, 5.0, ""), (7, 5.0, "POA"), (2, 1000.0, "€1,021 per month")],
        "id int, price double, price_raw string",
    ).selectExpr("*", "id AS common")
    assert sorted(r.id for r in unit_conflicts(df, "price", "price_raw").collect()) == [2, 2]
    assert with_common_unit(df, "price_raw", "m").columns == ["id", "price", "price_raw", "common", "m"]
    assert unit_conflicts(df.limit(0), "price", "price_raw").count() == 0
