from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hearthmill.functions import arrays, datetimes, numbers, strings


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("co-operative o'neill", "Co-Operative O'Neill"), ("ISLE OF MAN 2nd", "Isle Of Man 2nd"), ("", ""), (None, None)])
def test_initcap(spark, text, want):
    assert one(spark, strings.initcap_words(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("€1,500 per month", 1500.0), ("", None), ("POA", None), ("1.2.3", None), (None, None)])
def test_digits_to_double(spark, text, want):
    assert one(spark, strings.digits_to_double(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("2 bed", 2), ("Studio", None), ("99999999999", None)])
def test_digits_to_int(spark, text, want):
    assert one(spark, strings.digits_to_int(F.lit(text))) == want


def test_first_contained_and_literals(spark):
    assert one(spark, strings.first_contained(F.lit("Mullingar, Westmeath"), ["Meath", "Westmeath"])) == "Meath"
    assert one(spark, strings.first_contained(F.lit("nowhere"), ["Meath"], F.lit("none"))) == "none"
    assert strings.quoted("o'neill") == "'o''neill'"
    assert one(spark, strings.concat_nulls_empty(F.lit("a"), F.lit(None), F.lit("b"))) == "ab"


def test_surrogate_key_tells_null_from_empty(spark):
    a, b = one(spark, strings.surrogate_key(F.lit(None), F.lit("x"))), one(spark, strings.surrogate_key(F.lit(""), F.lit("x")))
    assert a != b and len(a) == 32


@pytest.mark.parametrize(
    "part,a,b,want",
    [
        ("month", "2024-01-31", "2024-02-01", 1),
        ("week", "2024-05-04", "2024-05-06", 1),
        ("week", "2024-05-06", "2024-05-04", -1),
        ("week", "2024-05-13", "2024-05-06", -2),
        ("millisecond", "2024-01-01 00:00:00.0009", "2024-01-01 00:00:01", 1000),
        ("year", "2023-12-31", "2024-01-01", 1),
        ("quarter", "2024-03-31", "2024-04-01", 1),
        ("day", "2024-02-28", "2024-03-01", 2),
        ("hour", "2024-01-01 00:59:59", "2024-01-01 01:00:00", 1),
        ("minute", "2024-01-01 00:59:59", "2024-01-01 01:00:00", 1),
        ("second", "2024-01-01 00:59:59", "2024-01-01 01:00:00", 1),
        ("microsecond", "2024-01-01", "2024-01-01 00:00:01", 1_000_000),
    ],
)
def test_boundaries(spark, part, a, b, want):
    ts = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, datetimes.boundaries(part, ts(a), ts(b))) == want


def test_boundaries_unknown_part():
    with pytest.raises(ValueError):
        datetimes.boundaries("century", None, None)


def test_date_helpers(spark):
    d = F.lit("2024-02-29").cast("date")
    assert one(spark, datetimes.add("year", 1, d)) == datetime(2025, 2, 28)
    assert one(spark, datetimes.add("hour", 5, d)) == datetime(2024, 2, 29, 5)
    assert one(spark, datetimes.last_of("quarter", d)) == date(2024, 3, 31)
    assert one(spark, datetimes.dow0(d)) == 4
    assert one(spark, datetimes.padded(d, "MMMM")) == "February "
    assert [one(spark, datetimes.year_of_period(F.lit(x))) for x in ("2024", "202403", "2024Q1", "x")] == [2024, 2024, 2024, None]
    assert datetimes.dates_between("20240228", "20240301") == ["20240228", "20240229", "20240301"]
    with pytest.raises(ValueError):
        datetimes.dates_between("20240301", "20240228")
    assert datetimes.months_of(date(2024, 1, 15), date(2024, 3, 1))[-1] == (date(2024, 3, 1), date(2024, 4, 1))


def test_numbers(spark):
    assert [one(spark, numbers.to_int(F.lit(x))) for x in (2.5, -2.5, 2.4)] == [3, -3, 2]
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, numbers.percent_change(F.lit(110.0), F.lit(100.0))) == pytest.approx(10)
    assert one(spark, numbers.nth_of_grid(F.lit(-6.2603))) == -627
    assert one(spark, numbers.safe_cast(F.lit("x"), "int")) is None


def test_arrays(spark):
    assert one(spark, arrays.typed_array()) == []
    assert one(spark, arrays.ordered_keys(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(0)))) == ["a", "b"]
    labels = F.create_map(F.lit("A"), F.lit("Alpha"))
    assert [one(spark, arrays.label_or_code(labels, F.lit(x))) for x in "AB"] == ["Alpha", "B"]
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "x string")
    assert df.agg(arrays.list_aggregate(F.col("x"), limit=2).alias("t")).first().t == "a,b"
