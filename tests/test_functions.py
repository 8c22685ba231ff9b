"""Scalar functions by tables of cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspan.functions import fuzzy, geography, identifiers, periods, text


def apply(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_periods(spark):
    day = dt.date
    cases = {
        "1 w/e 12/28/24": (day(2024, 12, 22), day(2024, 12, 28), "weekly"),
        "Jun 21 - 5 w/e 07/26/25": (day(2025, 6, 22), day(2025, 7, 26), "multi_week"),
        "WE 01/25/2025": (day(2025, 1, 19), day(2025, 1, 25), "weekly"),
        "FY25 P01": (day(2025, 1, 1), day(2025, 1, 31), "monthly"),
        "Jan-25": (day(2025, 1, 1), day(2025, 1, 31), "monthly"),
        "2025 Feb": (day(2025, 2, 1), day(2025, 2, 28), "monthly"),
        "2025-01": (day(2025, 1, 1), day(2025, 1, 31), "monthly"),
        "25/01/2025": (day(2025, 1, 25), day(2025, 1, 25), "daily_date"),
        "2025-01-25 00:00:00": (day(2025, 1, 25), day(2025, 1, 25), "daily_date"),
        "2025": (day(2025, 1, 1), day(2025, 1, 1), "daily_date"),
        "20250125": (day(2025, 1, 25), day(2025, 1, 25), "daily_date"),
        "2025.03.05": (day(2025, 3, 5), day(2025, 3, 5), "daily_date"),
        "2025-01-25T08:00:00": (day(2025, 1, 1), day(2025, 1, 31), "monthly"),
        "Week Ending: 1/25/25": (day(2025, 1, 19), day(2025, 1, 25), "weekly"),
        "March 5, 2025": (day(2025, 3, 5), day(2025, 3, 5), "daily_date"),
        "Sep 7 2025": (day(2025, 9, 7), day(2025, 9, 7), "daily_date"),
        **dict.fromkeys(("13/25/2025", "Day 5, 2025", "hello", "", "nan", None, "202501", "45000", "Q1 2025", "12")),
    }
    got = apply(spark, periods.parse_period, cases)
    assert [tuple(g) if g else None for g in got] == list(cases.values())


def test_fiscal_pairs(spark):
    df = spark.createDataFrame([("2025", "2"), ("25", "13"), ("1980", "1"), (None, "1")], "y string, m string")
    assert [r.t and r.t.period_end for r in df.select(periods.fiscal_pair(F.col("y"), F.col("m")).alias("t")).collect()] == [dt.date(2025, 2, 28), None, None, None]


def test_upc(spark):
    cases = {"071800000211": "7180000021", "07180000021": "718000002", "7180000021X": "718000002", "71800000211.0": "7180000021", "0-71800-00021-1": "7180000021", "ABI-00001": None, "1234567": None, None: None, "00000000": "0000000"}
    got = dict(zip(cases, apply(spark, identifiers.upc_key, cases), strict=True))
    for k in ("071800000211", "07180000021", "7180000021X", "71800000211.0", "0-71800-00021-1", "ABI-00001", "1234567", None, "00000000"):
        assert got[k] == cases[k], k
    assert apply(spark, identifiers.is_pseudo_code, ["ABI-1", "123", None]) == [True, False, False]


def test_descriptions(spark):
    got = apply(spark, text.description_tokens, ["24PK12OZCAN", "2L BTL", "16.9 FL OZ", "no size", None])
    assert [tuple(g) for g in got] == [(24, 12.0, "OZ", "CAN"), (None, 2.0, "L", "BTL"), (None, 16.9, "FLOZ", None), (None, None, None, None), (None, None, None, None)]
    assert apply(spark, text.size_key, ["24PK12OZCAN", "2L BTL", "plain", None]) == ["24pk-12oz-can", "2l-btl", None, None]


def test_labels(spark):
    assert apply(spark, text.standardize, ["coca-cola o'neil", "WALMART STORES", "CVS", "McDonald", "  a  b ", None, " "]) == ["Coca-Cola O'Neil", "Walmart Stores", "CVS", "McDonald", "A B", None, None]
    assert apply(spark, text.is_total_like, ["National Account", "Overall", "Totally Fresh", "Boston", None]) == [True, True, False, False, False]
    assert apply(spark, text.norm_header, ["  POS_Sales ($)", "Item #"]) == ["pos sales $", "item #"]
    assert apply(spark, text.norm_brand, ["COKE  (The Company)", "Mtn Dew", "Other", "()", None]) == ["coca-cola", "mountain dew", "other", None, None]
    assert apply(spark, text.brand_from_description, ["The 12 Lime Fizz", "a", "123", None]) == ["lime", "a", None, None]
    assert apply(spark, text.customer_from_market, ["Publix Atlanta TA", "Total Publix", "Publix (x) TA", "total", "nan", None]) == ["Publix", "Publix", "Publix", "total", None, None]


@pytest.mark.parametrize(("a", "b", "want"), [("lime fizz", "fizz lime twelve", 100), ("", "x", 0), ("abcd", "abce", 75), ("new york", "new york city", 100), ("a b", "a c", 66.6667)])
def test_token_set(a, b, want):
    assert fuzzy.token_set_ratio(a, b) == pytest.approx(want, abs=1e-3)


def test_partial():
    assert fuzzy.partial_ratio("fizz", "lime fizz twelve") == 100 and fuzzy.partial_ratio("", "x") == 0
    assert fuzzy.lcs("abcde", "xaxcxe") == 3


def test_geography(spark):
    labels = ["Western NY Operating Area", "Mid-Atlantic", "Buffalo TA", "Washington", "Orlando", "salt lake boise", "walmart", None]
    got = {r.label: r for r in geography.expand(spark.createDataFrame([(x,) for x in labels], "m string"), "m").collect()}
    assert "NY" in got["Western NY Operating Area"].states
    assert "buffalo" in got["Western NY Operating Area"].part_cities
    assert got["Buffalo TA"].states == ["NY"] and got["Buffalo TA"].cities == ["buffalo"]
    assert got["Washington"].states == ["DC", "WA"] and got["Orlando"].states == ["FL"]
    assert got["salt lake boise"].cities == ["salt lake boise"] and got["walmart"].states == [] and None not in got
