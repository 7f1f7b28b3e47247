import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from daypanel.functions import (
    clamp_below,
    comma_text,
    cumsum_strict,
    cut_right,
    date_mdy,
    daily_per_100,
    doubling_time,
    flag_above,
    implied_thousands,
    not_in_set,
    num,
    num_comma,
    paste,
    repair_thousands,
    replace_first,
    round_even,
    serial_date,
    strip_chars,
    sum_or_zero,
    sum_strict,
    timestamp_ymd_hms,
    try_div,
    weekday_label,
)


def one(spark, expr, value=None, kind="double"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("a, b, want", [(1.0, 2.0, 0.5), (1.0, 0.0, None), (0.0, 0.0, None), (None, 1.0, None)])
def test_division_has_no_infinity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(try_div("a", "b").alias("y")).first()["y"] == want


def test_sums_and_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "x double, z double")
    got = df.agg(sum_strict("x").alias("a"), sum_or_zero("x").alias("b"), sum_or_zero("z").alias("c")).first()
    assert tuple(got) == (None, 1.0, 0.0)
    assert df.where("x is not null").agg(sum_strict("x").alias("a")).first()["a"] == 1.0


def test_running_sum_stays_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "i int, x double")
    got = df.select("i", cumsum_strict("x", Window.partitionBy(F.lit(1)).orderBy("i")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [1.0, None, None]


@pytest.mark.parametrize("value, want", [(-3.0, 0.0), (4.0, 4.0), (None, None)])
def test_clamp_keeps_missing(spark, value, want):
    assert one(spark, clamp_below("x", 0), value) == want


@pytest.mark.parametrize("cases, want", [(10, 0), (30, 2), (50, 2)])
def test_halves_go_to_even(spark, cases, want):
    assert one(spark, round_even(F.col("x") * 0.05), float(cases)) == want


@pytest.mark.parametrize(
    "value, want", [(-10.0, None), (-1.0, "falling"), (0.0, "flat"), (1.0, "flat"), (10.0, "rising"), (10.5, None), (None, None)]
)
def test_right_closed_bins(spark, value, want):
    assert one(spark, cut_right("x", (-10, -1, 1, 10), ("falling", "flat", "rising")), value) == want


def test_bin_labels(spark):
    breaks = (0, 500, 750, 1500)
    got = [one(spark, cut_right("x", breaks), v) for v in (0.0, 500.0, 750.0, 1500.0, 1600.0)]
    assert got == [None, "(0,500]", "(500,750]", "(750,1.5e+03]", None]


@pytest.mark.parametrize("value, want", [(1.234, 1234.0), (56.0, 56.0), (1.5, 1500.0), (None, None)])
def test_thousands(spark, value, want):
    assert one(spark, repair_thousands("x"), value) == want


@pytest.mark.parametrize("ratio, want", [(8.0, 1.0), (1.0, None), (0.0, None), (-1.0, None), (None, None), (0.5, -3.0)])
def test_doubling_time(spark, ratio, want):
    assert one(spark, F.round(doubling_time("x"), 9), ratio) == want


@pytest.mark.parametrize("value, want", [(21.0, "mittel"), (20.0, "gering"), (None, None)])
def test_flag(spark, value, want):
    assert one(spark, flag_above("x", 20, "mittel", "gering"), value) == want


def test_text(spark):
    assert one(spark, replace_first("x", ",", "."), "1,2,3", "string") == "1.2,3"
    assert one(spark, replace_first("x", "-", "0"), "-", "string") == "0"
    assert one(spark, replace_first("x", ".", "$1"), "a.b.c", "string") == "a$1b.c"
    assert one(spark, strip_chars("x", "- "), "a-b c", "string") == "abc"
    assert one(spark, num("x"), "abc", "string") is None
    assert one(spark, num_comma("x"), "1.234,5", "string") == 1234.5
    assert one(spark, paste("x", F.lit("b")), None, "string") == "NA b"


@pytest.mark.parametrize("value, want", [(1234.5, "1234,5"), (100.0, "100"), (0.0, "0"), (1e7, "1,0E7"), (1e-13, "1,0E-13"), (1e27, "1,0E27"), (0.1234567890123456, "0,1234567890123456"), (1.2345678901234e-05, "1,2345678901234E-5"), (-0.25, "-0,25"), (None, None)])
def test_comma_text(spark, value, want):
    assert one(spark, comma_text("x"), value) == want


def test_dates(spark):
    assert one(spark, date_mdy("x"), "1/22/20", "string") == dt.date(2020, 1, 22)
    assert one(spark, date_mdy("x"), "1/22/1995", "string") == dt.date(1995, 1, 22)
    assert one(spark, date_mdy("x"), "1/22/95", "string") == dt.date(1995, 1, 22)
    assert one(spark, date_mdy("x"), "22.1.20", "string") is None
    assert one(spark, serial_date("x"), "43922", "string") == dt.date(2020, 4, 1)
    assert one(spark, serial_date("x"), "Datum", "string") is None
    assert one(spark, timestamp_ymd_hms("x"), "2020-05-24 09:30:00", "string") == dt.datetime(2020, 5, 24, 9, 30)


def test_weekdays(spark):
    day = F.lit("2020-04-02").cast("date")
    assert one(spark, weekday_label(day)) == "Donnerstag"
    assert one(spark, weekday_label(day, "level_order")) == "Dienstag"
    with pytest.raises(ValueError):
        weekday_label(day, "other")


def test_density(spark):
    thousands = one(spark, implied_thousands(F.lit(1000), F.lit(200)))
    assert thousands == 500
    assert one(spark, daily_per_100(F.lit(50), F.lit(500))) == 0.01


def test_negated_membership_keeps_missing(spark, rows):
    df = spark.createDataFrame([("A",), ("Summe",), (None,)], "x string")
    assert rows(df.where(not_in_set("x", ("Summe", "Stadt")))) == [(None,), ("A",)]
