"""Date grammars F1–F3, loose casts F14, falsy strings T17."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from checkwise.functions.dates import (csv_date, default_window, history_date, parse_report_date,
                                       php_trim, submission_date, us_date)
from checkwise.functions.text import falsy_to_null, leading_int, leading_number, trimmed_or_null

D = dt.date(2026, 4, 20)


def _dates(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [(r.d.shape_ok, r.d.value) for r in df.select(fn(F.col("s")).alias("d")).collect()]


def test_submission_date(spark):
    assert _dates(spark, submission_date, ["04-20-2026", "2026-04-20", "04/20/2026", "13-45-2026"]) == \
        [(True, D), (True, D), (False, None), (True, None)]


def test_history_date(spark):
    assert _dates(spark, history_date, ["04/20/2026", " 04-20-2026 ", "04/20-2026", "4/20/2026", "n/a"]) == \
        [(True, D), (True, D), (True, D), (False, None), (False, None)]


def test_csv_date(spark):
    got = _dates(spark, csv_date, ["4/20/2026", "46132", "46132.7", "40000", "4/20/2026 9:15", "", "2/30/2026"])
    assert got == [(True, D), (True, D), (True, D), (False, None), (False, None), (False, None), (True, None)]


def test_report_date_param():
    assert parse_report_date("04-20-2026") == D
    assert parse_report_date("2026-04-20") == D
    with pytest.raises(ValueError):
        parse_report_date("04/20/2026")
    with pytest.raises(ValueError):
        parse_report_date("2026-02-30")


def test_leading_number_and_int(spark):
    df = spark.createDataFrame([("2,5 kg",), ("abc",), (None,), ("3 pts",), ("-1.5e1x",), (".5",)], "s string")
    got = [(r.n, r.i) for r in df.select(leading_number(F.col("s"), 1.0).alias("n"),
                                         leading_int(F.col("s")).alias("i")).collect()]
    assert got == [(2.0, 2), (0.0, 0), (1.0, 0), (3.0, 3), (-15.0, -1), (0.5, 0)]


def test_falsy_and_trim(spark):
    df = spark.createDataFrame([(" late ",), ("0",), ("",), (None,), ("\t0 ",)], "s string")
    got = [(r.a, r.b, r.c) for r in df.select(trimmed_or_null(F.col("s")).alias("a"),
                                              falsy_to_null(F.col("s")).alias("b"),
                                              php_trim(F.col("s")).alias("c")).collect()]
    assert got == [("late", " late ", "late"), (None, None, "0"), (None, None, ""),
                   (None, None, None), (None, "\t0 ", "0")]


def test_us_date_and_default_window(spark):
    df = spark.createDataFrame([(D,)], "d date")
    assert df.select(us_date(F.col("d"))).collect()[0][0] == "04-20-2026"
    assert default_window(D) == (dt.date(2026, 4, 1), D)
