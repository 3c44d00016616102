"""Weekday arithmetic against NumPy and against counting days."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotlog.functions import dates
from slotlog.plans.feature_jobs import AHEAD, AHEAD_LIVE, shift_business_days, snapshot_days

DAYS = st.dates(dt.date(1990, 1, 1), dt.date(2060, 12, 31))


def walk(d, n):
    step = 1 if n > 0 else -1
    left = abs(n)
    while left:
        d += dt.timedelta(days=step)
        left -= d.weekday() < 5
    return d


@settings(max_examples=8, deadline=None)
@given(pairs=st.lists(st.tuples(DAYS, DAYS), min_size=20, max_size=60))
def test_busday_count(spark, pairs):
    df = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a date, b date")
    got = df.select("a", "b", dates.busday_count(F.col("a"), F.col("b")).alias("n"),
                    dates.busday_count(F.col("b"), F.col("a")).alias("back")).collect()
    for a, b, n, back in got:
        assert n == np.busday_count(a, b)
        assert back == -n


@settings(max_examples=6, deadline=None)
@given(days=st.lists(DAYS, min_size=20, max_size=60), n=st.integers(1, 12))
def test_shift_business_days(spark, days, n):
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", dates.add_business_days(F.col("d"), n).alias("p"),
                    dates.subtract_business_days(F.col("d"), n).alias("m")).collect()
    for d, p, m in got:
        assert (p, m) == (walk(d, n), walk(d, -n))
        assert (shift_business_days(d, n), shift_business_days(d, -n)) == (p, m)


def test_snapshot_days_are_exactly_the_days_that_look_at_the_slot(spark):
    first = dt.date(2024, 1, 1)
    planned = [first + dt.timedelta(days=i) for i in range(28)]
    df = spark.createDataFrame([(d,) for d in planned], "d date")
    for ahead in (AHEAD, AHEAD_LIVE):
        for d, found in df.select("d", snapshot_days(F.col("d"), ahead).alias("s")).collect():
            looks = [x for x in (first + dt.timedelta(days=i) for i in range(-20, 40)) if x.weekday() < 5
                     and shift_business_days(x, ahead[0]) <= d <= shift_business_days(x, ahead[1])]
            assert sorted(found) == looks and len(found) <= 3


def test_days_ahead_is_floor_plus_one_after_clock_time(spark):
    rows = [(dt.datetime(2019, 1, 1, h), dt.datetime(2019, 1, d, p)) for h in (0, 8, 23) for d in (1, 2, 5) for p in (0, 9, 22)]
    df = spark.createDataFrame(rows, "m timestamp_ntz, p timestamp_ntz")
    for m, p, n in df.select("m", "p", dates.days_ahead(F.col("p"), F.col("m")).alias("n")).collect():
        assert n == (p - m).days + (p.time() < m.time())


def test_image_clock(spark):
    df = spark.createDataFrame([("20190105", "93012.5"), ("20190105", "130501"), ("20190105", "7")], "d string, t string")
    got = [r[0] for r in df.select(dates.image_clock(F.col("d"), F.col("t"))).collect()]
    assert got == [dt.datetime(2019, 1, 5, 9, 30, 12, 500000), dt.datetime(2019, 1, 5, 13, 5, 1), dt.datetime(2019, 1, 5, 0, 0, 7)]


def test_day_first(spark):
    df = spark.createDataFrame([("05.03.1994", "8:05"), ("2019-01-04", "09:00:00"), ("x", "y")], "d string, t string")
    got = [r[0] for r in df.select(dates.day_first(F.col("d"), F.col("t"))).collect()]
    assert got == [dt.datetime(1994, 3, 5, 8, 5), dt.datetime(2019, 1, 4, 9), None]


def test_time_of_day_is_right_closed(spark):
    df = spark.range(0, 24)
    got = dict(df.select(F.col("id"), dates.time_of_day(F.col("id"))).collect())
    assert [got[h] for h in (0, 9, 10, 12, 13, 14, 15, 17, 18, 23)] == [
        "early_morning", "early_morning", "late_morning", "late_morning", "lunchtime", "lunchtime", "afternoon", "afternoon",
        "evening", "evening"]
