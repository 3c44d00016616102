"""Date and time expressions. All of them are Column -> Column and stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotlog import constants as K


def as_date(c: Column) -> Column:
    return c.cast("date")


def weekday_number(c: Column) -> Column:
    """0 is Monday."""
    return F.weekday(c)


def weekday_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def is_weekday(c: Column) -> Column:
    return F.weekday(c) < 5


def _weekdays_before(d: Column) -> Column:
    # 1970-01-05 was a Monday: whole weeks give 5 each, the rest at most 5.
    n = F.datediff(as_date(d), F.lit("1970-01-05").cast("date"))
    return F.floor(n / F.lit(7)) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def busday_count(begin: Column, end: Column) -> Column:
    """Weekdays in [begin, end); the negated count of [end, begin) when reversed."""
    return (_weekdays_before(end) - _weekdays_before(begin)).cast("long")


def days_ahead(planned: Column, message: Column) -> Column:
    """Calendar days from the message to the planned time."""
    return F.datediff(as_date(planned), as_date(message)).cast("long")


def _shift(c: Column, index: Column) -> Column:
    d = as_date(c)
    monday = F.date_sub(d, F.weekday(d))
    weeks = F.floor(index / F.lit(5)).cast("int")
    return F.date_add(monday, weeks * 7 + F.pmod(index, F.lit(5)).cast("int"))


def add_business_days(c: Column, n: int) -> Column:
    """The date ``n`` weekdays later; a weekend date counts from the Friday before it."""
    if n <= 0:
        return as_date(c)
    return _shift(c, F.least(F.weekday(as_date(c)), F.lit(4)) + F.lit(n))


def subtract_business_days(c: Column, n: int) -> Column:
    """The date ``n`` weekdays earlier; a weekend date counts from the Monday after it."""
    if n <= 0:
        return as_date(c)
    return _shift(c, F.least(F.weekday(as_date(c)), F.lit(5)) - F.lit(n))


def minutes_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(60.0)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def plus_minutes(c: Column, minutes) -> Column:
    m = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return F.timestamp_add("MINUTE", m, c)


def plus_microseconds(c: Column, us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, c)


def at_seconds(day: Column, seconds: Column) -> Column:
    """A date combined with a second of the day."""
    return F.timestamp_add("SECOND", seconds, as_date(day).cast("timestamp_ntz"))


def day_first(date_text: Column, time_text: Column | None = None) -> Column:
    """Day-first or ISO date text with an optional time of day; unreadable text gives null."""
    if time_text is None:
        value, formats = date_text, ["d.M.yyyy"]
    else:
        value, formats = F.concat_ws(" ", date_text, time_text), ["d.M.yyyy H:mm", "d.M.yyyy H:mm:ss"]
    read = [F.try_to_timestamp(value, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*read, value.try_cast("timestamp_ntz"))


def image_clock(day: Column, clock: Column) -> Column:
    """``yyyyMMdd`` and a numeric ``HHMMSS.ffffff`` whose leading zeros may be missing."""
    padded = F.lpad(F.format_string("%.6f", clock.cast("double")), 13, "0")
    return F.to_timestamp(F.concat(day.cast("string"), padded), "yyyyMMddHHmmss.SSSSSS").cast("timestamp_ntz")


def age_years(at: Column, birth: Column) -> Column:
    return (F.year(at) - F.year(birth)).cast("long")


def time_of_day(hour: Column) -> Column:
    out = None
    for upper, label in K.TIME_OF_DAY_BINS:
        out = F.when((hour > -1) & (hour <= upper), label) if out is None else out.when(hour <= upper, label)
    return out


def cycle(c: Column, period: float, offset: int = 0) -> tuple[Column, Column]:
    angle = (c - F.lit(offset)) * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)
