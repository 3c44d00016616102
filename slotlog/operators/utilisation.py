"""Machine time: opening hours, gaps between appointments, buffers, and their totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlog import constants as K
from slotlog.functions import dates, text
from slotlog.operators import ordered
from slotlog.session import cut_lineage

MACHINE_DAY = ["date", "image_device_id"]
SMALL_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint only after counting; a larger table is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------- calendar

def opening_hours(raster: DataFrame) -> DataFrame:
    """Bookable raster to opening hours per device, weekday and validity period."""
    c = F.col
    start = F.hour(F.to_timestamp(c("Termin"), "HH:mm")) * 3600 + F.minute(F.to_timestamp(c("Termin"), "HH:mm")) * 60
    df = raster.select(
        F.coalesce(text.recode(c("Terminbuch"), {k: str(v) for k, v in K.BOOK_DEVICE.items()}),
                   c("Terminbuch")).try_cast("int").alias("image_device_id"),
        F.coalesce(text.recode(c("Wochentag"), K.WEEKDAY_CODE), c("Wochentag")).alias("day_of_week"),
        c("TERMINRASTER_NAME"),
        dates.day_first(F.coalesce(c("`gültig von`"), F.lit(K.VALID_FROM_DEFAULT))).alias("applicable_from"),
        dates.day_first(F.coalesce(c("`gültig bis`"), F.lit(K.VALID_TO_DEFAULT))).alias("applicable_to"),
        start.alias("start_s"),
        # A raster time that ends after midnight wraps, as a time of day does.
        F.pmod(start + c("`Dauer in Min.`") * 60, F.lit(86400)).alias("end_s"),
        c("`Dauer in Min.`").alias("minutes"),
    )
    return df.groupBy("image_device_id", "day_of_week", "TERMINRASTER_NAME", "applicable_from", "applicable_to").agg(
        F.min("start_s").cast("int").alias("day_start_tp"), F.max("end_s").cast("int").alias("day_end_tp"),
        F.sum("minutes").cast("long").alias("day_length_tp"))


def fill_calendar(hours: DataFrame, as_of: dt.date) -> DataFrame:
    """Extend the earliest period back to the calendar start and the latest one forward, per raster."""
    c = F.col
    key = ["image_device_id", "day_of_week", "TERMINRASTER_NAME"]
    limit = dt.datetime(as_of.year + K.CALENDAR_YEARS_AHEAD, 12, 31)
    end = F.lit(limit).cast("timestamp_ntz")
    g = Window.partitionBy(*key)
    same = F.count(F.lit(1)).over(Window.partitionBy(*key, "applicable_from")) == 1
    marked = hours.withColumns({
        "is_first": (c("applicable_from") == F.min("applicable_from").over(g)) & same,
        "is_last": (c("applicable_from") == F.max("applicable_from").over(g)) & same & (c("applicable_to") < end),
    })
    period = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    periods = F.array_compact(F.array(
        period(c("applicable_from"), c("applicable_to")),
        F.when(c("is_first"), period(F.lit(K.CALENDAR_START).cast("timestamp_ntz"),
                                     c("applicable_from") - F.expr("interval 1 day"))),
        F.when(c("is_last"), period(c("applicable_to") + F.expr("interval 1 day"), end)),
    ))
    return marked.withColumn("p", F.explode(periods)).withColumns(
        {"applicable_from": c("p.lo"), "applicable_to": c("p.hi")}).drop("p", "is_first", "is_last")


# ---------------------------------------------------------------- gaps

def with_day(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("date", F.date_trunc("day", "image_start").cast("timestamp_ntz"))


def join_calendar(intervals: DataFrame, hours: DataFrame) -> DataFrame:
    """Opening hours of the appointment's device and weekday in the period that holds on its day.

    Periods are closed at midnight of their last day.
    """
    c = F.col
    df = with_day(intervals).withColumn("day_of_week", dates.weekday_name(c("image_start"))).filter(
        dates.is_weekday(c("image_start")))
    h = broadcast_if_small(hours.withColumnsRenamed({"image_device_id": "h_device", "day_of_week": "h_day"}))
    on = ((c("image_device_id") == c("h_device")) & (c("day_of_week") == c("h_day"))
          & (c("image_start") >= c("applicable_from")) & (c("image_start") <= c("applicable_to")))
    return df.join(h, on).drop("h_device", "h_day", "applicable_from", "applicable_to").withColumns({
        "day_start_tp": dates.at_seconds(c("date"), c("day_start_tp")),
        "day_end_tp": dates.at_seconds(c("date"), c("day_end_tp")),
    })


def _microseconds(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def idle_gaps(intervals: DataFrame, hours: DataFrame, buffer_minutes: int = 0, split_hot: bool = False) -> DataFrame:
    """Appointments within opening hours with the end before them and the buffered borders of the gap.

    The last appointment of a machine day that ends early gets one more row at closing
    time. It always sorts last, so it is made from that appointment directly instead of
    a union and a second window pass.
    """
    c = F.col
    if split_hot:
        # Stored first: counting it, and looking for hot machine days in a large one, does not run what it is made of again.
        intervals = cut_lineage(with_day(intervals), "intervals")
        intervals = ordered.split_hot_keys(intervals, MACHINE_DAY, ["image_start", "AccessionNumber"])
    df = join_calendar(intervals, hours)
    df = df.filter((c("image_end") > c("day_start_tp")) & (c("image_start") < c("day_end_tp"))).withColumn(
        "within_day", F.lit(1))
    df = ordered.with_ordered(df, MACHINE_DAY, ["image_start", "AccessionNumber"], {
        "lag_start": ordered.lag(c("image_start")),
        "lead_start": ordered.lead(c("image_start")),
        "previous_end_shift": ordered.lag(c("image_end")),
    }).drop(ordered.chunk_column(MACHINE_DAY))
    # Mean ranks: with two equal starts at the edge neither is the first or the last.
    is_first = c("lag_start").isNull() & (c("lead_start").isNull() | (c("lead_start") > c("image_start")))
    is_last = c("lead_start").isNull() & (c("lag_start").isNull() | (c("lag_start") < c("image_start")))
    late_start = c("image_start") > c("day_start_tp")
    early_end = c("image_end") < c("day_end_tp")
    df = df.withColumns({
        "first_appt": is_first.cast("int"), "last_appt": is_last.cast("int"),
        "one_side_buffer_flag": ((is_last & ~early_end) | (is_first & ~late_start)).cast("int"),
        "previous_end": F.when(is_first & late_start, c("day_start_tp")).when(
            c("previous_end_shift") < c("image_start"), c("previous_end_shift")),
        "is_closing": F.lit(False),
    })
    row = {n: c(n) for n in ("AccessionNumber", "image_start", "image_end", "previous_end_shift", "previous_end",
                             "first_appt", "last_appt", "one_side_buffer_flag", "is_closing")}
    null = lambda n, t: F.lit(None).cast(t)
    closing = {
        "AccessionNumber": null("AccessionNumber", dict(df.dtypes)["AccessionNumber"]),
        "image_start": c("day_end_tp"), "image_end": c("day_end_tp"),
        "previous_end_shift": c("image_end"), "previous_end": c("image_end"),
        "first_appt": null("first_appt", "int"), "last_appt": null("last_appt", "int"),
        "one_side_buffer_flag": F.lit(1), "is_closing": F.lit(True),
    }
    struct = lambda cols: F.struct(*[v.alias(n) for n, v in cols.items()])
    rows = F.array_compact(F.array(struct(row), F.when(is_last & early_end, struct(closing))))
    df = df.withColumn("r", F.explode(rows)).drop(*row, "lag_start", "lead_start").select(
        *[x for x in df.columns if x not in row and x not in ("lag_start", "lead_start")], "r.*")

    between = _microseconds(c("previous_end"), c("image_start"))
    half = F.floor(F.when(between.isNotNull(), F.least(between, F.lit(2 * buffer_minutes * 60_000_000))) / 2).cast("long")
    df = df.withColumns({"time_between_appt": between / F.lit(3.6e9), "half_buffer": half})
    shift = dates.plus_microseconds
    return df.withColumns({
        "previous_end_buffer": F.when((c("one_side_buffer_flag") == 0) & (c("first_appt") == 1), c("previous_end"))
        .otherwise(shift(c("previous_end"), c("half_buffer"))),
        "image_start_buffer": F.when(c("is_closing"), c("image_start"))
        .otherwise(shift(c("image_start"), -c("half_buffer"))),
    }).drop("half_buffer", "is_closing")


def appts_and_gaps(gaps: DataFrame) -> DataFrame:
    """One row per active, idle and buffer interval, from one pass over the gap table."""
    c = F.col
    part = lambda s, a, b: F.struct(F.lit(s).alias("status"), c(a).alias("start"), c(b).alias("end"))
    same_day = lambda a, b: dates.as_date(c(a)) == dates.as_date(c(b))
    pieces = F.array_compact(F.array(
        part("active", "image_start", "image_end"),
        F.when(same_day("previous_end_buffer", "image_start_buffer"),
               part("idle", "previous_end_buffer", "image_start_buffer")),
        F.when(same_day("previous_end", "previous_end_buffer"), part("buffer", "previous_end", "previous_end_buffer")),
        F.when(same_day("image_start_buffer", "image_start"), part("buffer", "image_start_buffer", "image_start")),
    ))
    out = gaps.filter("within_day = 1").select("date", "image_device_id", F.explode(pieces).alias("p")).select(
        "date", "image_device_id", "p.start", "p.end", "p.status")
    return out.withColumn("status_duration", dates.hours_between(c("start"), c("end")))


def daily_stats(pieces: DataFrame) -> DataFrame:
    """Hours per machine day. Overlaps count once: active is the day less buffer and idle time.

    A day without any idle or any buffer interval has no active time (null), as no
    total can be told for it.
    """
    c = F.col
    hours = lambda s: F.sum(F.when(c("status") == s, c("status_duration")))
    out = pieces.groupBy(*MACHINE_DAY).agg(
        hours("buffer").alias("buffer"), hours("idle").alias("idle"), F.min("start").alias("start"),
        F.max("end").alias("end"))
    out = out.withColumn("total_time", F.least(dates.hours_between(c("start"), c("end")), F.lit(24.0)))
    return _shares(out.withColumn("active", c("total_time") - c("buffer") - c("idle")))


def _shares(df: DataFrame) -> DataFrame:
    total = F.nullif(F.col("total_time"), F.lit(0.0))
    return df.withColumns({s + "_pct": F.col(s) / total for s in ("active", "buffer", "idle")})


def period_stats(daily: DataFrame, grain: str) -> DataFrame:
    """Daily hours summed by ``month`` or ``year`` and device."""
    key = F.date_trunc("month", "date").cast("timestamp_ntz") if grain == "month" else F.year("date").cast("long")
    sums = [F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in ("active", "buffer", "idle", "total_time")]
    return _shares(daily.groupBy(key.alias(grain), "image_device_id").agg(*sums))


def melt_stats(stats: DataFrame, time_column: str, shares: bool = True) -> DataFrame:
    """Wide totals to long rows with a readable machine status."""
    names = [s + ("_pct" if shares else "") for s in ("active", "idle", "buffer")]
    labels = dict(zip(names, ("Active", "Idle", "Buffer")))
    out = stats.unpivot([time_column, "image_device_id"], names, "metric", "hours")
    return out.withColumn("machine_status", text.recode(F.col("metric"), labels)).drop("metric")
