"""Feature sets for training and scoring, built point in time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlog import constants as K
from slotlog.functions import dates, rules, text
from slotlog.operators import cleaning, features, ordered, slots, status

FEATURE_COLUMNS: dict[str, slots.Aggregate] = {
    "NoShow": slots.smallest,
    "modality": slots.last,
    "occupation": slots.last,
    "reason": slots.last,
    "insurance_class": slots.last,
    "sex": slots.last,
    "age": slots.last,
    "age_sq": slots.last,
    "age_20_60": slots.last,
    "marital": slots.last,
    "post_code": slots.last,
    "distance_to_usz": slots.last,
    "distance_to_usz_sq": slots.last,
    "close_to_usz": slots.last,
    "times_rescheduled": slots.last,
    "start_time": slots.last,
    "Telefon": slots.last_or_zero,
}
LEAD_COLUMNS = ["sched_days_advanced", "sched_days_advanced_busday"]
AHEAD = (3, 5)
AHEAD_LIVE = (0, 2)


def _largest(value: Column, position: Column) -> Column:
    return F.max(value)


def outpatient(status_df: DataFrame) -> DataFrame:
    return status_df.filter(~rules.holds(F.col("patient_class_adj") == "inpatient"))


def _with_lead_times(df: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Lead time of the row's planned time on every row, next to the rows of the appointment (no join)."""
    changed = features.schedule_changed()
    return ordered.with_ordered(df, [*per, "FillerOrderNo", "now_sched_for_date"], status.message_order(df, "date"), {
        "sched_days_advanced": ordered.key_first(F.when(changed, F.col("now_sched_for"))),
        "sched_days_advanced_busday": ordered.key_first(F.when(changed, F.col("now_sched_for_busday"))),
    })


def _finish(df: DataFrame) -> DataFrame:
    df = features.add_calendar(features.lead_time_columns(df))
    return features.add_cycles(df)


def _usual_slots(df: DataFrame) -> DataFrame:
    """Weekdays, daytime, scheduled more than two days ahead."""
    hour = F.hour("start_time")
    return cleaning.on_weekdays(df).filter((F.col("sched_days_advanced") > 2) & (hour > 6) & (hour < 18))


def build_feature_set(status_df: DataFrame, valid_date_range, post_codes: DataFrame, site: str,
                      build_future_slots: bool = True, extra: dict[str, slots.Aggregate] | None = None,
                      per: Sequence[str] = (), patients: ordered.HotChunks | None = None) -> DataFrame:
    """One row per slot with its features. ``extra`` names further columns of the log to keep, ``patients`` the hot ones of the log."""
    df = outpatient(status_df)
    df = features.add_row_features(df, post_codes, site)
    # Lead times come first: the rescheduled count begins with the same order.
    df = status.times_rescheduled(_with_lead_times(df, per) if build_future_slots else df, per)
    columns = {**FEATURE_COLUMNS, **(extra or {})}
    if build_future_slots:
        columns.update({c: _largest for c in LEAD_COLUMNS})
        out = slots.build_slots(df, valid_date_range, columns, build_future_slots=True, per=per)
        out = out.filter(F.col("sched_days_advanced").isNotNull())
        out = features.lead_time_columns(out)
    else:
        out = slots.build_slots(df, valid_date_range, columns)
        out = features.add_days_advanced(df, out)
    out = features.add_no_show_before(features.add_calendar(out), per=per, patients=patients)
    return _usual_slots(features.add_cycles(out))


def _as_day(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10])


def shift_business_days(day: dt.date, n: int) -> dt.date:
    """Weekday arithmetic on one date of the caller (parameters, not data)."""
    step = 1 if n >= 0 else -1
    w = day.weekday()
    index = (min(w, 4) if step > 0 else min(w, 5)) + n if n else w
    if n == 0:
        return day
    return day - dt.timedelta(days=w) + dt.timedelta(days=7 * (index // 5) + index % 5)


def features_ahead(status_df: DataFrame, day, post_codes: DataFrame, site: str, live: bool = False,
                   per: Sequence[str] = (), patients: ordered.HotChunks | None = None) -> DataFrame:
    """Features as known before ``day`` for slots 3 to 5 (live: 0 to 2) weekdays ahead.

    Kept are slots that are still planned for that time. Appointments whose newest
    status is a cancellation more than three weekdays ahead are left out. ``day`` is a
    date, or a date column made from ``per`` that gives each log its own day.
    """
    n_lo, n_hi = AHEAD_LIVE if live else AHEAD
    if isinstance(day, Column):
        lo, hi = dates.add_business_days(day, n_lo), dates.add_business_days(day, n_hi)
    else:
        day = _as_day(day)
        lo, hi = shift_business_days(day, n_lo), shift_business_days(day, n_hi)
        day = F.lit(day)
    key = [*per, "FillerOrderNo"]
    seen = dates.as_date(F.col("date")) < day
    due = cleaning.within_dates(lo, hi, "now_sched_for_date")
    # One ordered pass for both: the log is read once and, coming from its own pass in this order, neither dealt nor sorted again.
    known = ordered.with_ordered(status_df, key, status.message_order(status_df, "date"), {
        "newest": ordered.key_last(F.when(seen, F.struct("now_status", "now_sched_for_date", "now_sched_for_busday"))),
        "is_due": ordered.key_first(F.when(due, True)),
    })
    known = known.filter(seen & F.col("is_due")).dropna("any", subset=key)
    known = known.filter(~_canceled_early("newest")).withColumn("newest_planned", F.col("newest.now_sched_for_date"))
    out = build_feature_set(known.drop("newest", "is_due"), [lo, hi], post_codes, site, extra={"newest_planned": slots.last}, per=per,
                            patients=patients)
    out = out.withColumn("NoShow", F.lit(False))
    current = out.filter(F.col("newest_planned") == F.col("start_time"))
    return cleaning.drop_any_null(current.withColumnRenamed("newest_planned", "now_sched_for_date"))


def _canceled_early(newest: str) -> Column:
    return rules.holds((F.col(newest + ".now_status") == "canceled") & (F.col(newest + ".now_sched_for_busday") > 3))


def snapshot_days(planned: Column, ahead: tuple[int, int] = AHEAD) -> Column:
    """The weekdays from which ``planned`` lies ``ahead`` weekdays away: at most three, computed from the date."""
    day = dates.as_date(planned)
    found = F.array(*[dates.subtract_business_days(planned, n) for n in range(ahead[0], ahead[1] + 1)])
    return F.filter(found, lambda d: (F.weekday(d) < 5) & (dates.add_business_days(d, ahead[0]) <= day)
                    & (day <= dates.add_business_days(d, ahead[1])))


def snapshots(status_df: DataFrame, first_day, last_day, post_codes: DataFrame, site: str,
              ahead: tuple[int, int] = AHEAD, chunks: ordered.HotChunks | None = None, finish: bool = True) -> DataFrame:
    """``features_ahead`` for every weekday from ``first_day`` to ``last_day`` at once, one ``snapshot`` column more.

    The log is not joined with a calendar or with itself. Running windows give the
    state of each slot after every row; a row stands for the snapshot days up to the
    next row, and a planned time has at most three of them. The newest status of the
    appointment on a snapshot day is looked up by one ordered pass over the rows and
    the snapshots together. Rows grow with the log, not with the days. Without ``finish``
    the columns that follow from the start time alone are left to the caller.
    """
    c = F.col
    order = status.message_order(status_df, "date")
    day = dates.as_date(c("date"))
    newest = F.struct("now_status", "now_sched_for_date", "now_sched_for_busday")

    rows = outpatient(status_df)
    rows = features.add_row_features(rows, post_codes, site)
    rows = status.times_rescheduled(rows)
    changed = features.schedule_changed()
    rows = ordered.with_ordered(rows, ["FillerOrderNo", "now_sched_for_date"], order, {
        "sched_days_advanced": ordered.first_value_so_far(F.when(changed, c("now_sched_for"))),
        "sched_days_advanced_busday": ordered.first_value_so_far(F.when(changed, c("now_sched_for_busday"))),
    })
    state = {n: (ordered.min_so_far(c(n)) if fn is slots.smallest else ordered.previous_value(c(n)))
             for n, fn in FEATURE_COLUMNS.items() if n != "start_time"}
    rows = ordered.with_ordered(rows, ["FillerOrderNo", "MRNCmpdId", "now_sched_for_date"], order,
                                {**state, "next_day": ordered.lead(day)})
    rows = rows.withColumns({"Telefon": F.coalesce(c("Telefon"), F.lit("0")), "start_time": c("now_sched_for_date")})

    first_day, last_day = F.lit(_as_day(first_day)), F.lit(_as_day(last_day))
    stands_for = F.filter(snapshot_days(c("now_sched_for_date"), ahead), lambda d: (
        (day < d) & (c("next_day").isNull() | (d <= c("next_day"))) & (d >= first_day) & (d <= last_day)))
    slot_columns = ["FillerOrderNo", "MRNCmpdId", *FEATURE_COLUMNS, *LEAD_COLUMNS]
    probes = rows.filter(c("now_sched_for_date").isNotNull() & c("MRNCmpdId").isNotNull()).select(
        *slot_columns, F.explode(stands_for).alias("snapshot"))
    probes = probes.withColumns({"at": c("snapshot").cast("timestamp_ntz"), "is_row": F.lit(0)})

    # A snapshot sees the rows of earlier days only: it goes before the rows of its own day.
    log = status_df.select("FillerOrderNo", c("date").alias("at"), F.lit(1).alias("is_row"), newest.alias("seen"),
                           *[x for x in order if x != "date"])
    if chunks:
        at = ["at", *[x for x in order if x != "date"]]  # a snapshot lacks what breaks ties and goes before all rows of its time
        probes, log = chunks.add(probes, at), chunks.add(log, at)
    both = probes.unionByName(log, allowMissingColumns=True)
    both = ordered.with_ordered(both, ["FillerOrderNo"], ["at", "is_row", *[x for x in order if x != "date"]],
                                {"newest": ordered.previous_value(c("seen"))})
    out = both.filter((c("is_row") == 0) & ~_canceled_early("newest"))

    # One slot per patient and time on each snapshot day.
    w = Window.partitionBy("snapshot", "MRNCmpdId", "start_time").orderBy(
        c("NoShow").asc_nulls_last(), text.reason_rank(c("reason")).asc_nulls_last(), c("FillerOrderNo"))
    out = out.withColumn("multi_slot", F.row_number().over(w)).filter("multi_slot = 1")
    out = out.filter(c("newest.now_sched_for_date") == c("start_time")).select(
        "snapshot", *slot_columns, dates.plus_minutes(c("start_time"), K.SLOT_MINUTES).alias("end_time"))
    out = cleaning.drop_any_null(_usual_slots(out).withColumn("NoShow", F.lit(False)))
    return _finish(out) if finish else out


@dataclass(frozen=True)
class LogChunks:
    """Hot appointments and hot patients of a log, found once and used by every job on it."""

    appointments: ordered.HotChunks | None = None
    patients: ordered.HotChunks | None = None


def find_log_chunks(log: DataFrame, time: str = "date", planned: str = "now_sched_for_date") -> LogChunks:
    """A small log is only counted; in a large one, sketches of narrow columns find the keys and a pass over their rows the borders.

    A patient has no more slots than rows in the log, so patients that are not hot here
    are not hot in any table made from it.
    """
    rows = log.count()
    return LogChunks(ordered.find_hot_chunks(log, ["FillerOrderNo"], status.message_order(log, time), at_most=rows),
                     ordered.find_hot_chunks(log, ["MRNCmpdId"], [planned, "FillerOrderNo"], at_most=rows))


def training_data(status_df: DataFrame, valid_date_range, post_codes: DataFrame, site: str,
                  append_outcome: bool = True, add_history: bool = True, chunks: LogChunks | None = None) -> DataFrame:
    """All slots of the period with the features known three to five weekdays before, and what came of them."""
    lo, hi = [_as_day(x) for x in valid_date_range]
    first_day = shift_business_days(lo, -5)
    chunks = chunks or find_log_chunks(status_df)
    log = status_df
    if chunks.appointments and not ordered.find_chunk(log, ["FillerOrderNo"]):
        log = chunks.appointments.add(log, status.message_order(log, "date"))
    out = snapshots(log, first_day, hi, post_codes, site, chunks=chunks.appointments, finish=False)
    out = cleaning.in_date_range(out, lo, hi)

    # All copies of a slot share the outcome, so reason and snapshot day decide which one stays.
    w = Window.partitionBy("MRNCmpdId", "start_time").orderBy(
        text.reason_rank(F.col("reason")).asc_nulls_last(), "snapshot", "FillerOrderNo")
    out = out.withColumn("multi_slot", F.row_number().over(w)).filter("multi_slot = 1").drop("multi_slot")
    if append_outcome:
        out = attach_outcome(out, slots.build_slots(log, [first_day, hi]))
    # Calendar columns come last: many aliases below a join make the optimizer slow.
    out = _finish(out)
    if add_history:
        out = features.add_no_show_before(out, patients=chunks.patients)
    return out


OUTCOME_COLUMNS = ["NoShow", "slot_outcome", "slot_type_detailed", "slot_type"]


def attach_outcome(df: DataFrame, actual_slots: DataFrame) -> DataFrame:
    """Outcome of the slot, or the mark of a slot that was moved in time."""
    known = actual_slots.select("MRNCmpdId", "start_time", *OUTCOME_COLUMNS)
    out = df.drop(*OUTCOME_COLUMNS).join(known, ["MRNCmpdId", "start_time"], "left")
    return out.withColumns({
        "NoShow": F.coalesce("NoShow", F.lit(False)),
        **{c: F.coalesce(c, F.lit("ok_rescheduled")) for c in OUTCOME_COLUMNS[1:]},
    })
