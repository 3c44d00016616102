"""The status log: one row per status change, with what it changed from and what it means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlog import constants as K
from slotlog.functions import rules, text
from slotlog.functions.dates import busday_count, days_ahead
from slotlog.operators import cleaning, ordered

KEY = ["FillerOrderNo"]


def message_order(df: DataFrame, time: str = "History_MessageDtTm") -> list[str]:
    """Message time, then the position at which the row was read, so that ties keep their input order."""
    return [time] + (["ingest_seq"] if "ingest_seq" in df.columns else [])


def previous_state(df: DataFrame) -> dict[str, ordered.Ordered]:
    return {
        "prev_status": ordered.lag(F.col("History_OrderStatus")),
        "was_sched_for_date": ordered.lag(F.col("History_ObsStartPlanDtTm")),
    }


def derive_change_columns(df: DataFrame) -> DataFrame:
    """Row-wise columns on top of the previous status and the previous planned time."""
    message, planned, was = F.col("History_MessageDtTm"), F.col("History_ObsStartPlanDtTm"), F.col("was_sched_for_date")
    return df.withColumns({
        "date": message,
        "was_status": rules.status_text(F.col("prev_status")),
        "now_status": rules.status_text(F.col("History_OrderStatus")),
        "now_sched_for_date": planned,
        "was_sched_for": days_ahead(was, message),
        "now_sched_for": days_ahead(planned, message),
        "now_sched_for_busday": busday_count(message, planned),
    })


def add_change_columns(df: DataFrame) -> DataFrame:
    """Previous status and planned time per appointment, lead times, status texts."""
    return derive_change_columns(ordered.with_ordered(df, KEY, message_order(df), previous_state(df)))


def add_first_created(df: DataFrame) -> DataFrame:
    return ordered.with_ordered(df, KEY, message_order(df, "date"), {"first_created_date": ordered.key_min(F.col("date"))})


def add_final_planned(df: DataFrame) -> DataFrame:
    return ordered.with_ordered(
        df, KEY, message_order(df, "date"),
        {"final_now_sched_for_date": ordered.key_last(F.col("now_sched_for_date"))})


def label_changes(df: DataFrame) -> DataFrame:
    """No-show flag, severity, slot type and outcome of every change."""
    c = F.col
    out = df.withColumn("patient_class_adj", rules.patient_class(c("PatientClass")))
    out = out.withColumn("NoShow", rules.no_show(
        c("date"), c("was_status"), c("now_status"), c("was_sched_for_date"), c("first_created_date"),
        c("patient_class_adj")))
    out = out.withColumns({
        "NoShow_severity": rules.severity(c("NoShow"), c("date"), c("was_sched_for_date")),
        "slot_type": rules.slot_type(c("NoShow"), c("OrderStatus"), c("now_status"), c("patient_class_adj")),
    })
    return out.withColumns({
        "slot_outcome": rules.slot_outcome(
            c("slot_type"), c("now_status"), c("final_now_sched_for_date"), c("was_sched_for_date")),
        "slot_type_detailed": rules.slot_type_detailed(c("slot_type"), c("NoShow_severity")),
    })


def build_status_log(raw: DataFrame, exclude_patient_ids: Sequence[str] | DataFrame = (),
                     id_suffix: str = K.PATIENT_ID_SUFFIX, per: Sequence[str] = ()) -> DataFrame:
    """Raw export rows to labelled status changes.

    ``per`` names columns that keep logs apart, such as the file a row came from.

    All per-appointment columns come from one window pass, hence one exchange
    on the appointment number. Rows of test patients still count as a previous
    status, but not for the first and last planned time.
    """
    df = cleaning.cast_datetime_columns(raw)
    df = cleaning.drop_irrelevant_services(cleaning.keep_relevant_machines(df))
    df = df.withColumn("MRNCmpdId", text.strip_suffix(F.col("MRNCmpdId"), id_suffix))
    listed = isinstance(exclude_patient_ids, DataFrame)
    if listed:
        name = exclude_patient_ids.columns[0]
        marks = exclude_patient_ids.select(F.col(name).cast("string").alias("MRNCmpdId"),
                                           F.lit(True).alias("is_test")).distinct()
        df = df.join(marks, "MRNCmpdId", "left")
        test = rules.holds(F.col("is_test")) | F.col("MRNCmpdId").contains("_")
    else:
        test = F.col("MRNCmpdId").contains("_")
        if exclude_patient_ids:
            test = test | F.col("MRNCmpdId").isin(list(exclude_patient_ids))
    real = ~test
    df = ordered.with_ordered(df, [*per, *KEY], message_order(df), {
        **previous_state(df),
        "first_created_date": ordered.key_min(F.when(real, F.col("History_MessageDtTm"))),
        "final_now_sched_for_date": ordered.key_last(F.when(real, F.col("History_ObsStartPlanDtTm"))),
    })
    df = derive_change_columns(df.filter(real))
    df = df.drop("is_test") if listed else df
    return cleaning.drop_unchanged(label_changes(df))


def last_status(df: DataFrame, columns: Sequence[str] = ("MRNCmpdId", "now_status", "now_sched_for_date",
                                                         "now_sched_for_busday")) -> DataFrame:
    """The newest status of every appointment; a partial maximum per task comes before the shuffle."""
    position = F.struct(*[F.col(c) for c in message_order(df, "date")])
    newest = F.max_by(F.struct(*columns), position)
    return df.groupBy("FillerOrderNo").agg(newest.alias("s")).select("FillerOrderNo", "s.*")


def canceled_early(last: DataFrame, days: int = 3) -> DataFrame:
    """Appointments whose newest status is a cancellation more than ``days`` weekdays ahead."""
    return last.filter((F.col("now_status") == "canceled") & (F.col("now_sched_for_busday") > days)).select(
        "FillerOrderNo")


def drop_canceled_early(df: DataFrame, days: int = 3) -> DataFrame:
    return df.join(canceled_early(last_status(df), days), "FillerOrderNo", "left_anti")


def times_rescheduled(df: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Running number of different planned times, less the first two."""
    order = message_order(df, "date")
    # The finer grouping is already co-located by the appointment number: no further exchange.
    out = ordered.with_ordered(df, [*per, *KEY, "now_sched_for_date"], order, {"same_before": ordered.rows_before()})
    out = out.withColumn("is_new", (F.col("same_before") == 0).cast("long"))
    out = ordered.with_ordered(out, [*per, *KEY], order, {"new_before": ordered.sum_before(F.col("is_new"))})
    seen = F.col("new_before") + F.col("is_new")
    return out.withColumn("times_rescheduled", F.greatest(seen - 2, F.lit(0).cast("long"))).drop(
        "same_before", "is_new", "new_before")
