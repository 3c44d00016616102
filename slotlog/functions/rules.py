"""Row rules of the status log and of the observation log, as Column expressions.

Missing values never satisfy a comparison, so every rule that feeds a filter
is closed with ``coalesce(..., false)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotlog import constants as K
from slotlog.functions.dates import as_date, busday_count, plus_minutes
from slotlog.functions.text import recode


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def status_text(code: Column) -> Column:
    return F.when(code.isNotNull(), F.coalesce(recode(code, K.STATUS_TEXT), F.concat(F.lit("unknown: "), code)))


def patient_class(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == "nan"), "ambulant")
        .otherwise(F.coalesce(recode(c, K.PATIENT_CLASS), F.lit("unknown")))
    )


def no_show(date: Column, was_status: Column, now_status: Column, was_planned: Column, first_created: Column,
            patient_class_adj: Column, threshold: int = 2) -> Column:
    """A late move or cancellation of an outpatient slot that was not made for the same day."""
    return holds(
        (patient_class_adj == "ambulant")
        & (busday_count(date, was_planned) <= threshold)
        & now_status.isin("scheduled", "canceled")
        & (was_status != "requested")
        & (F.hour(was_planned) != 0)
        & (as_date(first_created) != as_date(was_planned))
    )


def severity(is_no_show: Column, date: Column, was_planned: Column) -> Column:
    return F.when(is_no_show, F.when(holds(date > was_planned), "hard").otherwise("soft"))


def slot_type(is_no_show: Column, order_status: Column, now_status: Column, patient_class_adj: Column) -> Column:
    came = holds((order_status == "u") & (now_status == "started"))
    return (
        F.when(is_no_show, "no-show")
        .when(came & (patient_class_adj == "ambulant"), "show")
        .when(came & (patient_class_adj == "inpatient"), "inpatient")
    )


def slot_type_detailed(slot_type_col: Column, severity_col: Column) -> Column:
    return F.when(slot_type_col == "no-show", F.concat(severity_col, F.lit(" no-show"))).otherwise(slot_type_col)


def slot_outcome(slot_type_col: Column, now_status: Column, final_planned: Column, was_planned: Column) -> Column:
    gone = holds(now_status == "canceled") | holds(final_planned == was_planned)
    return (
        F.when(slot_type_col == "no-show", F.when(gone, "canceled").otherwise("rescheduled"))
        .when(slot_type_col.isin("show", "inpatient"), "show")
    )


def slot_start(is_no_show: Column, now_status: Column, was_planned: Column) -> Column:
    return F.when(is_no_show | holds(now_status == "started"), was_planned)


def slot_end(is_no_show: Column, now_status: Column, was_planned: Column) -> Column:
    return F.when(is_no_show | holds(now_status == "examined"), plus_minutes(was_planned, K.SLOT_MINUTES))


def examined_end(now_status: Column, date: Column) -> Column:
    return F.when(now_status == "examined", date)


def unchanged(now_status: Column, was_status: Column, now_planned: Column, was_planned: Column) -> Column:
    return holds((now_status == was_status) & (now_planned == was_planned))


def schedule_event(was_days: Column, now_days: Column) -> Column:
    """The new lead time where it differs from the old one; a missing side counts as different."""
    return F.when(~holds(was_days == now_days), now_days)


def observed_no_show(before: Column, after: Column, gap_before: Column, start: Column) -> Column:
    """Decision table over the last status seen before the day and the first one after it."""
    planned = before.isin(*K.OBS_PLANNED)
    return (
        F.when(F.hour(start) == 0, False)
        .when(gap_before < -2, F.lit(None).cast("boolean"))
        .when(planned & after.isin(*K.OBS_CAME), False)
        .when(planned & (after.isNull() | (after == K.OBS_RESET)), True)
        .when(before.isNull() & (after == K.OBS_INPATIENT), False)
    )


def observed_outcome(is_no_show: Column, before: Column, after: Column, gap_before: Column, start: Column) -> Column:
    planned = before.isin(*K.OBS_PLANNED)
    none = F.lit(None).cast("string")
    return (
        F.when(gap_before < -2, none)
        .when(is_no_show, F.when(planned & after.isNull(), "rescheduled").when(planned & (after == K.OBS_RESET),
                                                                               "canceled"))
        .when(F.hour(start) == 0, F.when(after == K.OBS_INPATIENT, "show"))
        .otherwise("show")
    )


def midnight_cancel_blank(start: Column, outcome: Column) -> Column:
    return F.when((F.hour(start) == 0) & (outcome == "canceled"), "").otherwise(outcome)


def reached(feedback: Column) -> Column:
    return recode(feedback, K.FEEDBACK_REACHED)


def reached_2(feedback: Column) -> Column:
    return recode(feedback, K.FEEDBACK_REACHED_2)
