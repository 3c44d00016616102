"""Casts, dirty-value repair and row filters on the raw status log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlog import constants as K
from slotlog.functions import rules, text
from slotlog.functions.dates import is_weekday
from slotlog.functions.hashes import row_hash


def cast_datetime_columns(df: DataFrame, known: Sequence[str] = (), clamp: bool = False) -> DataFrame:
    """Turn every text column named as a date-time, and the listed ones, into timestamps.

    With ``clamp`` far-future years are pulled back to the limit and rows whose text
    is the end-of-time mark are dropped, column by column.
    """
    kinds = dict(df.dtypes)
    names = [c for c in df.columns if K.DATE_TIME_MARKER in c] + [c for c in known if c in df.columns]
    changed = {}
    for c in dict.fromkeys(names):
        if kinds[c] == "string":
            col = text.not_nan(F.col(c))
            col = text.clamp_year(col) if clamp else col
            changed[c] = F.coalesce(
                col.try_cast("timestamp_ntz"),
                F.try_to_timestamp(col, F.lit("dd-MM-yyyy")).cast("timestamp_ntz"),
                F.try_to_timestamp(col, F.lit("d.M.yyyy")).cast("timestamp_ntz"),
            )
        elif kinds[c] == "timestamp":
            changed[c] = F.col(c).cast("timestamp_ntz")
    if not changed:
        return df
    out = df.withColumns(changed)
    if clamp:
        out = out.na.drop("any", subset=[c for c in changed if kinds[c] == "string"] or None)
    return out


def prepare_raw(df: DataFrame, clamp: bool = False) -> DataFrame:
    """Bring a raw export to its schema: unused columns out, text as text, dates as dates, postal codes as digits.

    Columns that are not there are ignored. Missing text stays null.
    """
    out = df.drop(*[c for c in K.RAW_DROP_COLUMNS if c in df.columns])
    out = cast_datetime_columns(out, K.RAW_DATE_COLUMNS, clamp)
    changed = {c: text.not_nan(F.col(c).cast("string")) for c in K.RAW_TEXT_COLUMNS if c in out.columns}
    for c in K.RAW_NUMERIC_TEXT_COLUMNS:
        if c in out.columns:
            changed[c] = text.strip_float_suffix(text.numbers_only(text.not_nan(F.col(c).cast("string"))))
    return out.withColumns(changed) if changed else out


def keep_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def drop_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is listed go; rows without a value stay."""
    return df.filter(~rules.holds(F.col(column).isin(list(values))))


def keep_relevant_machines(df: DataFrame, machines: Sequence[str] = tuple(K.RELEVANT_MACHINES)) -> DataFrame:
    return keep_values(df, "EnteringOrganisationDeviceID", machines)


def drop_irrelevant_services(df: DataFrame, services: Sequence[str] = tuple(K.EXCLUDED_SERVICES)) -> DataFrame:
    return drop_values(df, "UniversalServiceName", services)


def drop_test_patients(df: DataFrame, ids: Sequence[str] | DataFrame = (), column: str = "MRNCmpdId") -> DataFrame:
    """Ids with an underscore are tests, and so are the listed ones (a list, or a one-column table)."""
    out = df.filter(~F.col(column).contains("_"))
    if isinstance(ids, DataFrame):
        name = ids.columns[0]
        return out.join(ids.select(F.col(name).cast("string").alias(column)).distinct(), column, "left_anti")
    return drop_values(out, column, ids) if ids else out


def drop_id_prefix(df: DataFrame, prefix: str = K.TEST_PATIENT_PREFIX, column: str = "MRNCmpdId") -> DataFrame:
    return df.filter(~rules.holds(F.col(column).startswith(prefix)))


def drop_unchanged(df: DataFrame) -> DataFrame:
    """Drop rows that changed neither the status nor the planned time."""
    return df.filter(~rules.unchanged(*[F.col(c) for c in (
        "now_status", "was_status", "now_sched_for_date", "was_sched_for_date")]))


def _day(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10])


def within_dates(start, end, column: str = "start_time") -> Column:
    """``start`` <= column < the day after ``end``; both may be date columns."""
    lo = start.cast("timestamp_ntz") if isinstance(start, Column) else F.lit(
        dt.datetime.combine(_day(start), dt.time())).cast("timestamp_ntz")
    hi = F.date_add(end, 1).cast("timestamp_ntz") if isinstance(end, Column) else F.lit(
        dt.datetime.combine(_day(end) + dt.timedelta(days=1), dt.time())).cast("timestamp_ntz")
    return (F.col(column) >= lo) & (F.col(column) < hi)


def in_date_range(df: DataFrame, start, end, column: str = "start_time") -> DataFrame:
    return df.filter(within_dates(start, end, column))


def in_day_hours(df: DataFrame, column: str = "hour_sched") -> DataFrame:
    return df.filter((F.col(column) > 6) & (F.col(column) < 18))


def on_weekdays(df: DataFrame, column: str = "start_time") -> DataFrame:
    return df.filter(is_weekday(F.col(column)))


def drop_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def numeric_ids(df: DataFrame, column: str = "AccessionNumber") -> DataFrame:
    """Rows with a numeric id, the id as a number."""
    value = F.col(column).cast("string").try_cast("double")
    return df.filter(value.isNotNull()).withColumn(column, value.cast("long"))


def distinct_with_keys(df: DataFrame, required: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for c in required:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond).distinct()


def map_stations(df: DataFrame, column: str = "StationName") -> DataFrame:
    """Keep the known stations and recode them to their device number."""
    codes = {k: str(v) for k, v in K.STATION_DEVICE.items()}
    return keep_values(df, column, codes).withColumn(column, text.recode(F.col(column), codes).cast("int"))


def history_of(df: DataFrame, order_no: int) -> DataFrame:
    """All status changes of one appointment in time order."""
    order = [c for c in ("date", "History_MessageDtTm", "ingest_seq") if c in df.columns]
    return df.filter(F.col("FillerOrderNo") == order_no).orderBy(*order)


def sample_history(df: DataFrame, seed: int = 0) -> DataFrame:
    """History of one outpatient appointment chosen by a seeded hash."""
    pick = (
        df.filter(F.col("patient_class_adj") == "ambulant")
        .orderBy(row_hash(seed, ["FillerOrderNo"]), "FillerOrderNo")
        .select("FillerOrderNo").limit(1)
    )
    return df.join(F.broadcast(pick), "FillerOrderNo", "left_semi").orderBy("date")
