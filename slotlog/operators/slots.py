"""The slot table: one row per appointment that took place or should have."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlog import constants as K
from slotlog.functions import rules, text
from slotlog.functions.dates import minutes_between, plus_minutes
from slotlog.operators import cleaning, ordered, status

# An aggregate gets the value column and the order struct of the rows.
Aggregate = Callable[[Column, Column], Column]


def last(value: Column, position: Column) -> Column:
    """Latest non-null value."""
    return F.max_by(value, F.when(value.isNotNull(), position))


def first(value: Column, position: Column) -> Column:
    """Earliest non-null value."""
    return F.min_by(value, F.when(value.isNotNull(), position))


def smallest(value: Column, position: Column) -> Column:
    return F.min(value)


def last_or_zero(value: Column, position: Column) -> Column:
    """Latest non-null value, else the text ``0``."""
    return F.coalesce(last(value, position), F.lit("0"))


DEFAULT_COLUMNS: dict[str, Aggregate] = {
    "patient_class_adj": last,
    "start_time": last,
    "end_time": last,
    "NoShow": smallest,
    "slot_outcome": last,
    "slot_type": last,
    "slot_type_detailed": last,
    "EnteringOrganisationDeviceID": last,
    "UniversalServiceName": last,
}


def position(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in status.message_order(df, "date")])


def add_start_end(df: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Start and end of slots on the rows that decide them; the end is carried back within the appointment."""
    c = F.col
    out = df.withColumns({
        "start_time": rules.slot_start(c("NoShow"), c("now_status"), c("was_sched_for_date")),
        "end_time": rules.slot_end(c("NoShow"), c("now_status"), c("was_sched_for_date")),
    })
    return ordered.with_ordered(out, [*per, "FillerOrderNo"], status.message_order(out, "date"),
                                {"end_time": ordered.next_value(c("end_time"))})


def _aggregate(df: DataFrame, keys: list[str], columns: dict[str, Aggregate]) -> DataFrame:
    pos = position(df)
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    df = df.filter(present)
    # Latest values of columns that are never null all come from the latest row: one aggregate holds them.
    never_null = [n for n, fn in columns.items() if fn is last and not df.schema[n].nullable]
    found = {"v__" + n: fn(F.col(n), pos) for n, fn in columns.items() if n not in never_null}
    if never_null:
        found["latest"] = F.max_by(F.struct(*never_null), pos)
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in found.items()])
    value = {n: F.col("latest." + n if n in never_null else "v__" + n) for n in columns}
    return out.select(*keys, *[c.alias("v__" + n if n in keys else n) for n, c in value.items()])


def show_slots(df: DataFrame, columns: dict[str, Aggregate] = DEFAULT_COLUMNS) -> DataFrame:
    """One slot per appointment and patient for rows that were attended."""
    return _aggregate(df.filter(F.col("slot_type").isin("show", "inpatient")), ["FillerOrderNo", "MRNCmpdId"], columns)


def no_show_slots(df: DataFrame, columns: dict[str, Aggregate] = DEFAULT_COLUMNS) -> DataFrame:
    """One slot per appointment, patient and missed planned time."""
    return _aggregate(df.filter("NoShow"), ["FillerOrderNo", "MRNCmpdId", "was_sched_for_date"], columns).drop(
        "was_sched_for_date")


def past_slots(df: DataFrame, columns: dict[str, Aggregate] = DEFAULT_COLUMNS, per: Sequence[str] = ()) -> DataFrame:
    """Attended and missed slots in one aggregation: a row is never both."""
    missed = F.col("NoShow")
    tagged = df.filter(missed | rules.holds(F.col("slot_type").isin("show", "inpatient"))).withColumn(
        "slot_key", F.when(missed, F.col("was_sched_for_date").cast("string")).otherwise("attended"))
    return _aggregate(tagged, [*per, "FillerOrderNo", "MRNCmpdId", "slot_key"], columns).drop("slot_key")


def future_slots(df: DataFrame, columns: dict[str, Aggregate] = DEFAULT_COLUMNS, per: Sequence[str] = ()) -> DataFrame:
    """One slot per appointment, patient and planned time, whatever happened later."""
    out = _aggregate(df, [*per, "FillerOrderNo", "MRNCmpdId", "now_sched_for_date"], columns)
    return out.withColumns({
        "start_time": F.col("now_sched_for_date"),
        "end_time": plus_minutes(F.col("now_sched_for_date"), K.SLOT_MINUTES),
    }).drop("now_sched_for_date")


def dedup_patient_slot(df: DataFrame, *tie: str, per: Sequence[str] = ()) -> DataFrame:
    """First slot per patient and start: attended before missed, any reason before none, then ``tie``.

    The row-number filter lets Spark cut each task's rows to one per key before the shuffle.
    """
    order = [F.col("NoShow").asc_nulls_last()]
    if "reason" in df.columns:
        order.append(text.reason_rank(F.col("reason")).asc_nulls_last())
    order += [F.col(c).asc_nulls_last() for c in (*tie, "FillerOrderNo") if c in df.columns]
    w = Window.partitionBy(*per, "MRNCmpdId", "start_time").orderBy(*order)
    return df.withColumn("multi_slot", F.row_number().over(w)).filter("multi_slot = 1").drop("multi_slot")


def build_slots(status_df: DataFrame, valid_date_range, columns: dict[str, Aggregate] | None = None,
                include_id_cols: bool = True, build_future_slots: bool = False, per: Sequence[str] = ()) -> DataFrame:
    """Status changes to slots. ``columns`` names what each slot keeps and how it is aggregated.

    The date range may be given as columns of ``per``, then every log has its own.
    """
    columns = dict(columns or DEFAULT_COLUMNS)
    wants_start = "start_time" in columns
    columns.setdefault("start_time", smallest)
    df = add_start_end(status_df, per)
    slots = future_slots(df, columns, per) if build_future_slots else past_slots(df, columns, per)
    slots = cleaning.in_date_range(slots, *valid_date_range)
    slots = dedup_patient_slot(slots.withColumn("FillerOrderNo", F.col("FillerOrderNo").cast("long")), per=per)
    drop = ([] if include_id_cols else ["FillerOrderNo", "MRNCmpdId"]) + ([] if wants_start else ["start_time"])
    return slots.drop(*drop)


def sorted_slots(slots: DataFrame) -> DataFrame:
    """Report order; only for output, the operators do not rely on it."""
    return slots.orderBy("start_time", *[c for c in ("FillerOrderNo",) if c in slots.columns])


def slot_duration(df: DataFrame) -> DataFrame:
    """Length in minutes, the default length for missed slots."""
    return df.withColumn("duration_min", F.when(F.col("slot_type") == "no-show", F.lit(float(K.SLOT_MINUTES)))
                         .otherwise(minutes_between(F.col("start_time"), F.col("end_time"))))


def schedule_slice(df: DataFrame, device: str, start=None, end=None) -> DataFrame:
    """Slots of one device with start <= start_time < end."""
    out = df.filter(F.col("EnteringOrganisationDeviceID") == device)
    if start is not None:
        out = out.filter(F.col("start_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("start_time") < F.lit(end).cast("timestamp_ntz"))
    return slot_duration(out)


def stack_sources(observed: DataFrame, slots: DataFrame) -> DataFrame:
    """Two record systems under each other with a ``source`` label; observed slots get the default length."""
    a = observed.withColumns({
        "source": F.lit("dispo"),
        "end_time": plus_minutes(F.col("start_time"), K.SLOT_MINUTES),
        "EnteringOrganisationDeviceID": F.coalesce(F.col("machine_after"), F.col("machine_before")),
        "patient_id": F.col("patient_id").cast("string"),
    })
    b = slots.withColumns({"source": F.lit("extract"), "patient_id": F.col("MRNCmpdId")})
    return a.unionByName(b, allowMissingColumns=True)


def anonymise(df: DataFrame, seed: int, max_minutes: int = 15) -> DataFrame:
    """Shift all times by one seeded offset of at most ``max_minutes``."""
    span = 2 * max_minutes + 1
    offset = F.pmod(F.xxhash64(F.lit(seed)), F.lit(span)) - F.lit(max_minutes)
    return df.withColumns({c: plus_minutes(F.col(c), offset) for c in ("start_time", "end_time")})


def append_new(existing: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Master table with the new rows: full-row distinct, or first come per key where keys are given."""
    if keys is None:
        return existing.unionByName(new, allowMissingColumns=True).distinct()
    fresh = new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)
