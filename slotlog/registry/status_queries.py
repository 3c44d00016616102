"""Status log and slot table."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotlog import carriers as C
from slotlog import constants as K
from slotlog.functions.hashes import row_hash_sql
from slotlog.functions import dates, rules, text
from slotlog.operators import cleaning, ordered, slots, status
from slotlog.registry import query
from slotlog.registry.sql import (RANGE, S, S3, SLOT_COLUMNS, SLOT_ROWS, SLOT_TEXT, SLOTS, STATUS, add_bd, busday,
                                  in_list, last_cols, select, status_text, sub_bd)

ID = "FillerOrderNo, ingest_seq"
IDS = ["FillerOrderNo", "ingest_seq"]


def raw(spark, sf):
    """Raw log; hot appointments, if any, are numbered into chunks first."""
    return ordered.split_hot_keys(C.status(spark, sf), status.KEY, ["History_MessageDtTm", "ingest_seq"])


def changes(spark, sf):
    """Status rows with previous state and lead times, before labels."""
    df = cleaning.drop_irrelevant_services(cleaning.keep_relevant_machines(raw(spark, sf)))
    return status.add_change_columns(df.withColumn("MRNCmpdId", text.strip_suffix(F.col("MRNCmpdId"))))


def labelled(spark, sf):
    """Labelled rows, unchanged ones included."""
    df = cleaning.drop_test_patients(changes(spark, sf))
    return status.label_changes(status.add_final_planned(status.add_first_created(df)))


def log(spark, sf):
    return status.build_status_log(raw(spark, sf))


def slot_table(spark, sf):
    return slots.build_slots(log(spark, sf), RANGE)


# ---------------------------------------------------------------- casts and filters

def _text_events(spark, sf):
    e = C.table(spark, sf, "events")
    return e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Event_DtTm"),
        F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("DateOfBirth"),
        F.expr("case event_id % 6 when 0 then '9000-01-01 00:00:00.0000000' when 1 then '2999-05-01 10:00:00' "
               "when 2 then '2101-01-01 00:00:00' when 3 then null else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end").alias("far"),
        F.expr("case event_id % 5 when 0 then 'abc' when 1 then '8001.0' when 2 then ' 12 ' when 3 then null "
               "else cast(value as string) end").alias("dirty"),
        F.expr("case event_id % 4 when 0 then 'CH-8001' else cast(8000 + user_id as string) || '.0' end").alias("zip"))


@query("cast_dttm_columns", "select event_id, ts as \"Event_DtTm\", case when event_id % 7 <> 0 then "
       "cast(cast(ts as date) as timestamp) end as \"DateOfBirth\" from events")
def _(spark, sf):
    df = _text_events(spark, sf).select("event_id", "Event_DtTm", "DateOfBirth")
    return cleaning.cast_datetime_columns(df, ["DateOfBirth"])


@query("clamp_out_of_range_year", """select event_id, case event_id % 6 when 0 then null when 1 then '2100-05-01 10:00:00'
  when 2 then '2100-01-01 00:00:00' when 3 then null else strftime(ts, '%Y-%m-%d %H:%M:%S') end as far from events""")
def _(spark, sf):
    return _text_events(spark, sf).select("event_id", text.clamp_year(F.col("far")).alias("far"))


@query("null_non_numbers", """select event_id, event_id % 5 not in (0, 3) as is_number,
  case event_id % 5 when 1 then 8001.0 when 2 then 12.0 when 4 then round(value, 6) end as number from events""")
def _(spark, sf):
    d = text.numbers_only(F.col("dirty"))
    return _text_events(spark, sf).select("event_id", d.isNotNull().alias("is_number"), d.try_cast("double").alias("number"))


@query("strip_float_suffix", """select event_id, case when event_id % 4 = 0 then 'CH-8001'
  else cast(8000 + user_id as varchar) end as zip from events""")
def _(spark, sf):
    return _text_events(spark, sf).select("event_id", text.strip_float_suffix(F.col("zip")).alias("zip"))


@query("prep_raw", select(S, f"""{ID}, MRNCmpdId, History_MessageDtTm, History_ObsStartPlanDtTm, PatientClass, DateOfBirth,
  replace(Zip, '.0', '') as Zip, nullif(ReasonForStudy, 'nan') as ReasonForStudy, Klasse, Beruf""", "s"))
def _(spark, sf):
    df = C.status(spark, sf).withColumns({
        "PlacerOrderNo": F.lit("x"), "History_MessageDtTm": F.col("History_MessageDtTm").cast("string"),
        "DateOfBirth": F.date_format("DateOfBirth", "yyyy-MM-dd")})
    return cleaning.prepare_raw(df).select(
        *IDS, "MRNCmpdId", "History_MessageDtTm", "History_ObsStartPlanDtTm", "PatientClass", "DateOfBirth", "Zip",
        "ReasonForStudy", "Klasse", "Beruf")


@query("filter_in_list", select(S, f"{ID}, EnteringOrganisationDeviceID", "s",
                                f"where EnteringOrganisationDeviceID in {in_list(K.RELEVANT_MACHINES)}"))
def _(spark, sf):
    return cleaning.keep_relevant_machines(C.status(spark, sf)).select(*IDS, "EnteringOrganisationDeviceID")


@query("filter_not_in_list", select(S, f"{ID}, UniversalServiceName", "s", "where UniversalServiceName is null or "
                                    f"UniversalServiceName not in {in_list(K.EXCLUDED_SERVICES)}"))
def _(spark, sf):
    return cleaning.drop_irrelevant_services(C.status(spark, sf)).select(*IDS, "UniversalServiceName")


@query("strip_id_suffix", select(S, f"{ID}, replace(MRNCmpdId, '|USZ', '') as MRNCmpdId", "s"))
def _(spark, sf):
    return C.status(spark, sf).select(*IDS, text.strip_suffix(F.col("MRNCmpdId")).alias("MRNCmpdId"))


@query("exclude_test_ids", select(S, f"{ID}, MRNCmpdId", "s", "where not contains(MRNCmpdId, '_') and MRNCmpdId not in "
                                  "(select cast(s_suppkey as varchar) from supplier where s_acctbal < 1000)"))
def _(spark, sf):
    listed = C.table(spark, sf, "supplier").filter("s_acctbal < 1000").select(F.col("s_suppkey").cast("string").alias("id"))
    return cleaning.drop_test_patients(C.status(spark, sf), listed).select(*IDS, "MRNCmpdId")


@query("drop_noop_changes", select(STATUS, f"{ID}, was_status, now_status, was_sched_for_date, now_sched_for_date", "st"))
def _(spark, sf):
    return cleaning.drop_unchanged(labelled(spark, sf)).select(
        *IDS, "was_status", "now_status", "was_sched_for_date", "now_sched_for_date")


@query("date_range_half_open", select(S, f"{ID}, History_ObsStartPlanDtTm", "s",
                                      "where History_ObsStartPlanDtTm >= timestamp '2024-01-10' "
                                      "and History_ObsStartPlanDtTm < timestamp '2024-01-21'"))
def _(spark, sf):
    return cleaning.in_date_range(C.status(spark, sf), "2024-01-10", "2024-01-20", "History_ObsStartPlanDtTm").select(
        *IDS, "History_ObsStartPlanDtTm")


@query("view_status_changes", select(STATUS, f"{ID}, date, was_status, now_status", "st", "where FillerOrderNo = 101"))
def _(spark, sf):
    return cleaning.history_of(log(spark, sf), 101).select(*IDS, "date", "was_status", "now_status")


@query("sample_one_history", select(STATUS, f"{ID}, date, was_status, now_status", "st", f"""where FillerOrderNo = (
  select FillerOrderNo from st where patient_class_adj = 'ambulant' order by {row_hash_sql(7, ['FillerOrderNo'])}, FillerOrderNo limit 1)"""))
def _(spark, sf):
    return cleaning.sample_history(log(spark, sf), seed=7).select(*IDS, "date", "was_status", "now_status")


# ---------------------------------------------------------------- row rules

@query("status_text", select(S, f"{ID}, {status_text('History_OrderStatus')} as now_status", "s"))
def _(spark, sf):
    return C.status(spark, sf).select(*IDS, rules.status_text(F.col("History_OrderStatus")).alias("now_status"))


@query("patient_class_adj", select(S, f"""{ID}, case when PatientClass is null then 'ambulant'
  when PatientClass = 'ambulant' then 'ambulant' when PatientClass in ('stationär', 'teilstationär') then 'inpatient'
  else 'unknown' end as patient_class_adj""", "s"))
def _(spark, sf):
    return C.status(spark, sf).select(*IDS, rules.patient_class(F.col("PatientClass")).alias("patient_class_adj"))


for _name, _cols in {
    "find_no_shows": ["NoShow"],
    "no_show_severity": ["NoShow", "NoShow_severity"],
    "slot_type": ["slot_type"],
    "slot_type_detailed": ["slot_type_detailed"],
    "slot_outcome": ["slot_outcome"],
}.items():
    query(_name, select(STATUS, f"{ID}, {', '.join(_cols)}", "lab"))(
        lambda spark, sf, cols=_cols: labelled(spark, sf).select(*IDS, *cols))


@query("identify_start_end", select(SLOT_ROWS, f"{ID}, start_time, end_own as end_time", "se0"))
def _(spark, sf):
    c = F.col
    args = (c("NoShow"), c("now_status"), c("was_sched_for_date"))
    return log(spark, sf).select(*IDS, rules.slot_start(*args).alias("start_time"), rules.slot_end(*args).alias("end_time"))


@query("examined_end_time", select(STATUS, f"{ID}, case when now_status = 'examined' then date end as end_time", "st"))
def _(spark, sf):
    return log(spark, sf).select(*IDS, rules.examined_end(F.col("now_status"), F.col("date")).alias("end_time"))


@query("identify_sched_events", select(STATUS, f"""{ID}, case when was_sched_for is distinct from now_sched_for
  or was_sched_for is null then now_sched_for end as sched_event""", "st"))
def _(spark, sf):
    return log(spark, sf).select(*IDS, rules.schedule_event(F.col("was_sched_for"), F.col("now_sched_for")).alias("sched_event"))


# ---------------------------------------------------------------- dates

@query("days_ahead", select(S3, f"{ID}, was_sched_for, now_sched_for", "s3"))
def _(spark, sf):
    return cleaning.drop_test_patients(changes(spark, sf)).select(*IDS, "was_sched_for", "now_sched_for")


@query("busday_count", select(S3, f"""{ID}, {busday('date', 'was_sched_for_date')} as was_busday,
  now_sched_for_busday as now_busday""", "s3"))
def _(spark, sf):
    return cleaning.drop_test_patients(changes(spark, sf)).select(
        *IDS, dates.busday_count(F.col("date"), F.col("was_sched_for_date")).alias("was_busday"),
        F.col("now_sched_for_busday").alias("now_busday"))


_P = "History_ObsStartPlanDtTm"


@query("add_business_days", select(S, f"{ID}, " + ", ".join(
    f"cast({add_bd(_P, n)} as timestamp) as plus_{n}" for n in (1, 2, 3, 5, 11)), "s"))
def _(spark, sf):
    return C.status(spark, sf).select(
        *IDS, *[dates.add_business_days(F.col(_P), n).alias(f"plus_{n}") for n in (1, 2, 3, 5, 11)])


@query("subtract_business_days", select(S, f"{ID}, " + ", ".join(
    f"cast({sub_bd(_P, n)} as timestamp) as minus_{n}" for n in (1, 3, 5, 11)), "s"))
def _(spark, sf):
    return C.status(spark, sf).select(
        *IDS, *[dates.subtract_business_days(F.col(_P), n).alias(f"minus_{n}") for n in (1, 3, 5, 11)])


# ---------------------------------------------------------------- windows, aggregates

@query("status_lag_columns", select(S3.replace("where not contains(MRNCmpdId, '_')", ""), f"""{ID}, was_status, now_status,
  was_sched_for_date, was_sched_for, now_sched_for, now_sched_for_busday""", "s3"))
def _(spark, sf):
    return changes(spark, sf).select(*IDS, "was_status", "now_status", "was_sched_for_date", "was_sched_for",
                                     "now_sched_for", "now_sched_for_busday")


@query("broadcast_agg_back", select(S3, f"{ID}, first_created_date, final_now_sched_for_date", "s3"))
def _(spark, sf):
    return labelled(spark, sf).select(*IDS, "first_created_date", "final_now_sched_for_date")


@query("end_time_backfill", select(SLOT_ROWS, f"{ID}, end_time", "se"))
def _(spark, sf):
    return slots.add_start_end(log(spark, sf)).select(*IDS, "end_time")


@query("times_rescheduled", select(f"""{STATUS}, fs as (select *, case when row_number() over (partition by FillerOrderNo,
  now_sched_for_date order by date, ingest_seq) = 1 then 1 else 0 end as is_new from st)""", f"""{ID},
  cast(greatest(sum(is_new) over (partition by FillerOrderNo order by date, ingest_seq) - 2, 0) as bigint)
  as times_rescheduled""", "fs"))
def _(spark, sf):
    return status.times_rescheduled(log(spark, sf)).select(*IDS, "times_rescheduled")


@query("build_status_df", select(STATUS, f"""{ID}, MRNCmpdId, date, was_status, now_status, was_sched_for, now_sched_for,
  was_sched_for_date, now_sched_for_date, first_created_date, patient_class_adj, NoShow, NoShow_severity, slot_outcome,
  slot_type, slot_type_detailed""", "st"))
def _(spark, sf):
    return log(spark, sf).select(
        *IDS, "MRNCmpdId", "date", "was_status", "now_status", "was_sched_for", "now_sched_for", "was_sched_for_date",
        "now_sched_for_date", "first_created_date", "patient_class_adj", "NoShow", "NoShow_severity", "slot_outcome",
        "slot_type", "slot_type_detailed")


_SLOT = ", ".join(SLOT_COLUMNS)


@query("slots_show", select(SLOT_ROWS, _SLOT, "shows"))
def _(spark, sf):
    return slots.show_slots(slots.add_start_end(log(spark, sf))).select(*SLOT_COLUMNS)


@query("slots_no_show", select(SLOT_ROWS, _SLOT, "misses"))
def _(spark, sf):
    return slots.no_show_slots(slots.add_start_end(log(spark, sf))).select(*SLOT_COLUMNS)


_FUTURE = f"""{SLOT_ROWS}, fut as (select FillerOrderNo, MRNCmpdId, now_sched_for_date as start_time,
  now_sched_for_date + interval 30 minutes as end_time, bool_and(NoShow) as NoShow, {last_cols(SLOT_TEXT)}
  from se where now_sched_for_date is not null group by FillerOrderNo, MRNCmpdId, now_sched_for_date)"""


@query("slots_future", select(_FUTURE, _SLOT, "fut"))
def _(spark, sf):
    return slots.future_slots(slots.add_start_end(log(spark, sf))).select(*SLOT_COLUMNS)


@query("last_status_per_appointment", select(STATUS, "FillerOrderNo, MRNCmpdId, now_status, now_sched_for_date, "
       "now_sched_for_busday", "st", "qualify row_number() over (partition by FillerOrderNo order by date desc, "
       "ingest_seq desc) = 1"))
def _(spark, sf):
    return status.last_status(log(spark, sf))


@query("build_slot_df", select(SLOTS, _SLOT, "sl"))
def build_slot_df(spark, sf):
    return slot_table(spark, sf).select(*SLOT_COLUMNS)


@query("dedup_patient_slot", select(f"""{SLOT_ROWS}, un as (select * from shows union all by name select * exclude (missed)
  from misses)""", "MRNCmpdId, start_time, NoShow, FillerOrderNo", "un", "qualify row_number() over (partition by MRNCmpdId, "
  "start_time order by NoShow, FillerOrderNo) = 1"))
def _(spark, sf):
    df = slots.past_slots(slots.add_start_end(log(spark, sf)))
    return slots.dedup_patient_slot(df).select("MRNCmpdId", "start_time", "NoShow", "FillerOrderNo")


@query("last_non_na_or_zero", select(STATUS, """FillerOrderNo, MRNCmpdId, coalesce(last(Telefon order by date, ingest_seq)
  filter (where Telefon is not null), '0') as Telefon""", "st", "group by 1, 2"))
def _(spark, sf):
    df = log(spark, sf)
    return df.groupBy("FillerOrderNo", "MRNCmpdId").agg(
        slots.last_or_zero(F.col("Telefon"), slots.position(df)).alias("Telefon"))


@query("custom_agg_spec", select(SLOT_ROWS + f""", un as (
  select FillerOrderNo, MRNCmpdId, 'attended' as k, * exclude (FillerOrderNo, MRNCmpdId) from se where slot_type in ('show', 'inpatient')
  union all by name select *, cast(was_sched_for_date as varchar) as k from se where NoShow),
  ag as (select FillerOrderNo, MRNCmpdId, k, bool_and(NoShow) as NoShow, count(*) as n_changes,
    coalesce(last(Telefon order by date, ingest_seq) filter (where Telefon is not null), '0') as Telefon,
    last(start_time order by date, ingest_seq) filter (where start_time is not null) as start_time from un group by 1, 2, 3)""",
    "FillerOrderNo, MRNCmpdId, start_time, NoShow, n_changes, Telefon", "ag",
    f"where start_time >= timestamp '{RANGE[0]}' and start_time < timestamp '{RANGE[1]}' + interval 1 day "
    "qualify row_number() over (partition by MRNCmpdId, start_time order by NoShow, FillerOrderNo) = 1"))
def _(spark, sf):
    df = log(spark, sf).withColumn("n_changes", F.lit(1))
    return slots.build_slots(df, RANGE, {
        "start_time": slots.last, "NoShow": slots.smallest, "n_changes": lambda v, pos: F.count(v),
        "Telefon": slots.last_or_zero})


@query("anti_join_cancelled", select(f"""{STATUS}, ls as (select * from st qualify row_number() over (partition by
  FillerOrderNo order by date desc, ingest_seq desc) = 1)""", f"{ID}, now_status", "st", """where FillerOrderNo not in
  (select FillerOrderNo from ls where now_status = 'canceled' and now_sched_for_busday > 3)"""))
def _(spark, sf):
    return status.drop_canceled_early(log(spark, sf)).select(*IDS, "now_status")


@query("schedule_slice", select(SLOTS, """FillerOrderNo, start_time, slot_type, round(case when slot_type = 'no-show' then 30.0
  else date_diff('microsecond', start_time, end_time) / 60e6 end, 6) as duration_min""", "sl",
  "where EnteringOrganisationDeviceID = 'MR1' and start_time >= timestamp '2024-01-08' and start_time < timestamp '2024-01-22'"))
def _(spark, sf):
    return slots.schedule_slice(slot_table(spark, sf), "MR1", "2024-01-08", "2024-01-22").select(
        "FillerOrderNo", "start_time", "slot_type", "duration_min")


@query("anonymise_shift", select(SLOTS, """count(*) as n, count(distinct FillerOrderNo) as appts, true as one_shift,
  true as small_shift""", "sl"))
def _(spark, sf):
    df = slot_table(spark, sf).withColumns({"s0": F.col("start_time"), "e0": F.col("end_time")})
    by = dates.minutes_between(F.col("s0"), F.col("start_time"))
    by_end = dates.minutes_between(F.col("e0"), F.col("end_time"))
    return slots.anonymise(df, seed=5).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("FillerOrderNo").alias("appts"),
        ((F.min(by) == F.max(by)) & F.bool_and(F.coalesce(by == by_end, F.lit(True)))).alias("one_shift"),
        (F.max(F.abs(by)) <= 15).alias("small_shift"))
