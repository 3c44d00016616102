"""Features and feature jobs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from slotlog import carriers as C
from slotlog import constants as K
from slotlog.functions import text
from slotlog.operators import cleaning, features, ordered, scoring, slots, status
from slotlog.plans import feature_jobs as jobs, live_jobs
from slotlog.registry import query
from slotlog.registry.sql import (RANGE, S, SLOT_ROWS, SLOTS, STATUS, add_bd, cascade, case_map, last_cols,
                                  select)
from slotlog.registry.status_queries import ID, IDS, log
from slotlog.session import cut_lineage

F_SLOTS = f"f as ({C.slot_sql(C.DUCK)})"


def finished(spark, sf):
    return C.slots(spark, sf)


# ---------------------------------------------------------------- calendar

@query("limit_to_day_hours", select(F_SLOTS, "FillerOrderNo, hour(start_time) as hour_sched", "f",
                                    "where hour(start_time) > 6 and hour(start_time) < 18"))
def _(spark, sf):
    return cleaning.in_day_hours(features.add_calendar(finished(spark, sf))).select("FillerOrderNo", "hour_sched")


@query("weekday_only", select(F_SLOTS, "FillerOrderNo, start_time", "f", "where isodow(start_time) < 6"))
def _(spark, sf):
    return cleaning.on_weekdays(finished(spark, sf)).select("FillerOrderNo", "start_time")


@query("calendar_parts", select(F_SLOTS, """FillerOrderNo, year(start_time) as year, month(start_time) as month,
  hour(start_time) as hour_sched, isodow(start_time) - 1 as day_of_week, dayname(start_time) as day_of_week_str""", "f"))
def _(spark, sf):
    return features.add_calendar(finished(spark, sf)).select(
        "FillerOrderNo", "year", "month", "hour_sched", "day_of_week", "day_of_week_str")


def _cycle(e: str, period: int) -> str:
    return f"round(sin(({e}) * {2 * math.pi / period!r}), 6) + 0.0, round(cos(({e}) * {2 * math.pi / period!r}), 6) + 0.0"


def _cycles_sql() -> str:
    out = []
    for n, e, p in (("hour", "hour(start_time)", 24), ("day_of_week", "isodow(start_time) - 1", 5),
                    ("month", "month(start_time) - 1", 12)):
        s, c = _cycle(e, p).split(", round")
        out += [f"{s} as {n}_sin", f"round{c} as {n}_cos"]
    return ", ".join(out)


@query("cyclical_encode", select(F_SLOTS, f"FillerOrderNo, {_cycles_sql()}", "f"))
def _(spark, sf):
    return features.add_cycles(features.add_calendar(finished(spark, sf))).select(
        "FillerOrderNo", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos")


@query("time_of_day_bucket", select(F_SLOTS, """FillerOrderNo, case when hour(start_time) <= 9 then 'early_morning'
  when hour(start_time) <= 12 then 'late_morning' when hour(start_time) <= 14 then 'lunchtime'
  when hour(start_time) <= 17 then 'afternoon' else 'evening' end as time_of_day""", "f"))
def _(spark, sf):
    return features.add_time_of_day(features.add_calendar(finished(spark, sf))).select("FillerOrderNo", "time_of_day")


@query("truncate_week_month", select(F_SLOTS, """FillerOrderNo, cast(date_trunc('week', start_time) as timestamp) as week,
  cast(date_trunc('month', start_time) as timestamp) as year_month""", "f"))
def _(spark, sf):
    return finished(spark, sf).select("FillerOrderNo", F.date_trunc("week", "start_time").alias("week"),
                                      F.date_trunc("month", "start_time").alias("year_month"))


# ---------------------------------------------------------------- row features

_KM = """2 * 6371.009 * asin(sqrt(pow(sin((radians(h.lat) - radians(z.lat)) / 2), 2) + cos(radians(z.lat)) *
  cos(radians(h.lat)) * pow(sin((radians(h.lon) - radians(z.lon)) / 2), 2)))"""
_DIST = f"""pc as ({C.post_code_sql(C.DUCK)}),
km as (select z.post_code as km_code, {_KM} as distance_to_usz from pc z, pc h where h.post_code = '{C.SITE_POST_CODE}')"""

_MODALITY = cascade("UniversalServiceName", K.MODALITY_RULES, "'other'")
_OCCUPATION = cascade("coalesce(Beruf, 'nan')", K.OCCUPATION_RULES,
                      "case when Beruf is null or Beruf in ('nan', '-') then 'none_given' else 'other' end")
_REASON = f"""case when ReasonForStudy is null or ReasonForStudy = 'nan' then 'none_given'
  else {cascade('ReasonForStudy', K.REASON_RULES, "'other'")} end"""
_RANK = "case reason " + " ".join(f"when '{l}' then {i}" for i, (_, l) in enumerate(K.REASON_RULES)) + \
    f" when 'other' then {len(K.REASON_RULES)} when 'none_given' then {len(K.REASON_RULES) + 1} end"
_CODES = f"""{case_map('Klasse', K.INSURANCE_CLASS, "'unknown'")} as insurance_class,
  case when Sex = 'weiblich' then 1 else 0 end as sex,
  case when Zivilstand is null then 'not known' else {case_map('Zivilstand', K.MARITAL, "'nan'")} end as marital,
  replace(Zip, '.0', '') as post_code"""


@query("age_years", select(STATUS, f"""{ID}, year(date) - year(DateOfBirth) as age,
  (year(date) - year(DateOfBirth)) * (year(date) - year(DateOfBirth)) as age_sq,
  year(date) - year(DateOfBirth) > 20 and year(date) - year(DateOfBirth) < 60 as age_20_60""", "st"))
def _(spark, sf):
    return features.add_age(log(spark, sf)).select(*IDS, "age", "age_sq", "age_20_60")


@query("modality_cascade", f"""select p_partkey, {cascade('n', K.MODALITY_RULES, "'other'")} as modality from
  (select p_partkey, {C.pick('p_partkey', C.SERVICES, True)} || ' ' || p_name as n from part) p""")
def _(spark, sf):
    df = C.table(spark, sf, "part").select(
        "p_partkey", F.expr(f"{C.pick('p_partkey', C.SERVICES)} || ' ' || p_name").alias("UniversalServiceName"))
    return features.add_modality(df).select("p_partkey", "modality")


def _job(duck: bool) -> str:
    return f"coalesce({C.pick('p_partkey', C.JOBS, duck)}, p_name)"


@query("occupation_cascade", f"""select p_partkey, {cascade('n', K.OCCUPATION_RULES,
  "case when n is null or n in ('nan', '-') then 'none_given' else 'other' end")} as occupation from
  (select p_partkey, {_job(True)} as n from part) p""")
def _(spark, sf):
    df = C.table(spark, sf, "part").select("p_partkey", F.expr(_job(False)).alias("Beruf"))
    return features.add_occupation(df).select("p_partkey", "occupation")


def _doc_reason(duck: bool) -> str:
    return f"case when doc_id % 3 = 0 then {C.pick('doc_id', C.REASONS, duck)} else text end"


@query("reason_cascade", f"""select doc_id, reason, {_RANK} as reason_rank from (select doc_id, {_REASON} as reason from
  (select doc_id, {_doc_reason(True)} as ReasonForStudy from documents) d) e""")
def _(spark, sf):
    df = C.table(spark, sf, "documents").select("doc_id", F.expr(_doc_reason(False)).alias("ReasonForStudy"))
    out = features.add_reason(df)
    return out.select("doc_id", "reason", text.reason_rank(F.col("reason")).alias("reason_rank"))


@query("code_map_features", select(STATUS, f"{ID}, {_CODES}", "st"))
def _(spark, sf):
    return features.add_codes(log(spark, sf)).select(*IDS, "insurance_class", "sex", "marital", "post_code")


@query("distance_lookup", select(f"{STATUS}, {_DIST}", f"""{ID}, round(distance_to_usz, 6) as distance_to_usz,
  round(distance_to_usz * distance_to_usz, 6) as distance_to_usz_sq, coalesce(distance_to_usz < 16, false) as close_to_usz""",
  "st left join km on km_code = replace(Zip, '.0', '')"))
def _(spark, sf):
    df = features.add_codes(log(spark, sf))
    return features.add_distance(df, C.post_codes(spark, sf), C.SITE_POST_CODE).select(
        *IDS, "distance_to_usz", "distance_to_usz_sq", "close_to_usz")


# ---------------------------------------------------------------- slot features

_LEAD = """ld as (select FillerOrderNo, now_sched_for_date,
    first(now_sched_for order by date, ingest_seq) filter (where now_sched_for is not null) as sched_days_advanced,
    first(now_sched_for_busday order by date, ingest_seq) filter (where now_sched_for_busday is not null)
      as sched_days_advanced_busday
  from {src} where coalesce(was_sched_for_date <> now_sched_for_date, true) group by 1, 2)"""


@query("scheduled_days_advanced", select(f"{STATUS}, {_LEAD.format(src='st')}", "*", "ld"))
def _(spark, sf):
    return features.schedule_lead_times(log(spark, sf))


@query("join_inner_on_two_keys", select(f"{SLOTS}, {_LEAD.format(src='st')}", """sl.FillerOrderNo, MRNCmpdId, start_time,
  sched_days_advanced, sched_days_advanced_busday, sched_days_advanced * sched_days_advanced as sched_days_advanced_sq,
  sched_days_advanced <= 2 as sched_2_days""", "sl join ld on sl.FillerOrderNo = ld.FillerOrderNo and start_time = now_sched_for_date"))
def _(spark, sf):
    st = log(spark, sf)
    return features.add_days_advanced(st, slots.build_slots(st, RANGE)).select(
        "FillerOrderNo", "MRNCmpdId", "start_time", "sched_days_advanced", "sched_days_advanced_busday",
        "sched_days_advanced_sq", "sched_2_days")


def _history_sql(source: str) -> str:
    return f"""nb as (select *, coalesce(cast(sum(cast(NoShow as integer)) over p as bigint), 0) as no_show_before,
    row_number() over (partition by MRNCmpdId order by start_time, FillerOrderNo) - 1 as appts_before from {source}
    window p as (partition by MRNCmpdId order by start_time, FillerOrderNo rows between unbounded preceding and 1 preceding))"""


_HIST = """no_show_before, no_show_before * no_show_before as no_show_before_sq, appts_before,
  appts_before - no_show_before as show_before,
  round(case when appts_before > 0 then no_show_before / appts_before else 0 end, 6) as no_show_rate"""


@query("no_show_before", select(f"{F_SLOTS}, {_history_sql('f')}", f"FillerOrderNo, MRNCmpdId, start_time, {_HIST}", "nb"))
def _(spark, sf):
    df = ordered.split_hot_keys(finished(spark, sf), ["MRNCmpdId"], ["start_time", "FillerOrderNo"])
    return features.add_no_show_before(df).select("FillerOrderNo", "MRNCmpdId", "start_time", *features.HISTORY_COLUMNS)


@query("no_show_before_history", select(f"{F_SLOTS}, {_history_sql('f')}", f"FillerOrderNo, MRNCmpdId, start_time, {_HIST}", "nb",
                                        "where start_time >= timestamp '2000-01-01'"))
def _(spark, sf):
    df = finished(spark, sf)
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    # The history overlaps the current rows by one year: rows in both count once.
    overlap = F.lit("2001-01-01").cast("timestamp_ntz")
    out = features.add_no_show_before(df.filter(F.col("start_time") >= cut), df.filter(F.col("start_time") < overlap))
    return out.select("FillerOrderNo", "MRNCmpdId", "start_time", *features.HISTORY_COLUMNS)


@query("drop_any_null", select(S, f"{ID}, PatientClass, Klasse, Beruf, Telefon", "s", """where PatientClass is not null and
  Klasse is not null and Beruf is not null and Telefon is not null"""))
def _(spark, sf):
    return cleaning.drop_any_null(C.status(spark, sf).select(*IDS, "PatientClass", "Klasse", "Beruf", "Telefon"))


_OUT_COLS = ["NoShow", "slot_outcome", "slot_type_detailed", "slot_type"]


@query("join_left_outcome", select(f"{SLOTS}, fu as (select distinct MRNCmpdId, now_sched_for_date as start_time from st where "
  "now_sched_for_date is not null)", """fu.MRNCmpdId, fu.start_time, coalesce(NoShow, false) as NoShow,
  coalesce(slot_outcome, 'ok_rescheduled') as slot_outcome, coalesce(slot_type_detailed, 'ok_rescheduled') as slot_type_detailed,
  coalesce(slot_type, 'ok_rescheduled') as slot_type""",
  "fu left join sl on fu.MRNCmpdId = sl.MRNCmpdId and fu.start_time = sl.start_time"))
def _(spark, sf):
    st = log(spark, sf)
    planned = st.filter(F.col("now_sched_for_date").isNotNull()).select(
        "MRNCmpdId", F.col("now_sched_for_date").alias("start_time")).distinct()
    return jobs.attach_outcome(planned, slots.build_slots(st, RANGE))


@query("join_current_schedule", select(f"""{SLOT_ROWS}, fut as (select FillerOrderNo, MRNCmpdId, now_sched_for_date as start_time
    from se where now_sched_for_date is not null group by 1, 2, 3),
  ls as (select * from st qualify row_number() over (partition by FillerOrderNo order by date desc, ingest_seq desc) = 1)""",
  "fut.FillerOrderNo, fut.MRNCmpdId, fut.start_time", "fut join ls on fut.FillerOrderNo = ls.FillerOrderNo and "
  "fut.start_time = ls.now_sched_for_date"))
def _(spark, sf):
    st = log(spark, sf)
    future = slots.future_slots(st, {"NoShow": slots.smallest}).select("FillerOrderNo", "MRNCmpdId", "start_time")
    current = status.last_status(st).select("FillerOrderNo", F.col("now_sched_for_date").alias("start_time"))
    return future.join(current, ["FillerOrderNo", "start_time"])


# ---------------------------------------------------------------- feature jobs

_ROW_COLS = ["modality", "occupation", "reason", "insurance_class", "sex", "age", "age_sq", "age_20_60", "marital", "post_code",
             "distance_to_usz", "distance_to_usz_sq", "close_to_usz", "times_rescheduled"]


def _feature_rows(source: str, prefix: str = "") -> str:
    """Outpatient rows of ``source`` with all row features."""
    p = prefix
    return f"""{p}o as (select {source}.* exclude (Sex), {_MODALITY} as modality, {_OCCUPATION} as occupation, {_REASON} as reason, {_CODES},
    year(date) - year(DateOfBirth) as age from {source} where patient_class_adj <> 'inpatient'),
  {p}d as (select {p}o.*, age * age as age_sq, age > 20 and age < 60 as age_20_60, distance_to_usz,
    distance_to_usz * distance_to_usz as distance_to_usz_sq, coalesce(distance_to_usz < 16, false) as close_to_usz,
    case when row_number() over (partition by PART FillerOrderNo, now_sched_for_date order by date, ingest_seq) = 1
      then 1 else 0 end as is_new
    from {p}o left join km on km_code = post_code),
  {p}r as (select *, cast(greatest(sum(is_new) over (partition by PART FillerOrderNo order by date, ingest_seq) - 2, 0)
    as bigint) as times_rescheduled from {p}d)"""


def _feature_slots(rows: str, part: str = "") -> str:
    """Future slots with features and lead times, one per patient and time."""
    keys = f"{part}FillerOrderNo, MRNCmpdId, now_sched_for_date"
    return f"""fg as (select {keys}, bool_and(NoShow) as NoShow, {last_cols(_ROW_COLS)},
    coalesce(last(Telefon order by date, ingest_seq) filter (where Telefon is not null), '0') as Telefon
    from {rows} where now_sched_for_date is not null group by {keys}),
  fd as (select *, now_sched_for_date as start_time, now_sched_for_date + interval 30 minutes as end_time from fg
    where RANGE qualify row_number() over (partition by {part}MRNCmpdId, now_sched_for_date order by NoShow,
      {_RANK}, FillerOrderNo) = 1),
  fl as (select {part}FillerOrderNo as l_fon, now_sched_for_date as l_at,
      first(now_sched_for order by date, ingest_seq) as sched_days_advanced,
      first(now_sched_for_busday order by date, ingest_seq) as sched_days_advanced_busday
    from {rows} where coalesce(was_sched_for_date <> now_sched_for_date, true) group by {part}FillerOrderNo, now_sched_for_date),
  fj as (select fd.*, sched_days_advanced, sched_days_advanced_busday from fd join fl
    on fd.FillerOrderNo = l_fon and fd.now_sched_for_date = l_at JOINPART)"""


_OUT = f"""FillerOrderNo, MRNCmpdId, start_time, end_time, NoShow, modality, occupation, reason, insurance_class, sex, age,
  age_sq, age_20_60, marital, post_code, round(distance_to_usz, 6) as distance_to_usz,
  round(distance_to_usz_sq, 6) as distance_to_usz_sq, close_to_usz, times_rescheduled, Telefon, sched_days_advanced,
  sched_days_advanced_busday, sched_days_advanced * sched_days_advanced as sched_days_advanced_sq,
  sched_days_advanced <= 2 as sched_2_days, year(start_time) as year, month(start_time) as month,
  hour(start_time) as hour_sched, isodow(start_time) - 1 as day_of_week, dayname(start_time) as day_of_week_str, {_cycles_sql()}"""
_USUAL = "isodow(start_time) < 6 and sched_days_advanced > 2 and hour(start_time) > 6 and hour(start_time) < 18"
_LO, _HI = RANGE
_FS = f"""{STATUS}, {_DIST}, {_feature_rows('st', 'x').replace('PART ', '')},
  {_feature_slots('xr').replace('RANGE', f"now_sched_for_date >= timestamp '{_LO}' and now_sched_for_date < timestamp '{_HI}' + interval 1 day").replace('JOINPART', '')}"""
FEATURE_OUT = ["FillerOrderNo", "MRNCmpdId", "start_time", "end_time", "NoShow", *_ROW_COLS, "Telefon", "sched_days_advanced",
               "sched_days_advanced_busday", "sched_days_advanced_sq", "sched_2_days", "year", "month", "hour_sched",
               "day_of_week", "day_of_week_str", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin",
               "month_cos"]


@query("build_feature_set", select(f"{_FS}, {_history_sql('fj')}", f"{_OUT}, {_HIST}", "nb", f"where {_USUAL}"))
def _(spark, sf):
    return jobs.build_feature_set(log(spark, sf), RANGE, C.post_codes(spark, sf), C.SITE_POST_CODE).select(
        *FEATURE_OUT, *features.HISTORY_COLUMNS)


_NOT_NULL = " and ".join(f"{c} is not null" for c in [*_ROW_COLS, "Telefon", "sched_days_advanced"])


def _ahead_sql(day: str, lo: int, hi: int, tail: str) -> str:
    """Features as of one day, written for that day alone."""
    first, last_ = add_bd(f"date '{day}'", lo), add_bd(f"date '{day}'", hi)
    known = f"""{STATUS}, {_DIST},
  kn0 as (select * from st where cast(date as date) < date '{day}'),
  ls as (select FillerOrderNo as ls_fon, now_status as ls_status, now_sched_for_date as ls_at, now_sched_for_busday as ls_bd
    from kn0 qualify row_number() over (partition by FillerOrderNo order by date desc, ingest_seq desc) = 1),
  kn as (select * from kn0 where FillerOrderNo not in (select ls_fon from ls where ls_status = 'canceled' and ls_bd > 3))"""
    return f"""{known}, {_feature_rows('kn', 'x').replace('PART ', '')},
  {_feature_slots('xr').replace('RANGE', f"cast(now_sched_for_date as date) between {first} and {last_}").replace('JOINPART', '')},
  {_history_sql('fj')}, ah as (select * replace (false as NoShow) from nb join ls on FillerOrderNo = ls_fon and start_time = ls_at
    where {_USUAL} and {_NOT_NULL}) {tail}"""


@query("features_ahead", _ahead_sql("2024-01-22", 3, 5, "").join(["with ", f" select {_OUT}, {_HIST} from ah"]))
def _(spark, sf):
    return jobs.features_ahead(log(spark, sf), "2024-01-22", C.post_codes(spark, sf), C.SITE_POST_CODE).select(
        *FEATURE_OUT, *features.HISTORY_COLUMNS)


@query("features_ahead_live", _ahead_sql("2024-01-22", 0, 2, "").join(["with ", f" select {_OUT}, {_HIST} from ah"]))
def _(spark, sf):
    return jobs.features_ahead(log(spark, sf), "2024-01-22", C.post_codes(spark, sf), C.SITE_POST_CODE, live=True).select(
        *FEATURE_OUT, *features.HISTORY_COLUMNS)


# The oracle really joins the log with every snapshot day, which the engine avoids.
_SNAP = f"""{STATUS}, {_DIST},
  days as (select cast(d as date) as snapshot from generate_series(date '2023-12-25', date '{_HI}', interval 1 day) g(d)
    where isodow(d) < 6),
  win as (select snapshot, {add_bd('snapshot', 3)} as lo, {add_bd('snapshot', 5)} as hi from days),
  per as (select distinct snapshot, lo, hi, FillerOrderNo as p_fon from win join st
    on cast(now_sched_for_date as date) between lo and hi),
  kn0 as (select per.snapshot, lo, hi, st.* from per join st on p_fon = FillerOrderNo and cast(date as date) < snapshot),
  ls as (select snapshot as ls_snap, FillerOrderNo as ls_fon, now_status as ls_status, now_sched_for_date as ls_at,
      now_sched_for_busday as ls_bd from kn0
    qualify row_number() over (partition by snapshot, FillerOrderNo order by date desc, ingest_seq desc) = 1),
  kn as (select kn0.* from kn0 join ls on snapshot = ls_snap and FillerOrderNo = ls_fon
    where not (ls_status = 'canceled' and ls_bd > 3)),
  {_feature_rows('kn', 'x').replace('PART ', 'snapshot, ')},
  {_feature_slots('xr', 'snapshot, lo, hi, ').replace('RANGE', 'cast(now_sched_for_date as date) between lo and hi')
   .replace('snapshot, lo, hi, FillerOrderNo as l_fon', 'snapshot as l_snap, FillerOrderNo as l_fon')
   .replace('JOINPART', 'and fd.snapshot = l_snap')},
  sn as (select fj.* from fj join ls on fj.snapshot = ls_snap and FillerOrderNo = ls_fon and start_time = ls_at
    where {_USUAL} and {_NOT_NULL})"""


@query("snapshot_range_join", select(_SNAP, f"cast(snapshot as timestamp) as snapshot, {_OUT.replace('end_time, NoShow', 'end_time, false as NoShow')}",
                                     "sn"))
def _(spark, sf):
    chunks = ordered.find_hot_chunks(C.status(spark, sf), status.KEY, ["History_MessageDtTm", "ingest_seq"])
    return jobs.snapshots(log(spark, sf), "2023-12-25", _HI, C.post_codes(spark, sf), C.SITE_POST_CODE, chunks=chunks).select(
        "snapshot", *FEATURE_OUT)


_ACTUAL = SLOTS.split("st as (", 1)[1].split(",\nse0 as", 1)[1]
_TRAIN = f"""{_SNAP},
se0 as{_ACTUAL.replace(f"timestamp '{_LO}' and start_time <", "timestamp '2023-12-25' and start_time <")},
tr0 as (select * from sn where cast(start_time as date) >= date '{_LO}' and cast(start_time as date) <= date '{_HI}'
  qualify row_number() over (partition by MRNCmpdId, start_time order by {_RANK}, snapshot, FillerOrderNo) = 1),
tr as (select tr0.* exclude (NoShow), coalesce(sl.NoShow, false) as NoShow,
    coalesce(sl.slot_outcome, 'ok_rescheduled') as slot_outcome,
    coalesce(sl.slot_type_detailed, 'ok_rescheduled') as slot_type_detailed, coalesce(sl.slot_type, 'ok_rescheduled') as slot_type
  from tr0 left join sl on tr0.MRNCmpdId = sl.MRNCmpdId and tr0.start_time = sl.start_time),
{_history_sql('tr')}"""


@query("generate_training_data", select(_TRAIN, f"cast(snapshot as timestamp) as snapshot, slot_outcome, slot_type_detailed, "
                                        f"slot_type, {_OUT}, {_HIST}", "nb"))
def _(spark, sf):
    raw = C.status(spark, sf).withColumn("MRNCmpdId", text.strip_suffix(F.col("MRNCmpdId")))
    chunks = jobs.find_log_chunks(raw, "History_MessageDtTm", "History_ObsStartPlanDtTm")
    # The job reads the log three times, so it is stored first, as in a daily run.
    return jobs.training_data(cut_lineage(log(spark, sf), "status"), RANGE, C.post_codes(spark, sf), C.SITE_POST_CODE, chunks=chunks).select(
        "snapshot", "slot_outcome", "slot_type_detailed", "slot_type", *FEATURE_OUT, *features.HISTORY_COLUMNS)


# ---------------------------------------------------------------- live tables

_CUT = "2000-01-01"


@query("anti_join_new_rows", select(F_SLOTS, "FillerOrderNo, start_time, MRNCmpdId", "f",
       f"where not exists (select 1 from orders o where o.o_orderkey = f.FillerOrderNo and o_orderdate < date '{_CUT}')"))
def _(spark, sf):
    df = finished(spark, sf)
    history = df.filter(F.col("start_time") < F.lit(_CUT).cast("timestamp_ntz"))
    return live_jobs.new_rows(df.select("FillerOrderNo", "start_time", "MRNCmpdId"), history)


@query("lookup_fill", select(f"""{S}, side as (select FillerOrderNo as k, min(ReasonForStudy) as fill from s
  where ReasonForStudy is not null group by 1)""", f"{ID}, coalesce(ReasonForStudy, fill) as ReasonForStudy",
  "s left join side on k = FillerOrderNo"))
def _(spark, sf):
    df = C.status(spark, sf)
    return live_jobs.lookup_fill(df, df.select("FillerOrderNo", "ReasonForStudy"), "FillerOrderNo", "ReasonForStudy").select(
        *IDS, "ReasonForStudy")


@query("union_common_columns", select(F_SLOTS, """cast(FillerOrderNo as double) as FillerOrderNo, MRNCmpdId, start_time, NoShow
  from f where start_time < timestamp '2000-01-01' union all select cast(FillerOrderNo as double), MRNCmpdId, start_time, NoShow""",
  "f", "where start_time >= timestamp '1999-01-01'"))
def _(spark, sf):
    df = finished(spark, sf)
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    master = df.filter(F.col("start_time") < at("2000-01-01")).select("FillerOrderNo", "MRNCmpdId", "start_time", "NoShow", "age")
    live = df.filter(F.col("start_time") >= at("1999-01-01")).select(
        F.col("FillerOrderNo").cast("double").alias("FillerOrderNo"), "MRNCmpdId", "start_time", "NoShow", "price")
    return scoring.common_columns(master, live)


@query("late_outcome_attach", select(f"{F_SLOTS}, known as (select MRNCmpdId as m, start_time as t, max(NoShow) as NoShow from f "
  "where start_time < timestamp '2000-01-01' group by 1, 2)", """FillerOrderNo, MRNCmpdId, start_time,
  coalesce(known.NoShow, false) as NoShow""", "f left join known on m = MRNCmpdId and t = start_time",
  "where start_time <= (select max(t) from known)"))
def _(spark, sf):
    df = finished(spark, sf)
    known = df.filter(F.col("start_time") < F.lit("2000-01-01").cast("timestamp_ntz")).groupBy("MRNCmpdId", "start_time").agg(
        F.max("NoShow").alias("NoShow"))
    return live_jobs.attach_late_outcome(df, known).select("FillerOrderNo", "MRNCmpdId", "start_time", "NoShow")
