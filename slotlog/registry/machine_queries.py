"""Images and machine utilisation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from slotlog import carriers as C
from slotlog import constants as K
from slotlog.functions.dates import image_clock
from slotlog.operators import cleaning, features, images, ordered, utilisation
from slotlog.plans import machine_jobs
from slotlog.registry import query
from slotlog.registry.sql import SLOTS, in_list, select
from slotlog.registry.status_queries import slot_table

I = f"i as ({C.image_sql(C.DUCK)})"
AS_OF = dt.date(2024, 2, 1)


# ---------------------------------------------------------------- images

@query("numeric_id_only", select(I, "cast(AccessionNumber as bigint) as AccessionNumber, SopImageUid", "i",
                                 "where try_cast(AccessionNumber as double) is not null"))
def _(spark, sf):
    return cleaning.numeric_ids(C.images(spark, sf)).select("AccessionNumber", "SopImageUid")


@query("semi_join_ids", select(I, "cast(AccessionNumber as bigint) as AccessionNumber, SopImageUid", "i",
       "where try_cast(AccessionNumber as bigint) in (select o_orderkey from orders where o_orderstatus = 'F')"))
def _(spark, sf):
    known = C.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("AccessionNumber"))
    return images.keep_known_appointments(C.images(spark, sf), known).select("AccessionNumber", "SopImageUid")


@query("distinct_rows_nonnull_keys", select(I, "distinct AccessionNumber, StationName, AcquisitionDate", "i",
                                            "where AccessionNumber is not null and AcquisitionDate is not null"))
def _(spark, sf):
    return cleaning.distinct_with_keys(
        C.images(spark, sf).select("AccessionNumber", "StationName", "AcquisitionDate"), ["AccessionNumber", "AcquisitionDate"])


@query("map_station_code", select(I, """AccessionNumber, SopImageUid, case StationName when 'MT00000173' then 1 else 2 end
  as StationName""", "i", f"where StationName in {in_list(K.STATION_DEVICE)}"))
def _(spark, sf):
    return cleaning.map_stations(C.images(spark, sf)).select("AccessionNumber", "SopImageUid", "StationName")


@query("dicom_time_parse", select(I, "SopImageUid, acq_source as acq_datetime", "i"))
def _(spark, sf):
    return C.images(spark, sf).select(
        "SopImageUid", image_clock(F.col("AcquisitionDate"), F.col("AcquisitionTime")).alias("acq_datetime"))


_IT = f"""{I},
it as (select distinct AccessionNumber, case StationName when 'MT00000173' then 1 else 2 end as StationName, SopImageUid,
    AcquisitionDate, acq_source as acq from i where StationName in {in_list(K.STATION_DEVICE)}),
ig as (select *, lag(acq) over w as acq_prev, lead(acq) over w as acq_next from it
  window w as (partition by AccessionNumber order by acq, SopImageUid)),
ih as (select *, date_diff('microsecond', acq, acq_next) / 1e6 as gap_next, date_diff('microsecond', acq_prev, acq) / 1e6 as gap_prev
  from ig),
ir as (select *, case when max(greatest(gap_next, gap_prev)) over (partition by AccessionNumber) > 1800 then 1 else 0 end as big,
    rank() over (partition by AccessionNumber order by acq)
      + (count(*) over (partition by AccessionNumber, acq) - 1) / 2.0 as rk,
    rank() over (partition by AccessionNumber order by acq desc)
      + (count(*) over (partition by AccessionNumber, acq) - 1) / 2.0 as rk_rev
  from ih),
ic as (select *, max(case when rk <= 5 and gap_next > 1800 then rk end) over (partition by AccessionNumber) as cut,
    max(case when rk_rev <= 5 and gap_prev > 1800 then rk_rev end) over (partition by AccessionNumber) as cut_rev from ir),
tm as (select * from ic where not coalesce(rk <= cut, false) and not coalesce(rk_rev <= cut_rev, false))"""
_GAP = """AccessionNumber, SopImageUid, acq as acq_datetime, acq_prev as acq_prev_datetime, acq_next as acq_next_datetime,
  round(gap_next, 6) as time_between_next_image, round(gap_prev, 6) as time_between_prev_image, big as big_image_gap,
  cast(rk as double) as img_rank, cast(rk_rev as double) as img_rank_rev"""
_GAP_COLS = ["AccessionNumber", "SopImageUid", "acq_datetime", "acq_prev_datetime", "acq_next_datetime",
             "time_between_next_image", "time_between_prev_image", "big_image_gap", "img_rank", "img_rank_rev"]


def timed(spark, sf):
    df = cleaning.distinct_with_keys(cleaning.map_stations(C.images(spark, sf)), ["AccessionNumber", "AcquisitionDate"])
    df = images.add_image_time(df)
    return ordered.split_hot_keys(df, images.KEY, "acq_datetime")


@query("image_time_columns", select(_IT, _GAP, "ir"))
def _(spark, sf):
    return images.add_gap_columns(timed(spark, sf)).select(*_GAP_COLS)


@query("trim_edge_gaps", select(_IT, _GAP, "tm"))
def _(spark, sf):
    return images.trim_edges(images.add_gap_columns(timed(spark, sf))).select(*_GAP_COLS)


@query("preprocess_images", select(_IT, f"StationName, AcquisitionDate, {_GAP}", "tm"))
def _(spark, sf):
    return images.preprocess(C.images(spark, sf), split_hot=True).select("StationName", "AcquisitionDate", *_GAP_COLS)


@query("image_interval", select(_IT, """AccessionNumber, StationName as image_device_id, min(acq) as image_start,
  max(acq) as image_end""", "tm", "group by AccessionNumber, big, StationName"))
def _(spark, sf):
    return machine_jobs.image_times(C.images(spark, sf))


@query("eav_pivot", "select event_id as \"SeriesUID\", user_id as \"SopImageUid\", event_id % 7 as \"StudyUID\", event_type as "
       "\"AccessionNumber\", strftime(ts, '%Y%m%d') as \"AcquisitionDate\" from events")
def _(spark, sf):
    e = C.table(spark, sf, "events")
    tags = e.select(
        F.col("event_id").alias("SeriesUID"), F.col("user_id").alias("SopImageUid"), (F.col("event_id") % 7).alias("StudyUID"),
        F.expr("stack(3, 'AccessionNumber', event_type, 'AcquisitionDate', date_format(ts, 'yyyyMMdd'), 'AccessionNumber', "
               "event_type) as (tag_name, Value)"))
    return images.pivot_tags(tags, ["AccessionNumber", "AcquisitionDate"])


V = f"v as ({C.interval_sql(C.DUCK)})"


@query("duration_minutes", select(V, """AccessionNumber, date_diff('microsecond', image_start, image_end) as duration_us,
  date_diff('microsecond', image_start, image_end) / 60e6 > 20 as is_long""", "v"))
def _(spark, sf):
    df = features.add_duration(C.intervals(spark, sf))
    return df.select("AccessionNumber", F.round(F.col("duration") * 60_000_000).cast("long").alias("duration_us"),
                     (F.col("duration") > 20).alias("is_long"))


_INTEGRATE = f"""{SLOTS}, {V}, tm as (select AccessionNumber * 100 as AccessionNumber, image_device_id, image_start, image_end from v
    where AccessionNumber % 2 = 0 union all select AccessionNumber * 100 + 1, image_device_id, image_start, image_end from v
    where AccessionNumber % 2 = 1)"""


@query("integrate_dicom", select(_INTEGRATE, """FillerOrderNo, MRNCmpdId, slot_type,
  case when slot_type in ('show', 'inpatient') and image_start is not null then image_start else start_time end as start_time,
  case when slot_type in ('show', 'inpatient') and image_end is not null then image_end else end_time end as end_time,
  start_time as status_start, end_time as status_end, EnteringOrganisationDeviceID as device_from_status,
  case when image_device_id is not null then 'MR' || image_device_id else EnteringOrganisationDeviceID end
    as EnteringOrganisationDeviceID""", "sl left join tm on AccessionNumber = FillerOrderNo"))
def _(spark, sf):
    a = F.col("AccessionNumber")
    times = C.intervals(spark, sf).withColumn("AccessionNumber", a * 100 + a % 2)
    return images.integrate(slot_table(spark, sf), times).select(
        "FillerOrderNo", "MRNCmpdId", "slot_type", "start_time", "end_time", "status_start", "status_end",
        "device_from_status", "EnteringOrganisationDeviceID")


# ---------------------------------------------------------------- calendar

_DAY = "case Wochentag when 'MO' then 'Monday' when 'DI' then 'Tuesday' when 'MI' then 'Wednesday' when 'DO' then 'Thursday' " \
       "when 'FR' then 'Friday' end"
_OPEN = f"""r as ({C.raster_sql(C.DUCK)}),
oh as (select case Terminbuch when 'MR1' then 1 else 2 end as image_device_id, {_DAY} as day_of_week, TERMINRASTER_NAME,
    strptime(coalesce(gueltig_von, '01.01.2014'), '%d.%m.%Y') as applicable_from,
    strptime(coalesce(gueltig_bis, '31.12.2055'), '%d.%m.%Y') as applicable_to,
    min(split_part(Termin, ':', 1)::int * 3600 + split_part(Termin, ':', 2)::int * 60) as day_start_tp,
    max((split_part(Termin, ':', 1)::int * 3600 + split_part(Termin, ':', 2)::int * 60 + dauer_min * 60) % 86400) as day_end_tp,
    cast(sum(dauer_min) as bigint) as day_length_tp from r group by 1, 2, 3, 4, 5)"""
_END = f"timestamp '{AS_OF.year + 3}-12-31'"
_FILL = f"""{_OPEN},
ok as (select *, rank() over w as rk, rank() over v as rk_rev from oh
  window w as (partition by image_device_id, day_of_week, TERMINRASTER_NAME order by applicable_from),
    v as (partition by image_device_id, day_of_week, TERMINRASTER_NAME order by applicable_from desc)),
cal as (select * exclude (rk, rk_rev) from ok
  union all by name select * exclude (rk, rk_rev) replace (timestamp '2014-01-01' as applicable_from,
    applicable_from - interval 1 day as applicable_to) from ok where rk = 1
  union all by name select * exclude (rk, rk_rev) replace (applicable_to + interval 1 day as applicable_from,
    {_END} as applicable_to) from ok where rk_rev = 1 and applicable_to < {_END})"""


@query("opening_hours_agg", select(_OPEN, "*", "oh"))
def _(spark, sf):
    return utilisation.opening_hours(C.raster(spark, sf))


@query("calendar_gap_fill", select(_FILL, "*", "cal"))
def _(spark, sf):
    return utilisation.fill_calendar(utilisation.opening_hours(C.raster(spark, sf)), AS_OF)


def hours(spark, sf):
    return utilisation.fill_calendar(utilisation.opening_hours(C.raster(spark, sf)), AS_OF)


_JOIN = f"""{_FILL}, {V},
jc as (select v.AccessionNumber, v.image_device_id, image_start, image_end, date_trunc('day', image_start) as date,
    cal.day_of_week, TERMINRASTER_NAME, day_length_tp,
    date_trunc('day', image_start) + to_seconds(day_start_tp) as day_start, date_trunc('day', image_start) + to_seconds(day_end_tp)
      as day_end
  from v join cal on cal.day_of_week = dayname(image_start) and cal.image_device_id = v.image_device_id
    and image_start >= applicable_from and image_start <= applicable_to
  where isodow(image_start) < 6)"""


@query("interval_join_calendar", select(_JOIN, """AccessionNumber, image_device_id, image_start, image_end,
  cast(date as timestamp) as date, day_start as day_start_tp, day_end as day_end_tp""", "jc"))
def _(spark, sf):
    return utilisation.join_calendar(C.intervals(spark, sf), hours(spark, sf)).select(
        "AccessionNumber", "image_device_id", "image_start", "image_end", "date", "day_start_tp", "day_end_tp")


# ---------------------------------------------------------------- gaps
# The oracle builds the closing rows by a union and orders the day again.

_B = K.BUFFER_MINUTES * 60_000_000
_GAPS = f"""{_JOIN},
wd as (select *, rank() over (partition by date, image_device_id order by image_start) as r1,
    rank() over (partition by date, image_device_id order by image_start desc) as r2,
    count(*) over (partition by date, image_device_id, image_start) as ties
  from jc where image_end > day_start and image_start < day_end),
fl as (select *, cast(r1 = 1 and ties = 1 as int) as first_appt, cast(r2 = 1 and ties = 1 as int) as last_appt from wd),
al as (select AccessionNumber, image_device_id, date, image_start, image_end, day_start, day_end, first_appt,
    case when (last_appt = 1 and image_end >= day_end) or (first_appt = 1 and image_start <= day_start) then 1 else 0 end
      as one_side_buffer_flag from fl
  union all select null, image_device_id, date, day_end, day_end, day_start, day_end, null, 1
  from fl where last_appt = 1 and image_end < day_end),
pv as (select *, lag(image_end) over (partition by date, image_device_id order by image_start, AccessionNumber nulls last)
    as previous_end_shift from al),
pe as (select *, case when first_appt = 1 and image_start > day_start then day_start
    when previous_end_shift < image_start then previous_end_shift end as previous_end from pv),
hb as (select *, case when previous_end is not null then
    least(date_diff('microsecond', previous_end, image_start), {2 * _B}) // 2 end as half from pe),
gp as (select *, case when one_side_buffer_flag = 0 and first_appt = 1 then previous_end
      else previous_end + to_microseconds(half) end as previous_end_buffer,
    case when AccessionNumber is null and one_side_buffer_flag = 1 then image_start
      else image_start - to_microseconds(half) end as image_start_buffer from hb),
ag as (select date, image_device_id, image_start as start, image_end as "end", 'active' as status from gp
  union all select date, image_device_id, previous_end_buffer, image_start_buffer, 'idle' from gp
    where previous_end_buffer is not null and cast(previous_end_buffer as date) = cast(image_start_buffer as date)
  union all select date, image_device_id, previous_end, previous_end_buffer, 'buffer' from gp
    where previous_end_buffer is not null and cast(previous_end as date) = cast(previous_end_buffer as date)
  union all select date, image_device_id, image_start_buffer, image_start, 'buffer' from gp
    where image_start_buffer is not null and cast(image_start_buffer as date) = cast(image_start as date)),
ah as (select *, date_diff('microsecond', start, "end") / 3.6e9 as status_duration from ag),
dy as (select *, least(date_diff('microsecond', start, "end") / 3.6e9, 24) as total_time from (
  select date, image_device_id, sum(status_duration) filter (where status = 'buffer') as buffer,
    sum(status_duration) filter (where status = 'idle') as idle, min(start) as start, max("end") as "end"
  from ah group by 1, 2) d),
ds as (select *, total_time - buffer - idle as active from dy)"""


@query("idle_gaps", select(_GAPS, """AccessionNumber, image_device_id, cast(date as timestamp) as date, image_start, image_end,
  first_appt, one_side_buffer_flag, previous_end, previous_end_buffer, image_start_buffer""", "gp"))
def _(spark, sf):
    return utilisation.idle_gaps(C.intervals(spark, sf), hours(spark, sf), K.BUFFER_MINUTES, split_hot=True).select(
        "AccessionNumber", "image_device_id", "date", "image_start", "image_end", "first_appt", "one_side_buffer_flag",
        "previous_end", "previous_end_buffer", "image_start_buffer")


def pieces(spark, sf):
    return machine_jobs.idle_time(C.intervals(spark, sf), C.raster(spark, sf), AS_OF)


_PIECES = """cast(date as timestamp) as date, image_device_id, start, "end", status, round(status_duration, 6) as status_duration"""


@query("appts_and_gaps", select(_GAPS, _PIECES, "ah"))
def _(spark, sf):
    return utilisation.appts_and_gaps(
        utilisation.idle_gaps(C.intervals(spark, sf), hours(spark, sf), K.BUFFER_MINUTES, split_hot=True))


@query("idle_time", select(_GAPS, _PIECES, "ah"))
def _(spark, sf):
    return pieces(spark, sf)


_SHARES = ", ".join(f"round({s}, 6) as {s}, round({s} / nullif(total_time, 0), 6) as {s}_pct" for s in ("active", "buffer", "idle"))


@query("idle_daily", select(_GAPS, f"""cast(date as timestamp) as date, image_device_id, start, "end",
  round(total_time, 6) as total_time, {_SHARES}""", "ds"))
def _(spark, sf):
    return utilisation.daily_stats(pieces(spark, sf))


def _period(grain: str, key: str) -> str:
    sums = ", ".join(f"coalesce(sum({s}), 0) as {s}" for s in ("active", "buffer", "idle", "total_time"))
    return f"{_GAPS}, pr as (select {key} as {grain}, image_device_id, {sums} from ds group by 1, 2)"


@query("idle_monthly", select(_period("month", "cast(date_trunc('month', date) as timestamp)"),
                              f"month, image_device_id, round(total_time, 6) as total_time, {_SHARES}", "pr"))
def _(spark, sf):
    return utilisation.period_stats(utilisation.daily_stats(pieces(spark, sf)), "month")


@query("idle_yearly", select(_period("year", "year(date)"),
                             f"year, image_device_id, round(total_time, 6) as total_time, {_SHARES}", "pr"))
def _(spark, sf):
    return utilisation.period_stats(utilisation.daily_stats(pieces(spark, sf)), "year")


@query("melt_metrics", "with " + _GAPS + " " + " union all ".join(
    f"select cast(date as timestamp) as date, image_device_id, round({s} / nullif(total_time, 0), 6) as hours, "
    f"'{s.capitalize()}' as machine_status from ds" for s in ("active", "idle", "buffer")))
def _(spark, sf):
    return utilisation.melt_stats(utilisation.daily_stats(pieces(spark, sf)), "date")
