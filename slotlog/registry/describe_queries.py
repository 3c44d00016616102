"""Descriptive tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from slotlog import carriers as C
from slotlog import constants as K
from slotlog.functions import rules
from slotlog.operators import describe, features
from slotlog.registry import query
from slotlog.registry.feature_queries import F_SLOTS, finished
from slotlog.registry.machine_queries import V
from slotlog.registry.sql import case_map, in_list, select

_RATE = """round(avg(NoShow::int), 6) as no_show_rate, cast(sum(NoShow::int) as bigint) as no_shows, count(*) as appointments"""

for _by, _expr, _where in (("day_of_week_str", "dayname(start_time)", "where isodow(start_time) < 6"),
                           ("month", "month(start_time)", ""),
                           ("hour_sched", "hour(start_time)", "where hour(start_time) > 6 and hour(start_time) < 18"),
                           ("age", "age", "")):
    query(f"no_show_rate_by_{_by}", select(F_SLOTS, f"{_expr} as {_by}, {_RATE}", "f", f"{_where} group by 1"))(
        lambda spark, sf, by=_by: describe.no_show_rate_by(features.add_calendar(finished(spark, sf)), by))

_PP = "pp as (select MRNCmpdId, count(*) as num_appts, cast(sum(NoShow::int) as bigint) as num_noshow from f group by 1)"


@query("appts_per_patient_hist", select(f"{F_SLOTS}, {_PP}", "num_appts, count(*) as num_patients", "pp", "group by 1"))
def _(spark, sf):
    return describe.appointments_per_patient(finished(spark, sf))


@query("appt_noshow_heatmap", select(f"{F_SLOTS}, {_PP}", """num_appts, num_noshow, count(*) as num_patients,
  round(num_noshow / num_appts, 6) as percent_missed""", "pp", "group by 1, 2"))
def _(spark, sf):
    return describe.no_show_heat_map(finished(spark, sf))


@query("appt_noshow_buckets", select(f"""{F_SLOTS}, {_PP},
  bn as (select case when num_appts = 1 then '1' when num_appts = 2 then '2' else '>2' end as a,
    case when num_noshow = 0 then '0' when num_noshow = 1 then '1' when num_noshow = 2 then '2' else '>2' end as n from pp)""",
  "ta.num_appts, tn.num_noshow, count(bn.a) as num_patients", "(values ('1'), ('2'), ('>2')) ta(num_appts) cross join "
  "(values ('0'), ('1'), ('2'), ('>2')) tn(num_noshow) left join bn on a = num_appts and n = num_noshow", "group by 1, 2"))
def _(spark, sf):
    return describe.no_show_buckets(finished(spark, sf))


_START, _END = dt.date(1996, 1, 1), dt.date(2000, 6, 15)


@query("appt_type_counts_over_time", select(F_SLOTS, """cast(date_trunc('month', start_time) as timestamp) as year_month,
  slot_type_detailed, count(*) as appts""", "f", """where start_time >= timestamp '1996-01-01'
  and start_time < date_trunc('week', date '2000-06-15') group by 1, 2"""))
def _(spark, sf):
    return describe.types_over_time(finished(spark, sf), _START, _END)


@query("appt_type_share_by_weekday", select(f"""{F_SLOTS}, w as (select dayname(start_time) as weekday, isodow(start_time) as n,
  slot_type_detailed from f where start_time >= timestamp '1996-01-01' and start_time < timestamp '2000-06-15')""",
  """slot_type_detailed, weekday, round(count(*) / sum(count(*)) over (partition by weekday), 6) as percent""", "w",
  "where n < 6 group by 1, 2"))
def _(spark, sf):
    return describe.type_share_by_weekday(finished(spark, sf), _START, _END)


@query("positive_rate_crosstab", select(F_SLOTS, "priority, count(*) as frequencies, round(avg(NoShow::int), 6) as rate", "f",
                                        "group by 1"))
def _(spark, sf):
    return describe.positive_rate(finished(spark, sf), "NoShow", "priority")


@query("appt_len_by_type", select(f"""{V}, l as (select {C.pick('AccessionNumber', C.SERVICES, True)} as UniversalServiceName,
  date_diff('microsecond', image_start, image_end) / 60e6 as len from v)""", """UniversalServiceName, count(*) as n,
  round(avg(len), 6) as mean, round(min(len), 6) as min, round(max(len), 6) as max, round(quantile_cont(len, 0.25), 6) as q1,
  round(quantile_cont(len, 0.5), 6) as median, round(quantile_cont(len, 0.75), 6) as q3""", "l",
  "where len < 1000 and UniversalServiceName <> 'MR Herz' group by 1"))
def _(spark, sf):
    df = C.intervals(spark, sf).withColumn("UniversalServiceName", F.expr(C.pick("AccessionNumber", C.SERVICES)))
    return describe.lengths_by_type(df, exclude="MR Herz")


@query("appt_len_by_weekday_and_device", select(f"""{V}, l as (select *, dayname(image_start) as weekday,
  date_diff('microsecond', image_start, image_end) / 60e6 as len from v)""", """weekday, cast(image_device_id as bigint) as image_device_id, count(*) as n,
  round(avg(len), 6) as mean, round(min(len), 6) as min, round(max(len), 6) as max, round(quantile_cont(len, 0.25), 6) as q1,
  round(quantile_cont(len, 0.5), 6) as median, round(quantile_cont(len, 0.75), 6) as q3""", "l", "where len < 1000 group by weekday, image_device_id"))
def _(spark, sf):
    df = C.intervals(spark, sf).withColumn("weekday", F.date_format("image_start", "EEEE"))
    return describe.lengths_by(df, "weekday", "image_device_id")


P = f"p as ({C.score_sql(C.DUCK)})"
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "score"]


@query("pairwise_correlation", "with " + P + " " + " union all ".join(
    f"select '{a}, {b}' as varcomb, round(corr({a}, {b}), 6) as correlation from p"
    for i, a in enumerate(sorted(_NUM)) for b in sorted(_NUM)[i + 1:]))
def _(spark, sf):
    return describe.pairwise_correlation(C.scores(spark, sf), _NUM)


# ---------------------------------------------------------------- intervention

_FEEDBACK = "case FillerOrderNo % 6 when 0 then 'comes' when 1 then 'not reached' when 2 then 'to be rescheduled' " \
            "when 3 then 'appt not found' when 4 then 'comes' end"
_CONTROL = "case when (FillerOrderNo + age) % 2 = 0 then 'control' else 'intervention' end"


@query("feedback_recode", select(F_SLOTS, f"""FillerOrderNo, {case_map(_FEEDBACK, K.FEEDBACK_REACHED)} as reached,
  {case_map(_FEEDBACK, K.FEEDBACK_REACHED_2)} as reached_2""", "f"))
def _(spark, sf):
    fb = F.expr(_FEEDBACK)
    return finished(spark, sf).select("FillerOrderNo", rules.reached(fb).alias("reached"), rules.reached_2(fb).alias("reached_2"))


def _files(df):
    """Every slot in one file, every third one in a second file with other entries."""
    a = df.withColumns({"file": F.lit("a"), "control": F.expr(_CONTROL)})
    b = df.filter("FillerOrderNo % 3 = 0").withColumns({"file": F.lit("b"), "control": F.lit("intervention"),
                                                       "EnteringOrganisationDeviceID": F.lit(None).cast("string")})
    return a.unionByName(b)


_LATEST = f"""{F_SLOTS}, fi as (select *, 'a' as file, {_CONTROL} as control, EnteringOrganisationDeviceID as dev from f
  union all select *, 'b', 'intervention', null from f where FillerOrderNo % 3 = 0)"""


@query("latest_per_key", select(_LATEST, """FillerOrderNo, start_time, last(control order by file) as control,
  last(dev order by file) filter (where dev is not null) as device""", "fi", "group by 1, 2"))
def _(spark, sf):
    return describe.latest_per_slot(_files(finished(spark, sf)).withColumnRenamed("EnteringOrganisationDeviceID", "device")
                                    .select("FillerOrderNo", "start_time", "file", "control", "device")).drop("file")


_RESULT = f"""{_LATEST},
fa as (select * from fi where start_time < (select max(start_time) from f)),
fk as (select FillerOrderNo, start_time, file, control, NoShow, {_FEEDBACK} as fb from fa),
fc as (select *, case when control = 'control' then 'control' else fb end as feedback from fk
  where fb is null or fb not in {in_list(K.FEEDBACK_IGNORED)}),
fl as (select FillerOrderNo, start_time, last(control order by file) as control, bool_or(NoShow) as NoShow,
    last(feedback order by file) filter (where feedback is not null) as feedback from fc group by 1, 2),
fr as (select *, {case_map('feedback', K.FEEDBACK_REACHED)} as reached, {case_map('feedback', K.FEEDBACK_REACHED_2)} as reached_2
  from fl),
fg as (select 'control' as grain, control, null::varchar as feedback, null::varchar as reached, null::varchar as reached_2, NoShow
    from fr
  union all select 'control+feedback', control, feedback, null, null, NoShow from fr where feedback is not null
  union all select 'reached', null, null, reached, null, NoShow from fr where reached is not null
  union all select 'reached_2', null, null, null, reached_2, NoShow from fr where reached_2 is not null)"""


@query("intervention_results", select(_RESULT, """grain, control, feedback, reached, reached_2, count(*) as n,
  cast(sum(NoShow::int) as bigint) as no_shows, round(avg(NoShow::int), 6) as rate""", "fg", "group by 1, 2, 3, 4, 5"))
def _(spark, sf):
    df = finished(spark, sf)
    actuals = df.select("FillerOrderNo", "start_time", "NoShow")
    feedback = df.select("FillerOrderNo", "start_time", F.expr(_FEEDBACK).alias("feedback"))
    files = _files(df).select("FillerOrderNo", "start_time", "NoShow", "file", "control")
    return describe.intervention_results(describe.prepare_intervention(files, actuals, feedback))
