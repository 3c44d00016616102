"""Observed against derived slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotlog import carriers as C
from slotlog.functions import rules
from slotlog.functions.dates import day_first
from slotlog.operators import slots, validation
from slotlog.plans import validation_jobs
from slotlog.registry import query
from slotlog.registry.sql import S, SLOTS, busday, select
from slotlog.registry.status_queries import slot_table
from slotlog.session import cut_lineage

D = f"{S}, d as ({C.observation_sql(C.DUCK, 's')})"

# ob: typed observations; pr: before and after side by side; lb: labelled; os: one per patient and time.
PAIRS = f"""{D},
ob as (select patient_id, ingest_seq, machine, type, strptime(date || ' ' || start_time, '%d.%m.%Y %H:%M') as start_time,
    strptime(date, '%d.%m.%Y') as date, strptime(date_recorded, '%d.%m.%Y') as date_recorded from d),
og as (select *, {busday('date', 'date_recorded')} as date_diff from ob),
bf as (select * from og where date_diff < 0 qualify row_number() over (partition by patient_id, date
  order by date_recorded desc, start_time desc, ingest_seq desc) = 1),
af as (select * from og where date_diff = 1),
pr as (select coalesce(bf.patient_id, af.patient_id) as patient_id, coalesce(bf.date, af.date) as date,
    coalesce(bf.start_time, af.start_time) as start_time, bf.type as type_before, af.type as type_after,
    bf.date_diff as date_diff_before, bf.machine as machine_before, af.machine as machine_after,
    bf.ingest_seq as ingest_seq_before, af.ingest_seq as ingest_seq_after
  from bf full join af on bf.patient_id = af.patient_id and bf.date = af.date and bf.start_time = af.start_time),
lb0 as (select *, case when hour(start_time) = 0 then false when date_diff_before < -2 then null
    when type_before in ('ter', 'anm') and type_after in ('bef', 'unt', 'schr') then false
    when type_before in ('ter', 'anm') and (type_after is null or type_after = 'ter') then true
    when type_before is null and type_after = 'bef' then false end as NoShow from pr),
lb as (select *, case when date_diff_before < -2 then null
    when NoShow then case when type_before in ('ter', 'anm') and type_after is null then 'rescheduled'
      when type_before in ('ter', 'anm') and type_after = 'ter' then 'canceled' end
    when hour(start_time) = 0 then case when type_after = 'bef' then 'show' end else 'show' end as slot_outcome from lb0),
os as (select * from lb qualify row_number() over (partition by patient_id, start_time
  order by NoShow, slot_outcome, ingest_seq_before, ingest_seq_after) = 1)"""


def observed(spark, sf):
    """Observed slots, written once because the comparisons read them several times."""
    return cut_lineage(validation.observed_slots(C.observations(spark, sf)), "observed")


@query("day_first_parse", select(D, """patient_id, ingest_seq, type, strptime(date || ' ' || start_time, '%d.%m.%Y %H:%M')
  as start_time, strptime(date, '%d.%m.%Y') as date, strptime(date_recorded, '%d.%m.%Y') as date_recorded""", "d"))
def _(spark, sf):
    c = F.col
    return C.observations(spark, sf).select(
        "patient_id", "ingest_seq", "type", day_first(c("date"), c("start_time")).alias("start_time"),
        day_first(c("date")).alias("date"), day_first(c("date_recorded")).alias("date_recorded"))


@query("last_seen_before", select(PAIRS, "patient_id, date, start_time, type, date_diff, 'before' as side from bf union all "
                                  "select patient_id, date, start_time, type, date_diff, 'after'", "af"))
def _(spark, sf):
    ob = validation.build_observations(C.observations(spark, sf))
    cols = ["patient_id", "date", "start_time", "type", "date_diff"]
    return validation.last_seen_before(ob).select(*cols, F.lit("before").alias("side")).unionByName(
        validation.first_seen_after(ob).select(*cols, F.lit("after").alias("side")))


_KEY = "patient_id, date, start_time, type_before, type_after, date_diff_before"
_KEYS = _KEY.split(", ")


def _pairs(spark, sf):
    return validation.pair_observations(validation.build_observations(C.observations(spark, sf)))


@query("full_outer_two_sources", select(PAIRS, _KEY, "pr"))
def _(spark, sf):
    return _pairs(spark, sf).select(*_KEYS)


@query("dispo_no_show", select(PAIRS, f"{_KEY}, NoShow", "lb"))
def _(spark, sf):
    return validation.label_pairs(_pairs(spark, sf)).select(*_KEYS, "NoShow")


@query("dispo_slot_outcome", select(PAIRS, f"{_KEY}, slot_outcome", "lb"))
def _(spark, sf):
    return validation.label_pairs(_pairs(spark, sf)).select(*_KEYS, "slot_outcome")


_DIRECT = """case type when 'bef' then 'canceled' when 'ter' then 'rescheduled' when 'anm' then 'canceled' else 'show' end"""


@query("midnight_cancel_blank", select(D, f"""patient_id, ingest_seq, case when start_time = '00:00' and {_DIRECT} = 'canceled'
  then '' else {_DIRECT} end as slot_outcome""", "d"))
def _(spark, sf):
    df = C.observations(spark, sf).withColumn("slot_outcome", F.expr(_DIRECT))
    df = validation.build_observations(df)
    return df.select("patient_id", "ingest_seq",
                     rules.midnight_cancel_blank(F.col("start_time"), F.col("slot_outcome")).alias("slot_outcome"))


@query("observed_slots_direct", select(f"""{D}, o1 as (select patient_id, ingest_seq,
    strptime(date || ' ' || start_time, '%d.%m.%Y %H:%M') as start_time, case when start_time = '00:00' and {_DIRECT} = 'canceled'
    then '' else {_DIRECT} end as slot_outcome from d)""", """patient_id, start_time, slot_outcome,
  slot_outcome <> 'show' as NoShow""", "o1", """qualify row_number() over (partition by patient_id, start_time
  order by slot_outcome <> 'show', slot_outcome, ingest_seq) = 1"""))
def _(spark, sf):
    df = C.observations(spark, sf).withColumn("slot_outcome", F.expr(_DIRECT))
    return validation.observed_slots_direct(df).select("patient_id", "start_time", "slot_outcome", "NoShow")


# Derived slots carry the appointment number as patient id, as the observations do.
SIDES = f"""{PAIRS}, {SLOTS.split(S + ',', 1)[1]},
sx as (select FillerOrderNo, cast(FillerOrderNo as varchar) as id, start_time, slot_outcome, NoShow from sl),
obd as (select distinct cast(date as date) as day from os),
ids as (select cast(date as date) as day, slot_outcome, cast(patient_id as varchar) as id, 1 as a, 0 as b from os
  union all select cast(start_time as date), slot_outcome, id, 0, 1 from sx)"""


def derived(spark, sf):
    return cut_lineage(slot_table(spark, sf).withColumn("MRNCmpdId", F.col("FillerOrderNo").cast("string")), "derived")


_JAC = """jg as (select slot_outcome, id, max(a) as a, max(b) as b from ids where day in (select day from obd)
  and slot_outcome is not null group by 1, 2),
jo as (select * from (values ('show'), ('rescheduled'), ('canceled')) t(slot_outcome)),
jx as (select jo.slot_outcome, coalesce(sum(a * b) / nullif(count(id), 0), 1.0) as jaccard from jo left join jg using (slot_outcome)
  group by 1)"""


@query("jaccard_by_outcome", select(f"{SIDES}, {_JAC}", "slot_outcome, round(jaccard, 6) as jaccard", "jx"))
def _(spark, sf):
    return validation.jaccard(observed(spark, sf), derived(spark, sf))


@query("jaccard_table", select(f"{SIDES}, {_JAC}", "slot_outcome, round(jaccard, 6) as development, 1.0::double as evaluation", "jx"))
def _(spark, sf):
    o, s = observed(spark, sf), derived(spark, sf)
    same = o.withColumn("MRNCmpdId", F.col("patient_id"))
    return validation.jaccard_table((o, s), (o, same.withColumn("start_time", F.col("date"))))


_PER_DAY = """pd as (select day, slot_outcome, id, max(a) as a, max(b) as b from ids group by 1, 2, 3),
grid as (select day, slot_outcome from obd, (values ('show'), ('rescheduled'), ('canceled')) t(slot_outcome)),
px as (select grid.day, grid.slot_outcome, coalesce(sum(a), 0) as in_observed, coalesce(sum(b), 0) as in_extract,
    count(*) filter (where a = 1 and b = 0) as only_observed, count(*) filter (where a = 0 and b = 1) as only_extract,
    count(*) filter (where a = 1 and b = 1) as in_both from grid left join pd using (day, slot_outcome) group by 1, 2)"""


@query("outcome_counts_per_day", select(f"{SIDES}, {_PER_DAY}", """cast(day as timestamp) as day, slot_outcome,
  cast(in_observed as bigint) as in_observed, cast(in_extract as bigint) as in_extract, only_observed, only_extract, in_both,
  round(case when in_observed + only_extract = 0 then 1.0 else in_both / (in_observed + only_extract) end, 6) as jaccard""", "px"))
def _(spark, sf):
    return validation.outcomes_per_day(observed(spark, sf), derived(spark, sf))


_PAIRED = """cf as (select coalesce(o.id, x.id) as id, coalesce(o.start_time, x.start_time) as start_time,
    coalesce(o.slot_outcome, 'not present') as outcome_observed, coalesce(x.slot_outcome, 'missing') as outcome_extract
  from (select cast(patient_id as varchar) as id, start_time, slot_outcome from os) o full join
    (select * from sx where cast(start_time as date) in (select day from obd)) x on o.id = x.id and o.start_time = x.start_time)"""


@query("confusion_outer_join", select(f"{SIDES}, {_PAIRED}", "*", "cf"))
def _(spark, sf):
    return validation.pair_sources(observed(spark, sf), derived(spark, sf))


_MATRIX = """select position, outcome_observed, count(*) filter (where c.outcome_extract = 'show') as "show",
    count(*) filter (where c.outcome_extract = 'rescheduled') as rescheduled,
    count(*) filter (where c.outcome_extract = 'canceled') as canceled,
    count(*) filter (where c.outcome_extract = 'missing' and outcome_observed <> 'not present') as missing
  from (values (0, 'show'), (1, 'rescheduled'), (2, 'canceled'), (3, 'not present')) t(position, outcome_observed)
    left join cf c using (outcome_observed) group by 1, 2"""


@query("confusion_matrix_two_sources", f"with {SIDES}, {_PAIRED} {_MATRIX}")
def _(spark, sf):
    return validation.confusion_matrix(observed(spark, sf), derived(spark, sf))


@query("validate_sources", f"""with {SIDES}, {_PAIRED}, {_JAC}, mx as ({_MATRIX})
  select outcome_observed, "show", rescheduled, canceled, missing, round(jaccard, 6) as jaccard
  from mx left join jx on slot_outcome = outcome_observed""")
def _(spark, sf):
    matrix, overlap = validation_jobs.validate(
        C.observations(spark, sf), derived(spark, sf), machines=["MR1", "MR2", "MRDL"])
    overlap = overlap.withColumnRenamed("slot_outcome", "outcome_observed")
    return matrix.drop("position").join(overlap, "outcome_observed", "left")


@query("stack_sources", select(SIDES, """'dispo' as source, patient_id::varchar as patient_id, start_time,
  start_time + interval 30 minutes as end_time, slot_outcome, coalesce(machine_after, machine_before) as device from os
  union all select 'extract', sx.id, sx.start_time, end_time, sx.slot_outcome, EnteringOrganisationDeviceID""",
  "sx join sl using (FillerOrderNo, start_time)"))
def _(spark, sf):
    return slots.stack_sources(observed(spark, sf), derived(spark, sf)).select(
        "source", "patient_id", "start_time", "end_time", "slot_outcome", F.col("EnteringOrganisationDeviceID").alias("device"))
