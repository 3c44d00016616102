"""Building blocks of the oracle SQL (DuckDB)."""

from __future__ import annotations

from slotlog import carriers as C
from slotlog import constants as K


def lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def case_map(c: str, mapping: dict[str, str], default: str = "null") -> str:
    return f"case {c} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in mapping.items()) + f" else {default} end"


def cascade(c: str, rules, default: str) -> str:
    """Last matching rule wins."""
    arms = " ".join(f"when regexp_matches({c}, {lit('(?i)' + p)}) then {lit(v)}" for p, v in reversed(rules))
    return f"case {arms} else {default} end"


def weekdays_before(d: str) -> str:
    n = f"date_diff('day', date '1970-01-05', cast({d} as date))"
    return f"(cast(floor({n} / 7.0) as bigint) * 5 + least((({n} % 7) + 7) % 7, 5))"


def busday(a: str, b: str) -> str:
    return f"({weekdays_before(b)} - {weekdays_before(a)})"


def add_bd(d: str, n: int) -> str:
    """n-th weekday after d, found by listing days."""
    if n == 0:
        return f"cast({d} as date)"
    return (f"cast(list_filter(list_transform(range(1, {n * 2 + 8}), lambda i: cast({d} as date) + cast(i as integer)), "
            f"lambda x: isodow(x) < 6)[{n}] as date)")


def sub_bd(d: str, n: int) -> str:
    if n == 0:
        return f"cast({d} as date)"
    return (f"cast(list_filter(list_transform(range(1, {n * 2 + 8}), lambda i: cast({d} as date) - cast(i as integer)), "
            f"lambda x: isodow(x) < 6)[{n}] as date)")


def status_text(c: str) -> str:
    return f"case when {c} is not null then {case_map(c, K.STATUS_TEXT, f'''concat('unknown: ', {c})''')} end"


S = f"s as ({C.status_sql(C.DUCK)})"

_ORDER = "order by History_MessageDtTm, ingest_seq"

# s1: filtered raw rows; s2: with the previous state; s3: without test patients, with first and last planned time.
S3 = f"""{S},
s1 as (select * replace (replace(MRNCmpdId, '|USZ', '') as MRNCmpdId) from s
  where EnteringOrganisationDeviceID in {in_list(K.RELEVANT_MACHINES)}
    and UniversalServiceName not in {in_list(K.EXCLUDED_SERVICES)}),
s2 as (select *, lag(History_OrderStatus) over w as prev_status, lag(History_ObsStartPlanDtTm) over w as was_sched_for_date
  from s1 window w as (partition by FillerOrderNo {_ORDER})),
s3 as (select *, History_MessageDtTm as date, History_ObsStartPlanDtTm as now_sched_for_date,
    {status_text('prev_status')} as was_status, {status_text('History_OrderStatus')} as now_status,
    date_diff('day', cast(History_MessageDtTm as date), cast(was_sched_for_date as date)) as was_sched_for,
    date_diff('day', cast(History_MessageDtTm as date), cast(History_ObsStartPlanDtTm as date)) as now_sched_for,
    {busday('History_MessageDtTm', 'History_ObsStartPlanDtTm')} as now_sched_for_busday,
    min(History_MessageDtTm) over (partition by FillerOrderNo) as first_created_date,
    last_value(History_ObsStartPlanDtTm ignore nulls) over (partition by FillerOrderNo {_ORDER}
      rows between unbounded preceding and unbounded following) as final_now_sched_for_date,
    case when PatientClass is null or PatientClass = 'nan' then 'ambulant'
      else {case_map('PatientClass', K.PATIENT_CLASS, "'unknown'")} end as patient_class_adj
  from s2 where not contains(MRNCmpdId, '_'))"""

NO_SHOW = f"""coalesce(patient_class_adj = 'ambulant' and {busday('date', 'was_sched_for_date')} <= 2
  and now_status in ('scheduled', 'canceled') and was_status <> 'requested' and hour(was_sched_for_date) <> 0
  and cast(first_created_date as date) <> cast(was_sched_for_date as date), false)"""

# lab: labelled; st: the status log.
STATUS = f"""{S3},
s4 as (select *, {NO_SHOW} as NoShow from s3),
s5 as (select *, case when NoShow then case when date > was_sched_for_date then 'hard' else 'soft' end end as NoShow_severity,
    case when NoShow then 'no-show'
      when OrderStatus = 'u' and now_status = 'started' and patient_class_adj = 'ambulant' then 'show'
      when OrderStatus = 'u' and now_status = 'started' and patient_class_adj = 'inpatient' then 'inpatient' end as slot_type
  from s4),
lab as (select *, case when NoShow then case when now_status = 'canceled' or final_now_sched_for_date = was_sched_for_date
      then 'canceled' else 'rescheduled' end when slot_type in ('show', 'inpatient') then 'show' end as slot_outcome,
    case when NoShow then NoShow_severity || ' no-show' else slot_type end as slot_type_detailed
  from s5),
st as (select * from lab where not coalesce(now_status = was_status and now_sched_for_date = was_sched_for_date, false))"""

_LAST = "last({c} order by date, ingest_seq) filter (where {c} is not null) as {c}"


def last_cols(cols) -> str:
    return ", ".join(_LAST.format(c=c) for c in cols)


SLOT_TEXT = ["patient_class_adj", "slot_outcome", "slot_type", "slot_type_detailed", "EnteringOrganisationDeviceID",
             "UniversalServiceName"]

# se: start and end per row; shows, misses: slots before the date range.
SLOT_ROWS = f"""{STATUS},
se0 as (select *, case when NoShow or now_status = 'started' then was_sched_for_date end as start_time,
    case when NoShow or now_status = 'examined' then was_sched_for_date + interval 30 minutes end as end_own from st),
se as (select *, first_value(end_own ignore nulls) over (partition by FillerOrderNo order by date, ingest_seq
    rows between current row and unbounded following) as end_time from se0),
shows as (select FillerOrderNo, MRNCmpdId, {last_cols(SLOT_TEXT + ['start_time', 'end_time'])}, bool_and(NoShow) as NoShow
  from se where slot_type in ('show', 'inpatient') group by 1, 2),
misses as (select FillerOrderNo, MRNCmpdId, was_sched_for_date as missed, {last_cols(SLOT_TEXT + ['start_time', 'end_time'])},
    bool_and(NoShow) as NoShow from se where NoShow and was_sched_for_date is not null group by 1, 2, 3)"""


def slot_table(lo: str, hi: str) -> str:
    return f"""{SLOT_ROWS},
un as (select * from shows union all by name select * exclude (missed) from misses),
sl as (select * from un where start_time >= timestamp '{lo}' and start_time < timestamp '{hi}' + interval 1 day
  qualify row_number() over (partition by MRNCmpdId, start_time order by NoShow, FillerOrderNo) = 1)"""


RANGE = ("2024-01-01", "2024-02-15")
SLOTS = slot_table(*RANGE)
SLOT_COLUMNS = ["FillerOrderNo", "MRNCmpdId", "start_time", "end_time", "NoShow", *SLOT_TEXT]


def select(ctes: str, cols: str, source: str, rest: str = "") -> str:
    return f"with {ctes} select {cols} from {source} {rest}"
