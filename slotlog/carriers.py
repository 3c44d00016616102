"""Hospital-shaped views derived from the general tables, written once for both engines.

Every view is plain SQL text over one base table. Only a handful of functions
differ between Spark and DuckDB; ``Dialect`` spells those. The Spark side and
the oracle side therefore read the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@dataclass(frozen=True)
class Dialect:
    duck: bool

    def days(self, a: str, b: str) -> str:
        return f"date_diff('day', {a}, {b})" if self.duck else f"datediff({b}, {a})"

    def shift(self, base: str, unit: str, n: str) -> str:
        if self.duck:
            return f"(cast({base} as timestamp) + to_{unit}s(cast({n} as bigint)))"
        return f"timestampadd({unit.upper()}, cast({n} as bigint), cast({base} as timestamp_ntz))"

    def plus_days(self, base: str, n: str) -> str:
        return f"cast({base} as date) + cast({n} as integer)" if self.duck else f"date_add(cast({base} as date), cast({n} as int))"

    def fmt(self, c: str, duck_fmt: str, spark_fmt: str) -> str:
        return f"strftime({c}, '{duck_fmt}')" if self.duck else f"date_format({c}, '{spark_fmt}')"

    def text(self, e: str) -> str:
        return f"cast({e} as varchar)" if self.duck else f"cast({e} as string)"

    def div(self, a: str, n: int) -> str:
        return f"(({a}) // {n})" if self.duck else f"(({a}) div {n})"


SPARK, DUCK = Dialect(False), Dialect(True)


def pick(index: str, values: list[str | None], duck: bool = False) -> str:
    """Text choosing from a constant list by a number 0..n-1; the number is computed once."""
    items = ", ".join("null" if v is None else f"'{v}'" for v in values)
    at = f"cast(({index}) % {len(values)} as {'bigint' if duck else 'int'}) + 1"
    return f"list_extract([{items}], {at})" if duck else f"element_at(array({items}), {at})"


SERVICES = ["MR Schädel", "MR Knie links", "MR Herz", "MR Becken", "MR LWS", "MR Angio Hals", "MR Schulter",
            "MR Abdomen", "MR Mamma", "MR Ganzkörper", "Fremduntersuchung MR", "MR OBERE EXTREMITÄT", "Spezial"]
JOBS = ["Arzt", "Rentner", "IV-Rentner", "Student", "Hausfrau", "-", "", "Lehrer", "selbständig", "Tourist",
        "keine Angaben", "Informatiker", "arbeitslos", "Xylophon", None]
REASONS = ["Verlaufskontrolle", "LÄSION im Knie", "Nachsorge", "Ganzkörper", "Rezidiv", "entzündliche Veränderungen",
           "Tumor?", "nan", "Kopfweh", None]
MARITALS = ["VRH", "LED", "GES", "UNB", "XXX", "VRW", "GTR", "PAR", "ABC", None]


def status_sql(d: Dialect) -> str:
    """S: raw status log, one row per event."""
    day = "cast(ts as date)"
    slot = d.div(d.days("date '2024-01-01'", day), 5)
    hour = "case when event_id % 37 = 0 then 0 else event_id % 12 + 7 end"
    planned = d.shift(d.shift(day, "day", "cast(floor(value) as bigint) % 6"), "hour", hour)
    fon = f"(user_id * 100 + {slot})"
    return f"""select cast({fon} as bigint) as FillerOrderNo,
      case when user_id % 50 = 49 then 'TEST_' else '' end || {d.text('user_id')}
        || case when user_id % 2 = 0 then '|USZ' else '' end as MRNCmpdId,
      ts as History_MessageDtTm, event_id as ingest_seq,
      case when event_id % 97 = 0 then 'z' when event_id % 13 = 0 then 'p' when event_type = 'signup' then 't'
           when event_type = 'view' then 'a' when event_type = 'click' then 'b' when event_type = 'purchase' then 'u'
           else 's' end as History_OrderStatus,
      {planned} as History_ObsStartPlanDtTm,
      case user_id % 10 when 9 then 'stationär' when 8 then null when 7 then 'tagesklinik' else 'ambulant' end
        as PatientClass,
      case when user_id % 17 = 16 then 'CT1' else {pick('user_id', ['MR1', 'MR2', 'MRDL'], d.duck)} end
        as EnteringOrganisationDeviceID,
      {pick(f'user_id + {slot}', SERVICES, d.duck)} as UniversalServiceName,
      case when {fon} % 3 = 0 then 's' else 'u' end as OrderStatus,
      {pick('user_id', ['A', 'P', 'HP', 'X', None], d.duck)} as Klasse,
      {pick('user_id', ['weiblich', 'männlich'], d.duck)} as Sex,
      {d.shift(d.plus_days("date '1940-01-01'", '(user_id * 377) % 25000'), 'day', '0')} as DateOfBirth,
      {pick('user_id', MARITALS, d.duck)} as Zivilstand,
      {d.text('8000 + user_id % 27')} || '.0' as Zip,
      {pick('user_id * 7', JOBS, d.duck)} as Beruf,
      {pick('event_id', REASONS, d.duck)} as ReasonForStudy,
      case when event_id % 3 = 0 then '+41' || {d.text('user_id')} end as Telefon
    from events"""


def image_sql(d: Dialect) -> str:
    """I: image rows. Four images per appointment; some first and last images lie far off."""
    acc = d.div("event_id", 4)
    off = "case when event_id % 40 = 0 then -45 when event_id % 60 = 3 then 50 else 0 end"
    at = d.shift("ts", "minute", off)
    return f"""select AccessionNumber, StationName, SopImageUid, SeriesUID, acq as acq_source,
        {d.fmt('acq', '%Y%m%d', 'yyyyMMdd')} as AcquisitionDate,
        {d.text("cast(" + d.fmt('acq', '%H%M%S', 'HHmmss') + " as bigint)")} || '.' || {d.fmt('acq', '%f', 'SSSSSS')}
          as AcquisitionTime
      from (select case when {acc} % 97 = 5 then 'X' else '' end || {d.text(acc)} as AccessionNumber,
        case when {acc} % 11 = 10 then 'MT00000999' else {pick(acc, ['MT00000173', 'MT00000213'], d.duck)} end as StationName,
        event_id as SopImageUid, {acc} as SeriesUID, {at} as acq from events) i"""


def interval_sql(d: Dialect) -> str:
    """Appointment intervals per device, with some overlaps."""
    acc = d.div("event_id", 4)
    extra = "(accession % 5) * 10"
    return f"""select accession as AccessionNumber, cast(accession % 2 + 1 as integer) as image_device_id, lo as image_start,
        {d.shift('hi', 'minute', extra)} as image_end
      from (select {acc} as accession, min(ts) as lo, max(ts) as hi from events group by {acc}) a"""


def raster_sql(d: Dialect) -> str:
    """R: opening-hours raster, one row per bookable time; two validity periods per device and weekday."""
    minutes = "480 + (event_id % 17) * 30"
    start = d.shift("date '2024-01-01'", "minute", minutes)
    day = ["MO", "DI", "MI", "DO", "FR"]
    return f"""select Terminbuch, Wochentag, Terminbuch || ' ' || Wochentag as TERMINRASTER_NAME,
        gueltig_von, gueltig_bis, {d.fmt('t', '%H:%M', 'HH:mm')} as Termin, 30 as dauer_min
      from (select distinct {pick('user_id', ['MR1', 'MR2'], d.duck)} as Terminbuch, {pick(d.div('user_id', 2), day, d.duck)} as Wochentag,
        case when event_id % 2 = 0 then '15.01.2024' end as gueltig_bis,
        case when event_id % 2 = 1 then '16.01.2024' end as gueltig_von,
        {start} as t from events) r"""


def slot_sql(d: Dialect) -> str:
    """F: one finished appointment per order."""
    start = d.shift("o_orderdate", "hour", "o_orderkey % 12 + 6")
    return f"""select o_orderkey as FillerOrderNo, {d.text('o_custkey')} as MRNCmpdId, {start} as start_time,
      {d.shift(start, 'minute', '20 + o_orderkey % 25')} as end_time, (o_orderstatus = 'F') as NoShow,
      case o_orderstatus when 'F' then 'no-show' when 'O' then 'show' else 'inpatient' end as slot_type,
      case when o_orderstatus = 'F' then (case when o_orderkey % 2 = 0 then 'hard no-show' else 'soft no-show' end)
           when o_orderstatus = 'O' then 'show' else 'inpatient' end as slot_type_detailed,
      case when o_orderstatus = 'F' then (case when o_orderkey % 3 = 0 then 'canceled' else 'rescheduled' end)
           else 'show' end as slot_outcome,
      {pick('o_orderkey', ['MR1', 'MR2', 'MRDL'], d.duck)} as EnteringOrganisationDeviceID,
      {pick('o_custkey', SERVICES, d.duck)} as UniversalServiceName,
      cast(20 + o_custkey % 70 as bigint) as age, o_totalprice as price, o_orderpriority as priority
    from orders"""


def score_sql(d: Dialect) -> str:
    """P: labelled scores of two models with their features."""
    hashed = "cast(floor(l_extendedprice * 100 + 0.5) as bigint)"
    return f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      case when l_returnflag = 'R' then 1 else 0 end as label,
      cast({hashed} % 10007 as double) / 10007 as score,
      cast(({hashed} * 31 + l_partkey * 17) % 997 as double) / 997 as score_b,
      l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate, {hashed} as l_cents
    from lineitem"""


def observation_sql(d: Dialect, status: str) -> str:
    """D: raw observations at the counter, before and after the day, from the status view ``status``."""
    planned = "History_ObsStartPlanDtTm"
    day = f"cast({planned} as date)"
    clock = f"case when ingest_seq % 10 = 0 then '00:00' else {d.fmt(planned, '%H:%M', 'HH:mm')} end"
    next_day = (f"case {d.fmt(planned, '%w', 'E') if d.duck else f'weekday({planned}) + 1'} "
                + ("when '5' then 3 when '6' then 3 when '0' then 2 else 1 end" if d.duck
                   else "when 5 then 3 when 6 then 3 when 7 then 2 else 1 end"))
    id_ = "FillerOrderNo"
    base = (f"{id_} as patient_id, {d.fmt(day, '%d.%m.%Y', 'dd.MM.yyyy')} as date, {clock} as start_time, "
            f"ingest_seq, EnteringOrganisationDeviceID as machine")
    kind_before = ("case History_OrderStatus when 't' then 'ter' when 'a' then 'ter' when 'b' then 'anm' "
                   "else 'bef' end")
    kind_after = pick("ingest_seq", ["bef", "unt", "ter", "schr"], d.duck)
    recorded_after = d.plus_days(day, next_day)
    return f"""select {base}, {kind_before} as type,
        {d.fmt('cast(History_MessageDtTm as date)', '%d.%m.%Y', 'dd.MM.yyyy')} as date_recorded from {status}
      union all
      select {base}, {kind_after} as type, {d.fmt(recorded_after, '%d.%m.%Y', 'dd.MM.yyyy')} as date_recorded
      from {status} where ingest_seq % 3 <> 0"""


def post_code_sql(d: Dialect) -> str:
    """Postal centroids from the nation table."""
    return f"""select {d.text('8000 + n_nationkey')} as post_code, cast(47 + n_nationkey * 0.05 as double) as lat,
      cast(8 + n_nationkey * 0.07 as double) as lon from nation"""


SITE_POST_CODE = "8003"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, base: str, sql: str) -> DataFrame:
    # {base} becomes a DataFrame parameter: no temporary view is left behind.
    return spark.sql(sql.replace(f"from {base}", "from {" + base + "}"), **{base: table(spark, sf_dir, base)})


def status(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, "events", status_sql(SPARK))


def images(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, "events", image_sql(SPARK))


def intervals(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, "events", interval_sql(SPARK))


def raster(spark, sf_dir) -> DataFrame:
    df = _view(spark, sf_dir, "events", raster_sql(SPARK))
    return df.withColumnsRenamed({"gueltig_von": "gültig von", "gueltig_bis": "gültig bis", "dauer_min": "Dauer in Min."})


def slots(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, "orders", slot_sql(SPARK))


def scores(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", score_sql(SPARK))


def post_codes(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, "nation", post_code_sql(SPARK))


def observations(spark, sf_dir) -> DataFrame:
    sql = observation_sql(SPARK, "status").replace("from status", "from {status}")
    return spark.sql(sql, status=status(spark, sf_dir))
