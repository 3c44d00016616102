"""Features of an appointment: who, what, when, and what was known before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlog import constants as K
from slotlog.functions import dates, rules, text
from slotlog.operators import ordered, slots

EARTH_RADIUS_KM = 6371.009
HISTORY_COLUMNS = ["no_show_before", "no_show_before_sq", "appts_before", "show_before", "no_show_rate"]


# ---------------------------------------------------------------- status rows

def add_modality(df: DataFrame) -> DataFrame:
    return text.add_modality(df, "UniversalServiceName")


def add_occupation(df: DataFrame) -> DataFrame:
    return text.add_occupation(df, "Beruf").drop("Beruf")


def add_reason(df: DataFrame) -> DataFrame:
    return text.add_reason(df, "ReasonForStudy")


def add_codes(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "insurance_class": text.insurance_class(F.col("Klasse")),
        "sex": text.sex(F.col("Sex")),
        "marital": text.marital(F.col("Zivilstand")),
        "post_code": text.strip_float_suffix(F.col("Zip").cast("string")),
    })


def add_age(df: DataFrame) -> DataFrame:
    age = dates.age_years(F.col("date"), F.col("DateOfBirth"))
    return df.withColumn("age", age).withColumns({
        "age_sq": F.col("age") * F.col("age"),
        "age_20_60": (F.col("age") > 20) & (F.col("age") < 60),
    })


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def distances(post_codes: DataFrame, site: str) -> DataFrame:
    """Distance of every postal centroid to the site's."""
    here = post_codes.filter(F.col("post_code") == site)
    lat, lon = (here.agg(F.max(c)).scalar() for c in ("lat", "lon"))
    return post_codes.withColumns({"lat0": lat, "lon0": lon}).select(
        "post_code", haversine_km(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")).alias("distance_to_usz"))


def add_distance(df: DataFrame, post_codes: DataFrame, site: str) -> DataFrame:
    """Kilometres from the home postal code to the site; unknown codes give null and are not close.

    No join hint: Spark broadcasts the dimension while its size allows it and else
    shuffles, splitting a frequent postal code at run time.
    """
    km = F.col("distance_to_usz")
    return df.join(distances(post_codes, site), "post_code", "left").withColumns({
        "distance_to_usz_sq": km * km,
        "close_to_usz": rules.holds(km < K.CLOSE_KM),
    })


def add_row_features(df: DataFrame, post_codes: DataFrame, site: str) -> DataFrame:
    for step in (add_modality, add_codes, add_age, add_occupation, add_reason):
        df = df.transform(step)
    return add_distance(df, post_codes, site)


# ---------------------------------------------------------------- slots

def add_calendar(df: DataFrame) -> DataFrame:
    t = F.col("start_time")
    return df.withColumns({
        "year": F.year(t).cast("long"),
        "month": F.month(t).cast("long"),
        "hour_sched": F.hour(t).cast("long"),
        "day_of_week": F.weekday(t).cast("long"),
        "day_of_week_str": dates.weekday_name(t),
    })


def add_cycles(df: DataFrame) -> DataFrame:
    out = {}
    for name, column, period, offset in (("hour", "hour_sched", K.HOUR_PERIOD, 0),
                                         ("day_of_week", "day_of_week", K.WEEKDAY_PERIOD, 0),
                                         ("month", "month", K.MONTH_PERIOD, 1)):
        out[name + "_sin"], out[name + "_cos"] = dates.cycle(F.col(column), period, offset)
    return df.withColumns(out)


def add_time_of_day(df: DataFrame) -> DataFrame:
    return df.withColumn("time_of_day", dates.time_of_day(F.col("hour_sched")))


def add_duration(df: DataFrame) -> DataFrame:
    return df.withColumn("duration", dates.minutes_between(F.col("image_start"), F.col("image_end")))


def schedule_changed() -> Column:
    """True where the planned time differs from before; a missing side counts as different."""
    return ~rules.holds(F.col("was_sched_for_date") == F.col("now_sched_for_date"))


def schedule_lead_times(status_df: DataFrame) -> DataFrame:
    """Per appointment and planned time: lead time at the first change to it."""
    pos = slots.position(status_df)
    changed = status_df.filter(schedule_changed() & F.col("now_sched_for_date").isNotNull()
                               & F.col("FillerOrderNo").isNotNull())
    return changed.groupBy("FillerOrderNo", "now_sched_for_date").agg(
        slots.first(F.col("now_sched_for"), pos).alias("sched_days_advanced"),
        slots.first(F.col("now_sched_for_busday"), pos).alias("sched_days_advanced_busday"))


def lead_time_columns(df: DataFrame) -> DataFrame:
    days = F.col("sched_days_advanced")
    return df.withColumns({"sched_days_advanced_sq": days * days, "sched_2_days": days <= 2})


def add_days_advanced(status_df: DataFrame, slot_df: DataFrame) -> DataFrame:
    """Days between scheduling and the slot; slots that were never scheduled drop out."""
    lead = schedule_lead_times(status_df).withColumnsRenamed({"now_sched_for_date": "start_time"})
    return lead_time_columns(slot_df.join(lead, ["FillerOrderNo", "start_time"]))


def add_no_show_before(df: DataFrame, history: DataFrame | None = None, per: Sequence[str] = (),
                       patients: ordered.HotChunks | None = None) -> DataFrame:
    """A patient's earlier appointments and no-shows, not counting the row itself.

    ``patients`` are those whose rows are too many for one task, found in a table that has at least as many rows of each.

    Slots are expected once per patient, appointment and start. ``history``
    adds earlier slots that are not part of ``df``; rows in both count once. A history
    that has the ``per`` columns belongs to their groups, as ``df`` does.
    """
    keys = [*(p for p in per if history is not None and p in history.columns), "MRNCmpdId", "FillerOrderNo", "start_time", "NoShow"]
    base = df.drop(*HISTORY_COLUMNS)
    if history is not None:
        old = history.select(*keys).distinct().join(base.select(*keys).distinct(), keys, "left_anti")
        base = base.withColumn("is_current", F.lit(True)).unionByName(
            old.withColumn("is_current", F.lit(False)), allowMissingColumns=True)
    missed = F.coalesce(F.col("NoShow").cast("long"), F.lit(0).cast("long"))
    order = ["start_time", "FillerOrderNo"]
    base = patients.add(base, order) if patients else base
    out = ordered.with_ordered(base, [*per, "MRNCmpdId"], order, {
        "no_show_before": ordered.sum_before(missed),
        "appts_before": ordered.rows_before(),
    })
    if history is not None:
        out = out.filter("is_current").drop("is_current")
    if patients:
        out = out.drop(ordered.chunk_column(["MRNCmpdId"]))
    return add_history_rates(out)


def add_history_rates(df: DataFrame) -> DataFrame:
    """What follows from a patient's earlier appointments and no-shows."""
    n, a = F.col("no_show_before"), F.col("appts_before")
    return df.withColumns({
        "no_show_before_sq": n * n,
        "show_before": a - n,
        "no_show_rate": F.when(a > 0, n / a).otherwise(F.lit(0.0)),
    })
