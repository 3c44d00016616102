"""Descriptive tables over slots and features."""

from __future__ import annotations

import datetime as dt
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlog import constants as K
from slotlog.functions import rules
from slotlog.functions.dates import minutes_between
from slotlog.operators import ordered
from slotlog.session import cut_lineage


def _missed() -> Column:
    return F.col("NoShow").cast("long")


def no_show_rate_by(df: DataFrame, by: str) -> DataFrame:
    """Share of missed slots and group size; weekday and hour tables keep the usual working time."""
    if by == "day_of_week_str":
        df = df.filter(F.col(by).isin(K.WEEKDAYS))
    elif by == "hour_sched":
        df = df.filter((F.col(by) > 6) & (F.col(by) < 18))
    return df.groupBy(by).agg(F.avg(_missed()).alias("no_show_rate"), F.sum(_missed()).alias("no_shows"),
                              F.count(F.lit(1)).alias("appointments"))


def per_patient(df: DataFrame) -> DataFrame:
    return df.groupBy("MRNCmpdId").agg(F.count("NoShow").alias("num_appts"), F.sum(_missed()).alias("num_noshow"))


def appointments_per_patient(df: DataFrame) -> DataFrame:
    return per_patient(df).groupBy("num_appts").agg(F.count(F.lit(1)).alias("num_patients"))


def no_show_heat_map(df: DataFrame) -> DataFrame:
    out = per_patient(df).groupBy("num_appts", "num_noshow").agg(F.count(F.lit(1)).alias("num_patients"))
    return out.withColumn("percent_missed", F.col("num_noshow") / F.nullif(F.col("num_appts"), F.lit(0)))


def no_show_buckets(df: DataFrame) -> DataFrame:
    """Patients by 1, 2, >2 appointments and 0, 1, 2, >2 no-shows, with the empty cells."""
    a, n = F.col("num_appts"), F.col("num_noshow")
    binned = per_patient(df).select(
        F.when(a == 1, "1").when(a == 2, "2").when(a > 2, ">2").alias("appts"),
        F.when(n == 0, "0").when(n == 1, "1").when(n == 2, "2").when(n > 2, ">2").alias("noshows"))
    cells = [F.struct(F.lit(x).alias("num_appts"), F.lit(y).alias("num_noshow"),
                      F.count_if((F.col("appts") == x) & (F.col("noshows") == y)).alias("num_patients"))
             for x in ("1", "2", ">2") for y in ("0", "1", "2", ">2")]
    return binned.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("x")).select("x.*")


def _week_start(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def _between(df: DataFrame, start, end) -> DataFrame:
    lo, hi = (F.lit(dt.datetime.combine(x, dt.time())).cast("timestamp_ntz") for x in (start, end))
    return df.filter((F.col("start_time") >= lo) & (F.col("start_time") < hi))


def types_over_time(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Slots per month and type; the end is cut back to the start of its week."""
    out = _between(df, start, _week_start(end))
    return out.groupBy(F.date_trunc("month", "start_time").cast("timestamp_ntz").alias("year_month"),
                       "slot_type_detailed").agg(F.count("FillerOrderNo").alias("appts"))


def type_share_by_weekday(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Share of each type in its weekday. The window runs over at most types x 7 counted rows."""
    counted = _between(df, start, end).groupBy(F.weekday("start_time").alias("weekday"), "slot_type_detailed").agg(
        F.count("FillerOrderNo").alias("n"))
    total = F.sum("n").over(Window.partitionBy("weekday"))
    names = F.try_element_at(F.array(*[F.lit(x) for x in K.WEEKDAYS]), F.col("weekday") + 1)
    return counted.withColumn("percent", F.col("n") / total).filter("weekday < 5").select(
        "slot_type_detailed", names.alias("weekday"), "percent")


def positive_rate(df: DataFrame, target: str, by: str) -> DataFrame:
    """Frequency of ``by`` and the share of positives in it."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("frequencies"), F.avg(F.col(target).cast("long")).alias("rate"))


def lengths_by(df: DataFrame, variable: str, group: str | None = None, max_minutes: float = 1000.0) -> DataFrame:
    """Box-plot numbers of the appointment length for each value of a column, and of a second one if given; exact quartiles.

    Quartiles need an order per group: equal lengths are counted first, then running
    counts find the ranks, so a frequent value is never collected in one task. All numbers come from the counted lengths, so the
    table is read once. A null value is a group like any other.
    """
    length = minutes_between(F.col("image_start"), F.col("image_end"))
    df = df.filter(F.col("image_start").isNotNull()).withColumn("len", length).filter(F.col("len") < max_minutes)
    c = F.col
    return exact_quantiles(df, [variable, *([group] if group else [])], "len", {"q1": 0.25, "median": 0.5, "q3": 0.75}, {
        "n": F.sum("n"), "mean": F.sum(c("len") * c("n")) / F.sum("n"), "min": F.min("len"), "max": F.max("len")})


def lengths_by_type(df: DataFrame, exclude: str | None = None, max_minutes: float = 1000.0) -> DataFrame:
    """``lengths_by`` the service, without one of them."""
    if exclude is not None:
        df = df.filter(~rules.holds(F.col("UniversalServiceName") == exclude))
    return lengths_by(df, "UniversalServiceName", max_minutes=max_minutes)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], stats: dict[str, Column] | None = None) -> DataFrame:
    """Exact interpolated quantiles per key from running counts over the distinct values.

    ``stats`` are further aggregates per key over rows of a distinct ``value`` and its count ``n``.
    """
    c = F.col
    present = df.filter(c(value).isNotNull())
    counts = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    rows = present.count()
    if rows > ordered.HOT_MIN_ROWS:
        counts = cut_lineage(counts, "counts")
    counts = ordered.split_hot_keys(counts, keys, value, at_most=rows)
    counts = ordered.with_ordered(counts, keys, [value],
                                  {"below": ordered.sum_before(c("n")), "total": ordered.key_sum(c("n"))})
    covers = lambda i: (i >= c("below")) & (i < c("below") + c("n"))
    aggs = [e.alias(name) for name, e in (stats or {}).items()]
    for name, q in quantiles.items():
        at = (c("total") - 1) * F.lit(q)
        lo, hi = F.floor(at), F.ceil(at)
        # The value at a whole rank sits in exactly one row.
        low = F.max(F.when(covers(lo), c(value)))
        high = F.max(F.when(covers(hi), c(value)))
        frac = F.max(at - lo)
        aggs.append((low + (high - low) * frac).alias(name))
    return counts.groupBy(*keys).agg(*aggs)


def pairwise_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every unordered pair, all pairs in one pass over the rows."""
    skip = {"FillerOrderNo", "MRNCmpdId", "NoShow"}
    names = sorted(c for c in columns if c not in skip and "_sin" not in c and "_cos" not in c)
    cells = [F.struct(F.lit(f"{a}, {b}").alias("varcomb"),
                      F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("correlation"))
             for a, b in combinations(names, 2)]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("x")).select("x.*")


# ---------------------------------------------------------------- intervention

def latest_per_slot(df: DataFrame, order: str = "file") -> DataFrame:
    """Latest non-null value of every column per appointment and start."""
    keys = ["FillerOrderNo", "start_time"]
    rest = [c for c in df.columns if c not in keys]
    pos = F.struct(F.col(order), *[F.col(c) for c in ("ingest_seq",) if c in df.columns and c != order])
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), pos)).alias("v__" + c) for c in rest]
    return df.groupBy(*keys).agg(*aggs).withColumnsRenamed({"v__" + c: c for c in rest})


def prepare_intervention(df: DataFrame, actuals: DataFrame, feedback: DataFrame) -> DataFrame:
    """Called and control slots with outcome and feedback, one row per slot."""
    keys = ["FillerOrderNo", "start_time"]
    out = df.drop("NoShow").filter(F.col("start_time") < actuals.agg(F.max("start_time")).scalar())
    out = out.join(actuals.select(*keys, "NoShow"), keys, "left").join(feedback.select(*keys, "feedback"), keys, "left")
    out = out.filter(~rules.holds(F.col("feedback").isin(K.FEEDBACK_IGNORED)))
    out = out.withColumns({
        "NoShow": F.coalesce("NoShow", F.lit(False)),
        "feedback": F.when(F.col("control") == "control", "control").otherwise(F.col("feedback")),
    })
    return latest_per_slot(out).withColumns({
        "reached": rules.reached(F.col("feedback")), "reached_2": rules.reached_2(F.col("feedback"))})


def intervention_results(df: DataFrame) -> DataFrame:
    """Slots, no-shows and their share by group, group and feedback, and both readings of reached, in one pass."""
    grains = [("control", "feedback"), ("control",), ("reached",), ("reached_2",)]
    cols = ["control", "feedback", "reached", "reached_2"]
    piece = lambda g: F.struct(F.lit("+".join(g)).alias("grain"), *[
        (F.col(c) if c in g else F.lit(None).cast("string")).alias(c) for c in cols])
    present = lambda g: F.lit(True) if not g else F.greatest(*[F.col(c).isNull() for c in g]) if len(g) > 1 else F.col(g[0]).isNull()
    pieces = F.array_compact(F.array(*[F.when(~present(g), piece(g)) for g in grains]))
    long = df.select(F.explode(pieces).alias("x"), _missed().alias("missed")).select("x.*", "missed")
    return long.groupBy("grain", *cols).agg(F.count("missed").alias("n"), F.sum("missed").alias("no_shows"),
                                            F.avg("missed").alias("rate"))
