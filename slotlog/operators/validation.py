"""Compare slots observed at the counter with slots derived from the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlog import constants as K
from slotlog.functions import rules
from slotlog.functions.dates import as_date, busday_count, day_first
from slotlog.operators import cleaning, slots

OBS_KEY = ["patient_id", "date", "start_time"]


def build_observations(raw: DataFrame, test_patient_ids: Sequence = ()) -> DataFrame:
    """Day-first texts to dates and times; listed patients are left out."""
    df = cleaning.drop_values(raw, "patient_id", test_patient_ids) if test_patient_ids else raw
    out = df.withColumns({
        "patient_id": F.col("patient_id").cast("long"),
        "start_time": day_first(F.col("date"), F.col("start_time")),
        "date": day_first(F.col("date")),
    })
    if "date_recorded" in out.columns:
        out = out.withColumn("date_recorded", day_first(F.col("date_recorded")))
    return out


def _latest_first(df: DataFrame) -> list[Column]:
    extra = [c for c in ("start_time", "ingest_seq") if c in df.columns]
    return [F.col("date_recorded").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in extra]]


def last_seen_before(obs: DataFrame) -> DataFrame:
    """Latest observation per patient and day that was recorded before the day."""
    gap = obs.withColumn("date_diff", busday_count(F.col("date"), F.col("date_recorded")))
    w = Window.partitionBy("patient_id", "date").orderBy(*_latest_first(obs))
    return gap.filter("date_diff < 0").withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def first_seen_after(obs: DataFrame) -> DataFrame:
    """Observations recorded one weekday after the day."""
    gap = obs.withColumn("date_diff", busday_count(F.col("date"), F.col("date_recorded")))
    return gap.filter("date_diff = 1")


def pair_observations(obs: DataFrame) -> DataFrame:
    """Before and after side by side; either may be missing."""
    suffix = lambda df, s: df.withColumnsRenamed({c: c + s for c in df.columns if c not in OBS_KEY})
    return suffix(last_seen_before(obs), "_before").join(suffix(first_seen_after(obs), "_after"), OBS_KEY, "full")


def label_pairs(pairs: DataFrame) -> DataFrame:
    before, after, gap, start = (F.col(c) for c in ("type_before", "type_after", "date_diff_before", "start_time"))
    out = pairs.withColumn("NoShow", rules.observed_no_show(before, after, gap, start))
    return out.withColumn("slot_outcome", rules.observed_outcome(F.col("NoShow"), before, after, gap, start))


def _dedup(df: DataFrame, *tie: str) -> DataFrame:
    return slots.dedup_patient_slot(df.withColumn("MRNCmpdId", F.col("patient_id")), *tie).drop("MRNCmpdId")


def observed_slots_direct(raw: DataFrame, test_patient_ids: Sequence = ()) -> DataFrame:
    """Slots of the study in which the outcome itself was written down."""
    df = build_observations(raw, test_patient_ids)
    df = df.withColumn("slot_outcome", rules.midnight_cancel_blank(F.col("start_time"), F.col("slot_outcome")))
    df = df.withColumn("NoShow", ~rules.holds(F.col("slot_outcome") == "show"))
    return _dedup(df, "slot_outcome", "ingest_seq")


def observed_slots(raw: DataFrame, test_patient_ids: Sequence = ()) -> DataFrame:
    """Slots of the study in which the state before and after the day was written down."""
    pairs = label_pairs(pair_observations(build_observations(raw, test_patient_ids)))
    return _dedup(pairs, "slot_outcome", "ingest_seq_before", "ingest_seq_after")


def _sides(observed: DataFrame, slot_df: DataFrame) -> DataFrame:
    """Both sources under each other with their day, outcome and patient."""
    a = observed.select(as_date(F.col("date")).alias("day"), "slot_outcome",
                        F.col("patient_id").cast("string").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = slot_df.select(as_date(F.col("start_time")).alias("day"), "slot_outcome",
                       F.col("MRNCmpdId").cast("string").alias("id"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return a.unionByName(b)


def _observed_days(observed: DataFrame) -> DataFrame:
    return observed.select(as_date(F.col("date")).alias("day")).distinct()


def jaccard(observed: DataFrame, slot_df: DataFrame, label: str | None = None) -> DataFrame:
    """Shared over all patient ids per outcome, on the observed days; two empty sets agree fully.

    Ids meet in one grouping, without a join of the sets.
    """
    days = _observed_days(observed)
    rows = _sides(observed, slot_df).join(days, "day", "left_semi").filter(
        F.col("slot_outcome").isin(K.VALIDATION_OUTCOMES) & F.col("id").isNotNull())
    ids = rows.groupBy("slot_outcome", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    per = []
    for o in K.VALIDATION_OUTCOMES:
        mine = F.col("slot_outcome") == o
        both = F.sum(F.when(mine, F.col("a") * F.col("b")))
        per.append(F.coalesce(both / F.nullif(F.count_if(mine), F.lit(0)), F.lit(1.0)).alias(o))
    out = ids.agg(*per).unpivot([], K.VALIDATION_OUTCOMES, "slot_outcome", "jaccard")
    return out.withColumn("experiment", F.lit(label)) if label else out


def jaccard_table(development: tuple[DataFrame, DataFrame], evaluation: tuple[DataFrame, DataFrame]) -> DataFrame:
    a = jaccard(*development).withColumnRenamed("jaccard", "development")
    b = jaccard(*evaluation).withColumnRenamed("jaccard", "evaluation")
    return a.join(b, "slot_outcome")


def outcomes_per_day(observed: DataFrame, slot_df: DataFrame) -> DataFrame:
    """Per observed day and outcome: patients in each source and in only one of them, and their overlap."""
    ids = _sides(observed, slot_df).groupBy("day", "slot_outcome", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    c, known = F.col, F.col("id").isNotNull()
    cells = []
    for o in K.VALIDATION_OUTCOMES:
        mine = (c("slot_outcome") == o) & known
        count = lambda e: F.count_if(mine & e)  # noqa: B023, E731
        cells.append(F.struct(
            F.lit(o).alias("slot_outcome"), count(c("a") == 1).alias("in_observed"), count(c("b") == 1).alias("in_extract"),
            count((c("a") == 1) & (c("b") == 0)).alias("only_observed"),
            count((c("a") == 0) & (c("b") == 1)).alias("only_extract"),
            count((c("a") == 1) & (c("b") == 1)).alias("in_both")))
    days = ids.groupBy("day").agg(F.max("a").alias("seen"), F.array(*cells).alias("cells")).filter("seen = 1")
    out = days.select("day", F.explode("cells").alias("x")).select("day", "x.*")
    union = c("in_observed") + c("only_extract")
    return out.withColumn("jaccard", F.when(union == 0, 1.0).otherwise(c("in_both") / F.nullif(union, F.lit(0))))


def pair_sources(observed: DataFrame, slot_df: DataFrame) -> DataFrame:
    """Full outer pairing of both sources per patient and start, with marks for the missing side."""
    d = observed.select(F.col("patient_id").cast("string").alias("id"), "start_time",
                        F.col("slot_outcome").alias("outcome_observed"))
    r = slot_df.join(_observed_days(observed), as_date(F.col("start_time")) == F.col("day"), "left_semi").select(
        F.col("MRNCmpdId").cast("string").alias("id"), "start_time", F.col("slot_outcome").alias("outcome_extract"))
    return d.join(r, ["id", "start_time"], "full").withColumns({
        "outcome_observed": F.coalesce("outcome_observed", F.lit("not present")),
        "outcome_extract": F.coalesce("outcome_extract", F.lit("missing")),
    })


def confusion_matrix(observed: DataFrame, slot_df: DataFrame,
                     outcomes: Sequence[str] = tuple(K.VALIDATION_OUTCOMES)) -> DataFrame:
    """Outcome by outcome counts in fixed order, zero where nothing met."""
    rows, columns = [*outcomes, "not present"], [*outcomes, "missing"]
    c = F.col
    pairs = pair_sources(observed, slot_df)
    cells = []
    for i, o in enumerate(rows):
        counts = [F.count_if((c("outcome_observed") == o) & (c("outcome_extract") == e)).alias(e) for e in columns]
        if o == "not present":
            counts[-1] = F.lit(0).cast("long").alias("missing")
        cells.append(F.struct(F.lit(i).alias("position"), F.lit(o).alias("outcome_observed"), *counts))
    return pairs.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("x")).select("x.*")
