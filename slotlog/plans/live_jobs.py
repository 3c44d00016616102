"""The daily loop as set-based jobs: live files to status log, features, outcomes and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotlog.functions import dates
from slotlog.operators import cleaning, features, ordered, scoring, slots, status
from slotlog.plans import feature_jobs
from slotlog.session import cut_lineage
from slotlog.sources.files import parse_file_name

FILE = ["source_file", "file_date"]


def lookup_fill(df: DataFrame, side: DataFrame, key: str, column: str) -> DataFrame:
    """Fill nulls of ``column`` from a side table with one value per key."""
    fill = side.select(key, F.col(column).alias("fill__value")).filter(F.col("fill__value").isNotNull())
    fill = fill.groupBy(key).agg(F.min("fill__value").alias("fill__value"))
    have = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return df.join(fill, key, "left").withColumn(column, F.coalesce(have, F.col("fill__value"))).drop("fill__value")


def assemble_status(files: DataFrame, reasons: DataFrame | None = None, with_source_file: bool = False) -> DataFrame:
    """Rows of all live files as one status log."""
    df = files if with_source_file else files.drop("source_file")
    if reasons is not None:
        df = lookup_fill(df, reasons, "FillerOrderNo", "ReasonForStudy")
    return status.build_status_log(cleaning.prepare_raw(df.distinct()))


def file_logs(files: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """One status log per file, all files in one plan."""
    df = files if reasons is None else lookup_fill(files, reasons, "FillerOrderNo", "ReasonForStudy")
    df = parse_file_name(df).drop("file_type", "day", "month", "year")
    return status.build_status_log(cleaning.prepare_raw(df), per=FILE)


def outcome_slots(files: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Slots of the day each outcome file is about."""
    log = file_logs(files, reasons)
    out = slots.build_slots(log, [F.col("file_date"), F.col("file_date")], per=FILE)
    return cleaning.drop_id_prefix(cleaning.drop_any_null(out)).withColumnRenamed("source_file", "file")


def live_features(files: DataFrame, post_codes: DataFrame, site: str, reasons: DataFrame | None = None,
                  live: bool = False) -> DataFrame:
    """Features per file as of the day it was made.

    Retrospective files were written three weekdays before their date; ``live`` files
    are scored on their own date for the two weekdays that follow.
    """
    log = file_logs(files, reasons)
    made = F.col("file_date") if live else dates.subtract_business_days(F.col("file_date"), 3)
    out = feature_jobs.features_ahead(log, made, post_codes, site, live=live, per=FILE)
    return cleaning.drop_id_prefix(out.withColumn("made_on", made))


def retrospective_features(files: DataFrame, actual_log: DataFrame, valid_date_range, history: DataFrame,
                           post_codes: DataFrame, site: str, reasons: DataFrame | None = None) -> DataFrame:
    """Features of all files with their outcome and the patients' full history."""
    out = live_features(files, post_codes, site, reasons).drop(*features.HISTORY_COLUMNS, *FILE, "made_on")
    actual = slots.build_slots(actual_log, valid_date_range).select("MRNCmpdId", "start_time", "NoShow")
    out = out.drop("NoShow").join(actual, ["MRNCmpdId", "start_time"], "left")
    out = slots.dedup_patient_slot(out.withColumn("NoShow", F.coalesce("NoShow", F.lit(False))).distinct())
    return features.add_no_show_before(out, history, patients=hot_patients(history))


def hot_patients(slot_df: DataFrame) -> ordered.HotChunks | None:
    """Patients with more slots than one task should take."""
    return ordered.find_hot_chunks(slot_df, ["MRNCmpdId"], ["start_time", "FillerOrderNo"])


def history_as_known(new: DataFrame, past: DataFrame, known: DataFrame | None = None, patients: ordered.HotChunks | None = None) -> DataFrame:
    """Rows of planning files that are new, with the patient's history as it was known when each file was made.

    Two times count: when an appointment was, and since which file it is known. A row of file k sees what lies before it in
    ``past``, in its own file, and, where ``known`` outcomes reach that far, in files before k. All files are
    counted together: appointments of earlier files are those whose first file number is smaller than k, which is so if at one
    bit the two numbers part, k having a one there. So for each bit of the number of files one ordered pass over the rows gives the sum, and the
    work does not grow with files times history. A row that is in ``past`` or in an earlier file already is no new row,
    but stands for itself in its own file.
    """
    c = F.col
    key, order = ["FillerOrderNo", "start_time"], ["start_time", "FillerOrderNo", "is_event"]
    names = parse_file_name(new.select("source_file").distinct()).select(
        "source_file", (F.row_number().over(Window.orderBy("file_date", "source_file")) - 1).alias("file_no"))  # one row a file
    names = cut_lineage(names, "file-order")
    bits = max(names.count() - 1, 0).bit_length() if known is not None else 0
    missed = F.coalesce(c("NoShow").cast("long"), F.lit(0).cast("long"))
    rows = new.drop(*features.HISTORY_COLUMNS).join(F.broadcast(names), "source_file").withColumn("missed", missed)
    past = past.select("MRNCmpdId", *key, "NoShow").distinct().withColumn("missed", missed)
    seen = past.groupBy(*key).agg(F.count(F.lit(1)).alias("past_n"), F.sum("missed").alias("past_missed"))
    rows = rows.join(seen, key, "left")
    again, again_missed = F.coalesce("past_n", F.lit(0)), F.coalesce("past_missed", F.lit(0))
    events = [past.select("MRNCmpdId", *key, F.lit(1).alias("past_event"), c("missed").alias("event_missed"))]
    if known is not None:
        outcome = known.groupBy("start_time", "MRNCmpdId").agg(F.max("NoShow").alias("NoShow"))
        first = rows.filter(c("past_n").isNull() & (c("start_time") <= known.agg(F.max("start_time")).scalar())).groupBy(
            "MRNCmpdId", *key).agg(F.min("file_no").alias("first_no")).join(outcome, ["start_time", "MRNCmpdId"], "left")
        first = cut_lineage(first.select("MRNCmpdId", *key, "first_no", missed.alias("first_missed")), "first-files")
        rows = rows.join(first.drop("MRNCmpdId"), key, "left")
        earlier = F.coalesce(c("first_no") < c("file_no"), F.lit(False))
        again, again_missed = again + earlier.cast("long"), again_missed + F.when(earlier, c("first_missed")).otherwise(0)
        events.append(first.select("MRNCmpdId", *key, c("first_no").alias("file_no"), c("first_missed").alias("event_missed")))
    rows = rows.withColumns({"again": again, "own_n": 1 - again, "own_missed": c("missed") - again_missed}).drop("past_n", "past_missed", "missed", "first_no", "first_missed")
    rows = rows.withColumn("is_event", F.lit(0))
    for e in events:  # an event at a row's very place is that row itself and comes after it
        rows = rows.unionByName(e.withColumn("is_event", F.lit(1)), allowMissingColumns=True)
    rows = patients.add(rows, order[:2]) if patients else rows
    is_past = c("past_event").isNotNull()
    rows = ordered.with_ordered(rows, ["MRNCmpdId"], order, {
        "n_past": ordered.sum_before(F.when(is_past, 1).otherwise(0)), "m_past": ordered.sum_before(F.when(is_past, c("event_missed")).otherwise(0))})
    rows = ordered.with_ordered(rows, ["MRNCmpdId", "source_file"], order, {
        "n_own": ordered.sum_before(F.coalesce("own_n", F.lit(0))), "m_own": ordered.sum_before(F.coalesce("own_missed", F.lit(0)))})
    counts = {"n": c("n_past") + c("n_own"), "m": c("m_past") + c("m_own")}
    for b in range(bits):
        bit = F.shiftright("file_no", b).bitwiseAND(1)
        there = (c("is_event") == 1) & ~is_past & (bit == 0)
        rows = rows.withColumn("part", F.shiftright("file_no", b + 1))
        rows = ordered.with_ordered(rows, ["MRNCmpdId", "part"], order, {
            f"n_{b}": ordered.sum_before(F.when(there, 1).otherwise(0)), f"m_{b}": ordered.sum_before(F.when(there, c("event_missed")).otherwise(0))})
        counts = {x: e + F.when(bit == 1, c(f"{x}_{b}")).otherwise(0) for x, e in counts.items()}
    out = rows.filter((c("is_event") == 0) & (c("again") == 0)).withColumns({"appts_before": counts["n"], "no_show_before": counts["m"]})
    kept = [x for x in new.columns if x not in features.HISTORY_COLUMNS]
    return features.add_history_rates(out.select(*kept, "appts_before", "no_show_before"))


def new_rows(df: DataFrame, history: DataFrame, keys: Sequence[str] = ("FillerOrderNo", "start_time")) -> DataFrame:
    return df.join(history.select(*keys), list(keys), "left_anti")


def attach_late_outcome(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Predictions with outcomes so far; rows newer than the newest outcome wait."""
    known = actuals.select("start_time", "MRNCmpdId", "NoShow")
    out = predictions.drop("NoShow").join(known, ["start_time", "MRNCmpdId"], "left")
    out = out.withColumn("NoShow", F.coalesce("NoShow", F.lit(False)))
    return out.filter(F.col("start_time") <= actuals.agg(F.max("start_time")).scalar())


def score_batch(df: DataFrame, models: Mapping[str, Transformer]) -> DataFrame:
    """One clipped probability column per model; helper columns of the models do not stay."""
    for name, model in models.items():
        scored = scoring.positive_probability(model.transform(df), name="prediction_" + name)
        df = scored.select(*df.columns, "prediction_" + name)
    return df
