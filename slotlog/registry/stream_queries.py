"""Streaming and live-file queries: the status log as daily files."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from slotlog import carriers as C
from slotlog.operators import features
from slotlog.plans import live_jobs, model_jobs as M
from slotlog.registry import query
from slotlog.registry.machine_queries import V
from slotlog.registry.sql import RANGE, S, SLOTS, STATUS, select
from slotlog.registry.status_queries import log, slot_table
from slotlog.session import cut_lineage, work_dir
from slotlog.streaming import daily

ENCODING = "UTF-16"


def _named(df, kind, day):
    return df.withColumn("source_file", F.concat(F.lit(kind + "_"), F.date_format(day, "dd_MM_yyyy"), F.lit(".csv")))


def _text(df):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.withColumns({c: stamp(c) for c in ("History_MessageDtTm", "History_ObsStartPlanDtTm", "DateOfBirth")})


def write_files(df, name):
    """One UTF-16 file per ``source_file``; the folder carries the name."""
    path = work_dir(df.sparkSession, name)
    _text(df).repartition("source_file").write.partitionBy("source_file").option("header", True).option(
        "encoding", ENCODING).option("escape", '"').csv(path)
    schema = T.StructType([f if f.dataType != T.TimestampNTZType() else T.StructField(f.name, T.StringType())
                           for f in df.schema.fields])
    return path, schema


def outcome_files(spark, sf):
    """A file per planned day with all rows of the appointment number that was planned then."""
    return write_files(_named(C.status(spark, sf), "ago", F.col("History_ObsStartPlanDtTm")), "ago")


def planning_files(spark, sf):
    """A file per planned day, as sent out ahead of it."""
    return write_files(_named(C.status(spark, sf), "out", F.col("History_ObsStartPlanDtTm")), "out")


# Per file: the rows of the file alone make the log.
_F = S.replace("s as (", "s as (select *, cast(History_ObsStartPlanDtTm as date) as file_date from (", 1) + " x)"
_PER = SLOTS.replace(S, _F).replace("partition by FillerOrderNo", "partition by file_date, FillerOrderNo").replace(
    "partition by MRNCmpdId", "partition by file_date, MRNCmpdId").replace(
    "select FillerOrderNo, MRNCmpdId,", "select file_date, FillerOrderNo, MRNCmpdId,").replace(
    "group by 1, 2, 3)", "group by all)").replace("group by 1, 2)", "group by all)")
_OWN = """where cast(start_time as date) = file_date and not starts_with(MRNCmpdId, 'SMS') and end_time is not null and
  slot_outcome is not null"""
_OUT = "strftime(file_date, 'ago_%d_%m_%Y.csv') as file, FillerOrderNo, MRNCmpdId, start_time, end_time, NoShow, slot_outcome"
_OUT_COLS = ["file", "FillerOrderNo", "MRNCmpdId", "start_time", "end_time", "NoShow", "slot_outcome"]


@query("stream_outcome_files", select(_PER, _OUT, "sl", _OWN))
def _(spark, sf):
    path, schema = outcome_files(spark, sf)
    table = work_dir(spark, "actuals")
    stream = daily.read_files(spark, path, schema, ENCODING)
    daily.outcomes(stream, table, work_dir(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(table).select(*_OUT_COLS)


@query("outcome_files_batch", select(_PER, _OUT, "sl", _OWN))
def _(spark, sf):
    raw = _named(C.status(spark, sf), "ago", F.col("History_ObsStartPlanDtTm"))
    return live_jobs.outcome_slots(raw).select(*_OUT_COLS)


MODEL_COLUMNS = ["age", "sched_days_advanced", "hour_sched", "no_show_before"]


def _model(training):
    rows = training.select(*MODEL_COLUMNS, F.col("NoShow").cast("int").alias("label"))
    return M.train(rows, M.feature_stages(MODEL_COLUMNS), M.logistic())


@query("stream_score_files")
def _(spark, sf):
    pc = C.post_codes(spark, sf)
    history = features.add_calendar(features.add_no_show_before(C.slots(spark, sf))).withColumn(
        "sched_days_advanced", F.lit(4).cast("long") + F.col("age") % 3)
    # The fit reads its rows many times and each batch looks up the past: both from one stored table of the columns they use.
    used = dict.fromkeys(["MRNCmpdId", "FillerOrderNo", "start_time", "NoShow", *MODEL_COLUMNS])
    history = cut_lineage(history.select(*used), "history")
    path, schema = planning_files(spark, sf)
    table = work_dir(spark, "predictions")
    stream = daily.read_files(spark, path, schema, ENCODING)
    daily.scores(stream, table, work_dir(spark, "checkpoint"), {"logistic": _model(history)}, history, pc,
                 C.SITE_POST_CODE).awaitTermination()
    return spark.read.parquet(table).select("source_file", "FillerOrderNo", "MRNCmpdId", "start_time", *features.HISTORY_COLUMNS,
                                            F.col("prediction_logistic").between(0, 1).alias("is_probability"))


def fed_out_of_order(df, part, run):
    """Writes ``df`` to a folder in three turns, newest days first, so that most rows come late, and lets a stream work off the new files after each."""
    path = work_dir(df.sparkSession, "arrivals")
    for i in range(3):
        rows = df.filter(part == F.lit(i)).withColumn("arrival", F.lit(i).cast("long"))
        rows.write.mode("append").parquet(path)
        run(df.sparkSession.readStream.schema(rows.schema).parquet(path)).awaitTermination()


def newest_first(time):
    """0 for a far day in the future, 1 for even days, 2 for odd ones."""
    day = F.dayofmonth(time)
    return F.when(day >= 25, 0).when(day % 2 == 0, 1).otherwise(2)


@query("stream_dedup_actuals", "select user_id, event_type, count(*) as n from (select distinct user_id, event_type, "
       "date_trunc('day', ts) as d from events) group by 1, 2")
def _(spark, sf):
    table, checkpoint = work_dir(spark, "deduped"), work_dir(spark, "checkpoint")
    e = C.table(spark, sf, "events").withColumn("start_time", F.date_trunc("day", "ts"))
    again = e.filter("event_id % 5 = 0")
    fed_out_of_order(e.unionByName(again), newest_first("ts"), lambda stream: daily.dedup_actuals(
        stream, table, checkpoint, ["user_id", "event_type", "start_time"], order=["arrival", "event_id"]))
    return spark.read.parquet(table).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_daily_utilisation", select(V, """cast(date_trunc('day', image_start) as timestamp) as date, image_device_id,
  round(sum(date_diff('microsecond', image_start, image_end) / 60e6), 6) as active_minutes, count(*) as appointments""", "v",
  "group by 1, 2"))
def _(spark, sf):
    table, checkpoint = work_dir(spark, "utilisation"), work_dir(spark, "checkpoint")
    fed_out_of_order(C.intervals(spark, sf), newest_first("image_start"), lambda stream: daily.daily_active(stream, table, checkpoint))
    return daily.daily_totals(spark, table)


# ---------------------------------------------------------------- live tables

@query("assemble_live_status", select(STATUS, "FillerOrderNo, ingest_seq, MRNCmpdId, date, was_status, now_status, NoShow, slot_type",
                                      "st"))
def _(spark, sf):
    path, schema = outcome_files(spark, sf)
    files = spark.read.schema(schema).option("header", True).option("encoding", ENCODING).option("multiLine", True).option(
        "escape", '"').csv(path)
    # The name column comes from the folder layout here.
    return live_jobs.assemble_status(files).select(
        "FillerOrderNo", "ingest_seq", "MRNCmpdId", "date", "was_status", "now_status", "NoShow", "slot_type")


@query("live_file_features")
def _(spark, sf):
    raw = _named(C.status(spark, sf), "out", F.col("History_ObsStartPlanDtTm"))
    out = live_jobs.live_features(raw, C.post_codes(spark, sf), C.SITE_POST_CODE)
    return out.select("source_file", "made_on", "FillerOrderNo", "MRNCmpdId", "start_time", "sched_days_advanced", "modality")


@query("retrospective_features")
def _(spark, sf):
    raw = _named(C.status(spark, sf), "out", F.col("History_ObsStartPlanDtTm"))
    pc = C.post_codes(spark, sf)
    out = live_jobs.retrospective_features(raw, log(spark, sf), RANGE, slot_table(spark, sf), pc, C.SITE_POST_CODE)
    return out.select("FillerOrderNo", "MRNCmpdId", "start_time", "NoShow", *features.HISTORY_COLUMNS)
