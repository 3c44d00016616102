"""The daily file loop as Structured Streaming queries.

The checkpoint of each query is the ledger of processed files. Sinks append to
parquet tables; a repeated batch finds its rows already there and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotlog.functions.dates import minutes_between
from slotlog.plans import live_jobs
from slotlog.session import cut_lineage
from slotlog.sources import files as sources


def read_files(spark: SparkSession, path: str, schema, encoding: str = "UTF-16", max_files: int | None = None,
               ignore: Sequence[str] = ()) -> DataFrame:
    """Stream of the CSV files of a folder with the name of the file per row.

    A schema column ``source_file`` is taken from the folder layout (``source_file=.../``),
    else it is the file's own name. Files listed in ``ignore`` are passed over.
    """
    reader = (spark.readStream.schema(schema).option("header", True).option("encoding", encoding)
              .option("escape", '"').option("multiLine", encoding.upper().startswith("UTF-16")))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.csv(path)
    if "source_file" not in df.columns:
        df = df.withColumn("source_file", F.col("_metadata.file_name"))
    return df.filter(~F.col("source_file").isin(list(ignore))) if ignore else df


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off all files that are there, batch by batch, then stop."""
    return (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(handle).start())


def outcomes(stream: DataFrame, table: str, checkpoint: str, reasons: DataFrame | None = None) -> StreamingQuery:
    """Outcome files to slots, appended to the table of actual outcomes."""

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        sources.append_distinct(spark, table, live_jobs.outcome_slots(batch, reasons), "start_time")

    return run_batches(stream, checkpoint, handle)


def scores(stream: DataFrame, table: str, checkpoint: str, models: Mapping[str, Transformer], history: DataFrame,
           post_codes: DataFrame, site: str, reasons: DataFrame | None = None,
           actuals: str | None = None) -> StreamingQuery:
    """Planning files to scored features, appended to the prediction table.

    Files count in the order of the date in their name, each against what was known by then: earlier slots, and
    predictions of earlier files as far as outcomes are in ``actuals``. So the rows do not depend on how many files
    come in a batch, as long as batches come in that order too. All files of a batch are one job.
    """
    hot = live_jobs.hot_patients(history)

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keys = ["MRNCmpdId", "FillerOrderNo", "start_time", "NoShow"]
        new = cut_lineage(live_jobs.live_features(batch, post_codes, site, reasons, live=True), "file-features")
        past = history.select(*keys)
        known = sources.table_or_none(spark, actuals) if actuals else None
        done = sources.table_or_none(spark, table) if known is not None else None
        if done is not None:
            # Files of this batch are left out, so a repeated batch sees what it saw the first time.
            done = done.join(new.select("source_file").distinct(), "source_file", "left_anti")
            past = past.unionByName(live_jobs.attach_late_outcome(done, known).select(*keys))
        past = past.join(new.select("MRNCmpdId").distinct(), "MRNCmpdId", "left_semi")
        counted = live_jobs.history_as_known(new, cut_lineage(past, "file-history"), known, hot)
        sources.append_distinct(spark, table, live_jobs.score_batch(counted, models), "start_time")

    return run_batches(stream, checkpoint, handle)


def dedup_actuals(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str], time: str = "start_time",
                  order: Sequence[str] = ()) -> StreamingQuery:
    """One row per key of a stream of outcomes, merged into a table by month; the first one in ``order`` of the first batch stays.

    No watermark: a row that comes late, or after one that lies far ahead, is held against the
    table's rows of its own month like any other, and there is no state that grows.
    """
    return run_batches(stream, checkpoint,
                       lambda batch, _: sources.append_first(batch.sparkSession, table, batch, list(keys), time, order))


def active_by_day(intervals: DataFrame) -> DataFrame:
    """Active minutes and appointments per device and day."""
    active = minutes_between(F.col("image_start"), F.col("image_end"))
    timed = intervals.withColumns({"date": F.date_trunc("day", F.col("image_start")).cast("timestamp_ntz"), "minutes": active})
    return timed.groupBy("date", "image_device_id").agg(F.sum("minutes").alias("active_minutes"),
                                                        F.count(F.lit(1)).alias("appointments"))


def daily_active(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Partial sums per device and day of each batch, written to a folder of the batch's own.

    A batch that is repeated replaces its own folder. Late days are sums like any other; ``daily_totals`` adds them up.
    """
    return run_batches(stream, checkpoint,
                       lambda batch, epoch: active_by_day(batch).write.mode("overwrite").parquet(f"{table}/epoch={epoch}"))


def daily_totals(spark: SparkSession, table: str) -> DataFrame:
    """Active minutes and appointments per device and day over all batches so far."""
    return spark.read.parquet(table).groupBy("date", "image_device_id").agg(
        F.sum("active_minutes").alias("active_minutes"), F.sum("appointments").alias("appointments"))
