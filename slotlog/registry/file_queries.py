"""File round trips: each query writes the derived rows in the format and reads them back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from slotlog import carriers as C
from slotlog.operators import slots
from slotlog.registry import query
from slotlog.registry.feature_queries import F_SLOTS, finished
from slotlog.registry.sql import select
from slotlog.registry.validation_queries import D
from slotlog.session import work_dir
from slotlog.sources import files

EVENT_TEXT = "event_id long, ts string, user_id long, event_type string, value double, props string"


def _events(spark, sf):
    return C.table(spark, sf, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _round_trip(spark, sf, encoding):
    path = work_dir(spark, "csv")
    _events(spark, sf).write.option("header", True).option("encoding", encoding).option("escape", '"').csv(path)
    return files.parse_times(files.read_csv(spark, path, EVENT_TEXT, encoding), ["ts"])


_EVENTS = "select event_id, ts, user_id, event_type, round(value, 6) as value, props from events"


@query("scan_csv", _EVENTS)
def _(spark, sf):
    return _round_trip(spark, sf, "UTF-8")


@query("scan_csv_utf16", _EVENTS)
def _(spark, sf):
    return _round_trip(spark, sf, "UTF-16")


_TEXT = "event_type || case event_id % 4 when 0 then '' when 1 then ', rechts' when 2 then ', links, akut' else ',a,b,c' end"


@query("scan_csv_overflow_repair", f"""select cast(event_id as varchar) as "FillerOrderNo", event_type as "Status",
  replace({_TEXT}, ',', '') as "ReasonForStudy" from events""")
def _(spark, sf):
    path = work_dir(spark, "overflow")
    line = F.expr(f"event_id || ',\"' || event_type || '\",' || {_TEXT}")
    C.table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return files.read_overflow_csv(spark, path, ["FillerOrderNo", "Status", "ReasonForStudy"], header=False)


@query("scan_excel_union", """select l_orderkey, l_linenumber, l_partkey, l_quantity,
  case when l_shipdate >= timestamp '1998-01-01' then l_tax end as l_tax, l_shipdate from lineitem""")
def _(spark, sf):
    df = C.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_shipdate")
    at = [F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (1996, 1998, 2000)]
    s = F.col("l_shipdate")
    return files.union_exports(df.filter(s < at[0]).drop("l_tax"), df.filter((s >= at[0]) & (s < at[1])).drop("l_tax"),
                               df.filter((s >= at[1]) & (s < at[2])), df.filter(s >= at[2]))


@query("scan_parquet", "select event_id, ts, user_id, event_type, round(value, 6) as value from events")
def _(spark, sf):
    path = work_dir(spark, "parquet")
    files.write_parquet(C.table(spark, sf, "events"), path, ["event_type"])
    return files.read_parquet(spark, path, ["event_id", "ts", "user_id", "event_type", "value"])


@query("scan_yaml_records", select(D, "*", "d"))
def _(spark, sf):
    df = C.observations(spark, sf)
    a, b = work_dir(spark, "records"), work_dir(spark, "records")
    late = F.col("type").isin("unt", "schr")
    df.filter(~late).write.json(a)
    df.filter(late).write.json(b)
    return files.read_records(spark, [a, b], df.schema)


@query("scan_dir_with_filename", "select count(*) as n, min(event_id) as lo, max(event_id) as hi, 0 as without_file from events")
def _(spark, sf):
    path = work_dir(spark, "dir")
    _events(spark, sf).repartition(4, "user_id").write.option("header", True).option("escape", '"').csv(path)
    df = files.read_directory(spark, path, EVENT_TEXT)
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"),
                  F.count_if(~F.col("source_file").endswith(".csv")).alias("without_file"))


@query("parse_filename_date", """select distinct strftime(ts, 'ago_%d_%m_%Y.csv') as source_file, 'ago' as file_type, day(ts) as day,
  month(ts) as month, year(ts) as year, cast(cast(ts as date) as timestamp) as file_date from events""")
def _(spark, sf):
    names = C.table(spark, sf, "events").select(
        F.concat(F.lit("ago_"), F.date_format("ts", "dd_MM_yyyy"), F.lit(".csv")).alias("source_file")).distinct()
    return files.parse_file_name(names)


_COLS = "FillerOrderNo, MRNCmpdId, start_time, NoShow"


@query("sink_append_dedup", select(F_SLOTS, f"""{_COLS}, unnest(case when start_time >= timestamp '1997-01-01' and
  FillerOrderNo % 3 = 0 then [NoShow, not NoShow] else [NoShow] end) as shown""", "f").join(
    ["select FillerOrderNo, MRNCmpdId, start_time, shown as NoShow from (", ") x"]))
def _(spark, sf):
    df = finished(spark, sf).select(*_COLS.split(", "))
    path = work_dir(spark, "master")
    at = lambda y: F.lit(dt.datetime(y, 1, 1)).cast("timestamp_ntz")
    later = df.filter(F.col("start_time") >= at(1997))
    # The second export repeats rows of the first, the third one repeats itself and has changed rows of known keys.
    changed = later.filter("FillerOrderNo % 3 = 0").withColumn("NoShow", ~F.col("NoShow"))
    for export in (df.filter(F.col("start_time") < at(1999)), later, changed.unionByName(changed), later):
        files.append_distinct(spark, path, export, "start_time")
    return spark.read.parquet(path).drop(files.MONTH)


@query("append_full_row_distinct", select(F_SLOTS, _COLS, "f"))
def _(spark, sf):
    df = finished(spark, sf).select(*_COLS.split(", "))
    at = lambda y: F.lit(dt.datetime(y, 1, 1)).cast("timestamp_ntz")
    return slots.append_new(df.filter(F.col("start_time") < at(1999)), df.filter(F.col("start_time") >= at(1997)))
