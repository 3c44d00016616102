"""File sources and sinks of the daily exchange."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

CORRUPT = "corrupt_record"


def read_csv(spark: SparkSession, path, schema: T.StructType | str, encoding: str = "UTF-8",
             multi_line: bool | None = None) -> DataFrame:
    """CSV with header and a given schema. UTF-16 needs whole-file reading, so such files are one task each."""
    if multi_line is None:
        multi_line = encoding.upper().startswith("UTF-16")
    return (spark.read.schema(schema).option("header", True).option("encoding", encoding).option("escape", '"')
            .option("multiLine", multi_line).csv(path))


def parse_times(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in columns})


def split_fields(line: Column) -> Column:
    """Fields of one CSV line; commas inside quotes belong to the field, doubled quotes are one quote."""
    found = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(found, lambda f: F.when(
        f.startswith('"') & f.endswith('"') & (F.length(f) >= 2),
        F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def read_overflow_csv(spark: SparkSession, path, columns: Sequence[str], text_column: str = "ReasonForStudy",
                      encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """CSV whose free text may hold unquoted commas: surplus fields are put back behind the text column.

    Only rows with too many fields are taken apart again; the files stay as they are.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    raw = (spark.read.schema(schema).option("header", header).option("encoding", encoding).option("escape", '"')
           .option("multiLine", encoding.upper().startswith("UTF-16")).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    n = len(columns)
    line = F.regexp_replace(CORRUPT, r"[\r\n]+$", "")
    df = raw.withColumn("fields", F.when(F.col(CORRUPT).isNotNull(), split_fields(line)))
    long = F.size("fields") > n
    surplus = F.array_join(F.slice("fields", n + 1, F.greatest(F.size("fields") - n, F.lit(1))), "")
    fixed = {}
    for i, c in enumerate(columns):
        value = F.nullif(F.try_element_at("fields", F.lit(i + 1)), F.lit(""))
        if c == text_column:
            value = F.concat(F.coalesce(value, F.lit("")), surplus)
        fixed[c] = F.when(long, value).otherwise(F.col(c))
    return df.select(*[v.alias(c) for c, v in fixed.items()])


def union_exports(*exports: DataFrame) -> DataFrame:
    """Exports of several periods under each other by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), exports)


def read_records(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Record lists as JSON lines; all paths are one table."""
    return spark.read.schema(schema).json(list(paths))


def read_directory(spark: SparkSession, path: str, schema, encoding: str = "UTF-8", pattern: str = "*.csv") -> DataFrame:
    """All files of a folder with the name of the file each row came from."""
    df = (spark.read.schema(schema).option("header", True).option("encoding", encoding).option("escape", '"')
          .option("multiLine", encoding.upper().startswith("UTF-16")).option("pathGlobFilter", pattern).csv(path))
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def parse_file_name(df: DataFrame, column: str = "source_file") -> DataFrame:
    """``type_day_month_year.csv`` to its parts and its date."""
    name = F.col(column)
    part = lambda i: F.regexp_extract(name, r"^([^_]+)_(\d+)_(\d+)_(\d+)\.csv$", i)
    out = df.withColumns({"file_type": part(1), "day": part(2).try_cast("long"), "month": part(3).try_cast("long"),
                          "year": part(4).try_cast("long")})
    return out.withColumn("file_date", F.expr("try_make_timestamp(cast(year as int), cast(month as int), "
                                              "cast(day as int), 0, 0, 0)").cast("date"))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


#: Partition column of tables that are appended to: the month of a row as text.
MONTH = "part_month"


def with_month(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(MONTH, F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("none")))


def rows_of_months(spark: SparkSession, path: str, new: DataFrame) -> DataFrame | None:
    """What a table partitioned by month holds of the months in ``new``; other partitions are not read.

    The months come to the driver: one short text for each calendar month of a batch.
    """
    old = table_or_none(spark, path)
    if old is None:
        return None
    months = [r[0] for r in new.select(MONTH).distinct().collect()]
    return old.withColumn(MONTH, F.col(MONTH).cast("string")).filter(F.col(MONTH).isin(months))


def append_distinct(spark: SparkSession, path: str, new: DataFrame, time: str) -> None:
    """Append rows that the table does not hold yet, whole rows compared, nulls being equal to nulls.

    The table is partitioned by the month of column ``time`` and only the months of ``new`` are read. A row with a
    known key and other content is a row of its own. Old files stay untouched, and a repeated batch adds nothing.
    """
    fresh = with_month(new, time).distinct()
    old = rows_of_months(spark, path, fresh)
    if old is not None:
        fresh = fresh.exceptAll(old.select(*fresh.columns).distinct())
    fresh.write.mode("append").partitionBy(MONTH).parquet(path)


def append_first(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], time: str, order: Sequence[str]) -> None:
    """Append one row for each key that the table does not hold yet: the first in order of ``order``.

    ``time`` is one of the keys; only its months are read. No row is ever too late.
    """
    rest = [c for c in new.columns if c not in keys]
    ordered = [*order, *(c for c in rest if c not in order)]
    picked = new.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("first")).select(*keys, *(F.col(f"first.{c}").alias(c) for c in rest))
    fresh = with_month(picked, time)
    old = rows_of_months(spark, path, fresh)
    if old is not None:
        same = [fresh[k].eqNullSafe(old[k]) for k in [*keys, MONTH]]
        fresh = fresh.join(old, reduce(lambda a, b: a & b, same), "left_anti")
    fresh.write.mode("append").partitionBy(MONTH).parquet(path)
