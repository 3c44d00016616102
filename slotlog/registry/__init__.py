"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module, util

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain_types(df: DataFrame) -> DataFrame:
    """Types that both engines print alike: long, double to six places, timestamps without zone, text, boolean."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # Scale, round half away, scale back: the same steps as the oracle's round().
            d = c.cast("double")
            c = F.signum(d) * (F.floor(F.abs(d) * 1e6 + 0.5) / F.lit(1e6)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain_types(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Columns that DuckDB gives as 32-bit integers; they are widened to the long that Spark's side has.
NARROW = {
    "reason_rank": ["reason_cascade"],
    "sex": ["code_map_features", "build_feature_set", "features_ahead", "features_ahead_live", "snapshot_range_join",
            "generate_training_data"],
    "StationName": ["map_station_code", "preprocess_images"],
    "big_image_gap": ["image_time_columns", "trim_edge_gaps", "preprocess_images"],
    "image_device_id": ["image_interval", "opening_hours_agg", "calendar_gap_fill", "interval_join_calendar", "idle_gaps",
                        "appts_and_gaps", "idle_time", "idle_daily", "idle_monthly", "idle_yearly", "melt_metrics",
                        "stream_daily_utilisation"],
    "day_start_tp": ["opening_hours_agg", "calendar_gap_fill"],
    "day_end_tp": ["opening_hours_agg", "calendar_gap_fill"],
    "first_appt": ["idle_gaps"],
    "one_side_buffer_flag": ["idle_gaps"],
    "position": ["confusion_matrix_two_sources"],
    "l_linenumber": ["clip_probability", "split_by_time", "feature_pipeline", "custom_scalar_transform", "scan_excel_union"],
    "label": ["fold_assign"],
    "trials": ["permutation_test", "permutation_test_log_loss"],
    "without_file": ["scan_dir_with_filename"],
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in ORACLES.items():
        casts = ", ".join(f"cast({c} as bigint) as {c}" for c, names in NARROW.items() if name in names)
        out[name] = f"select * replace ({casts}) from ({sql}) widened" if casts else sql
    return out


def load_all() -> None:
    """Import the query modules; each registers its own."""
    for topic in ("status", "feature", "machine", "validation", "describe", "model", "file", "stream"):
        name = f"slotlog.registry.{topic}_queries"
        if util.find_spec(name):
            import_module(name)
