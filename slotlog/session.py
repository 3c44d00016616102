"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "slotlog", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators assume; a cluster's own settings win where they are given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that tasks on several executors share.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a
    local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="slotlog-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


#: With it, a statement's shuffle files go when it ends. Else they stay until the driver's JVM happens to collect the plan.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df, name: str, large: bool = False):
    """Write ``df`` to the shared folder and read it back: the plan starts anew and survives lost executors.

    ``large`` is for jobs that store several times the input one after the other: the files are packed more
    tightly, and the shuffle files of the write are removed as soon as it is done.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    if large:
        before = spark.conf.get(_DROP_SHUFFLES, "false")
        spark.conf.set(_DROP_SHUFFLES, "true")
        try:
            df.write.parquet(path, compression="zstd")
        finally:
            spark.conf.set(_DROP_SHUFFLES, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
