"""Session settings the operators rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the run-time options results depend on; leaves sizing and memory to the cluster.

    * UTC: log times carry no zone, so wall-clock arithmetic must not meet a DST jump.
    * A fixed leaf parallelism: files are cut into the same splits by every scan of a
      query, also when executors join or leave in between (line numbers need that).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) is None:
        spark.conf.set(
            "spark.sql.leafNodeDefaultParallelism", str(spark.sparkContext.defaultParallelism)
        )
    return spark


def build_session(app_name: str = "loglake", master: str | None = None, **options: str) -> SparkSession:
    """A session for scripts and tests; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Call sites of column expressions are only for error messages; they slow planning.
        "spark.sql.dataFrameQueryContext.enabled": "false",
    }
    for key, value in {**defaults, **options}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``, else the warehouse.

    A warehouse on a machine's own disk is shared only where all run on one machine; on a cluster it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir")
    local = urlparse(folder).scheme in ("", "file")
    if local and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"executors do not share {folder!r}: set spark.checkpoint.dir to a folder they do")
    return folder.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table, in the folder all executors share; it is deleted when the session ends."""
    path = os.path.join(shared_folder(spark), "loglake", f"{label}-{uuid.uuid4().hex}")
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(location)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """A small result written to the shared folder and read back, for plans that use it several times."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
