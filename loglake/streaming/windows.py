"""The timeline and the call sessions over a stream of entries.

State is bounded by the watermark: one counter per open bucket, or one row per open session.
What is open when a log ends stays in the state. To have it, too, a stream takes ``marks``: a
second source that holds one far-off time once :func:`mark_end` is called. The next run from the
same checkpoint then finds the watermark past every entry and emits all that is open; the mark
itself is never emitted. Entries that come after the mark are late.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loglake.functions.arguments import duration_millis, interval_seconds
from loglake.model import ERROR
from loglake.operators.filters import filter_level_expression


_MARK_SCHEMA = "thread string, ts timestamp_ntz, severity int"
_END = "9000-01-01 00:00:00"


def _marks(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(rows).select(
        F.lit(None).cast("string").alias("thread"), F.lit(_END).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("severity")
    )


def end_marks(spark: SparkSession, folder: str) -> DataFrame:
    """The source of end marks in a folder of its own, for ``marks``; empty until :func:`mark_end`."""
    _marks(spark, 0).write.mode("append").parquet(folder)
    return spark.readStream.schema(_MARK_SCHEMA).parquet(folder)


def mark_end(spark: SparkSession, folder: str) -> None:
    """Say that all entries have been read by the runs so far."""
    _marks(spark, 1).coalesce(1).write.mode("append").parquet(folder)


def _with_marks(entries: DataFrame, marks: DataFrame | None, *columns: str) -> DataFrame:
    entries = entries.select(*columns)
    return entries if marks is None else entries.unionByName(marks.select(*columns))


def _event_time(entries: DataFrame, delay: str) -> DataFrame:
    """Watermarks need a zoned time; the session zone is UTC, so the wall clock is kept."""
    return entries.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def _local(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def timeline_stream(
    entries: DataFrame,
    interval: str | int = "1h",
    level: str | None = None,
    delay: str = "10 minutes",
    start: datetime | None = None,
    marks: DataFrame | None = None,
) -> DataFrame:
    """Entries per bucket, each emitted once the watermark has passed it; no zero rows.

    Buckets are counted from ``start`` (by default from 1970), in both directions. The batch
    timeline counts from the hour of its first entry, which a stream cannot know beforehand.
    """
    step = interval_seconds(interval)
    shift = int(start.replace(tzinfo=UTC).timestamp()) % step if start else 0
    buckets = F.window("ts", f"{step} seconds", startTime=f"{shift} seconds")
    counted = (
        _event_time(_with_marks(filter_level_expression(entries, level), marks, "ts"), delay)
        .groupBy(buckets.alias("w"))
        .agg(F.count("*").alias("n"))
    )
    return counted.select(_local(F.col("w.start")).alias("bucket"), "n")


def flow_sessions_stream(
    entries: DataFrame, window: str | int = "2s", delay: str = "10 minutes", marks: DataFrame | None = None
) -> DataFrame:
    """Sessions per thread: start, end, size and whether an error occurred."""
    # The batch rule compares whole milliseconds, so a gap may exceed the window by 999 microseconds.
    gap = f"{duration_millis(window) * 1000 + 999} microseconds"
    runs = (
        _event_time(_with_marks(entries, marks, "thread", "ts", "severity"), delay)
        .groupBy("thread", F.session_window("ts", gap).alias("w"))
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.count("*").alias("n_entries"),
            F.max((F.col("severity") >= ERROR).cast("int")).alias("bad"),
        )
    )
    return runs.select(
        "thread",
        _local(F.col("start_ts")).alias("start_ts"),
        _local(F.col("end_ts")).alias("end_ts"),
        "n_entries",
        (F.col("bad") == 1).alias("has_error"),
    )
