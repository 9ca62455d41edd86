"""A mergeable roll-up of message templates, and the reports that need no more than it.

One row per template, minute and level holds how often it occurs, its first and last time, and its first entry. Roll-ups of
any parts of a log add up to that of the whole, in any order: rows are appended as logs arrive and summed when read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglake.functions.expressions import micros, normalize_message
from loglake.model import ERROR, LOAD_ORDER, WARN
from loglake.operators.filters import first_rows

_MINUTE_US = 60_000_000
KEYS = ["pattern", "minute", "severity"]
SCHEMA = (
    "pattern string, minute bigint, severity int, n bigint, first_us bigint, last_us bigint, "
    "first struct<source_file: string, line_number: bigint, ts: timestamp_ntz, message: string>"
)


def template_rollup(df: DataFrame) -> DataFrame:
    """``(pattern, minute, severity, n, first_us, last_us, first)`` of entries of WARN and above.

    ``minute`` is null for entries without a time; ``first`` is the first entry in load order. Tasks fold their rows
    before the shuffle, so a template that holds most entries costs a row per minute.
    """
    rows = df.where(F.col("severity") >= WARN).select(
        normalize_message(F.col("message")).alias("pattern"), "severity", micros(F.col("ts")).alias("t"), *LOAD_ORDER, "ts", "message"
    )
    return rows.groupBy("pattern", F.floor(F.col("t") / _MINUTE_US).alias("minute"), "severity").agg(
        F.count("*").alias("n"), F.min("t").alias("first_us"), F.max("t").alias("last_us"),
        F.min(F.struct(*LOAD_ORDER, "ts", "message")).alias("first"),
    )


def merged(*rollups: DataFrame) -> DataFrame:
    """The roll-up of several logs, or parts of one, as if they were one."""
    return reduce(DataFrame.unionByName, rollups).groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.min("first").alias("first")
    )


def add_templates(rollup: DataFrame, path: str) -> str:
    """Append a roll-up to a stored one; nothing that is stored is read or written again."""
    rollup.write.mode("append").parquet(path)
    return path


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    """The sum of all roll-ups stored at a path."""
    return merged(spark.read.schema(SCHEMA).parquet(path))


# --- what follows from it ----------------------------------------------------------------


def _errors(rollup: DataFrame) -> DataFrame:
    errors = rollup.where(F.col("severity") >= ERROR)
    return errors.groupBy("pattern").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def patterns_of_rollup(rollup: DataFrame, limit: int | None) -> DataFrame:
    counts = _errors(rollup).where("n > 1").select("pattern", "n")
    return first_rows(counts.orderBy(F.desc("n"), "pattern"), limit)


def first_errors_of_rollup(rollup: DataFrame, limit: int | None) -> DataFrame:
    return first_rows(_errors(rollup).select("first.*", "pattern").orderBy(*LOAD_ORDER), limit)


def unique_errors_of_rollup(rollup: DataFrame, limit: int | None) -> DataFrame:
    only = _errors(rollup).where("n = 1").select(*[f"first.{c}" for c in LOAD_ORDER], "first.ts", "pattern")
    return first_rows(only.orderBy(*LOAD_ORDER), limit)


def minutes_of_rollup(rollup: DataFrame) -> DataFrame:
    """``(pattern, minute, n, first_us, last_us)`` over all levels, of entries with a time."""
    timed = rollup.where("minute IS NOT NULL")
    return timed.groupBy("pattern", "minute").agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")
    )
