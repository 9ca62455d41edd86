"""Counts over entries: summary, levels, timeline, heatmap, top errors, loggers, threads.

Time-based results are built on :func:`minute_rollup`. It is a map-side hash aggregate
over fixed-width columns; what follows it works on at most one row per minute and level
of the calendar, however many entries there are, so sorting that in one task is safe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglake.functions.arguments import interval_seconds
from loglake.functions.expressions import error_signature, from_micros, micros
from loglake.model import ERROR, level_of
from loglake.operators.calendar import beside
from loglake.operators.filters import filter_level_expression, first_rows
from loglake.session import kept

TOP_ERRORS_LIMIT = 10
TOP_NAMES_LIMIT = 20
HEATMAP_LEVEL = "ERROR+"
# Where the shares of the peak begin that count as intensity 2, 3 and 4.
HEATMAP_STEPS = [0.25, 0.5, 0.75]

def _everything():
    return Window.partitionBy()


# --- roll-up --------------------------------------------------------------------


def time_rollup(df: DataFrame, seconds: int = 60) -> DataFrame:
    """``(slot, severity) -> n, first_us, last_us``; slot is the time in units of ``seconds``.

    Entries without a time fall into the slot null.
    """
    t = micros(F.col("ts"))
    return (
        df.select(F.floor(t / (seconds * 1_000_000)).alias("slot"), "severity", t.alias("t"))
        .groupBy("slot", "severity")
        .agg(F.count("*").alias("n"), F.min("t").alias("first_us"), F.max("t").alias("last_us"))
    )


def minute_rollup(df: DataFrame) -> DataFrame:
    return time_rollup(df, 60)


# --- summary ----------------------------------------------------------------------


def _summary_columns(total: Column, first_us: Column, last_us: Column) -> list[Column]:
    return [
        F.coalesce(total, F.lit(0)).cast("bigint").alias("total"),
        from_micros(first_us).alias("start_ts"),
        from_micros(last_us).alias("end_ts"),
        F.coalesce(F.floor((last_us - first_us) / 1_000_000), F.lit(0))
        .cast("bigint")
        .alias("duration_s"),
    ]


def summary(df: DataFrame) -> DataFrame:
    """Number of entries, first and last time, whole seconds between them."""
    t = micros(F.col("ts"))
    bounds = df.agg(F.count("*").alias("n"), F.min(t).alias("a"), F.max(t).alias("b"))
    return bounds.select(*_summary_columns(F.col("n"), F.col("a"), F.col("b")))


def summary_of_rollup(rollup: DataFrame) -> DataFrame:
    bounds = rollup.agg(F.sum("n").alias("n"), F.min("first_us").alias("a"), F.max("last_us").alias("b"))
    return bounds.select(*_summary_columns(F.col("n"), F.col("a"), F.col("b")))


def _level_shares(counts: DataFrame) -> DataFrame:
    shares = counts.withColumn("total", F.sum("n").over(_everything()))
    return shares.select(
        level_of(F.col("severity")).alias("level"),
        "severity",
        "n",
        F.expr("n * 100 div total").alias("pct"),
    ).orderBy("severity")


def level_distribution(df: DataFrame) -> DataFrame:
    """Entries per level that occurs, with their share in whole percent; at most six rows."""
    return _level_shares(df.groupBy("severity").agg(F.count("*").alias("n")))


def level_distribution_of_rollup(rollup: DataFrame) -> DataFrame:
    return _level_shares(rollup.groupBy("severity").agg(F.sum("n").alias("n")))


#: Buckets of a gap that are made together.
FILL_RUN = 4096

# --- timeline -----------------------------------------------------------------------


def timeline(df: DataFrame, interval: str | int = "1h", level: str | None = None) -> DataFrame:
    """Entries per bucket from the hour of the first entry to the last one, gaps as zero.

    Buckets start on that hour, so their edges lie on multiples of gcd(interval, 1 hour):
    entries are counted in such slots before the first time is known, in one pass; the counts are written, as they are small.
    """
    step = interval_seconds(interval)
    slot = math.gcd(step, 3600)
    return timeline_of_rollup(kept(time_rollup(df, slot), "slots"), interval, level, slot)


def timeline_of_rollup(
    rollup: DataFrame, interval: str | int = "1h", level: str | None = None, slot: int = 60
) -> DataFrame:
    """The timeline from a roll-up whose slots divide both the interval and the hour."""
    step = interval_seconds(interval)
    if math.gcd(step, 3600) % slot:
        raise ValueError(f"slots of {slot} s do not fit an interval of {step} s")
    slots = (
        filter_level_expression(rollup, level)
        .where("slot IS NOT NULL")
        .groupBy((F.col("slot") * slot).alias("at"))
        .agg(F.sum("n").alias("n"))
    )
    first = beside(slots, "at", step * FILL_RUN, totals={"first": ("min", "at")})
    anchored = first.withColumn("start", F.floor(F.col("first") / 3600) * 3600)
    buckets = anchored.groupBy(F.expr(f"(at - start) div {step} * {step} + start").alias("bucket")).agg(F.sum("n").alias("n"))
    filled = beside(buckets, "bucket", step * FILL_RUN, after=True, totals={"peak": ("max", "n")}, next="bucket").select(
        "bucket", "n", (F.col("n") == F.col("peak")).alias("is_peak"), F.coalesce("next", F.col("bucket") + step).alias("next")
    )
    # Gaps are filled in runs of bounded length: one far-off time must not become one array.
    run = step * FILL_RUN
    filled = filled.withColumn("run", F.explode(F.expr(f"sequence(bucket, next - {step}, {run})"))).withColumn(
        "at", F.explode(F.expr(f"sequence(run, least(next - {step}, run + {run - step}), {step})"))
    )
    counted = F.col("at") == F.col("bucket")
    return filled.select(
        F.timestamp_seconds("at").cast("timestamp_ntz").alias("bucket"),
        F.when(counted, F.col("n")).otherwise(F.lit(0)).alias("n"),
        (counted & F.col("is_peak")).alias("is_peak"),
    ).orderBy("bucket")


# --- heatmap --------------------------------------------------------------------------


def _heat_cells(rollup: DataFrame, level: str | None) -> DataFrame:
    at = from_micros(F.col("first_us"))
    return (
        filter_level_expression(rollup, level)
        .where("slot IS NOT NULL")
        .groupBy(F.weekday(at).alias("dow"), F.hour(at).alias("hour"))
        .agg(F.sum("n").alias("n"), F.max("last_us").alias("last_us"))
    )


def heatmap(df: DataFrame, level: str | None = HEATMAP_LEVEL) -> DataFrame:
    """Entries per weekday (0 = Monday) and hour: 168 rows with an intensity of 0 to 4."""
    return heatmap_of_rollup(time_rollup(df, 3600), level)


def heatmap_of_rollup(rollup: DataFrame, level: str | None = HEATMAP_LEVEL) -> DataFrame:
    spark = rollup.sparkSession
    grid = spark.range(0, 168, 1, 1).select(
        F.expr("cast(id div 24 as int)").alias("dow"), (F.col("id") % 24).cast("int").alias("hour")
    )
    cells = grid.join(_heat_cells(rollup, level), ["dow", "hour"], "left").select(
        "dow", "hour", F.coalesce("n", F.lit(0)).alias("n")
    )
    ratio = F.col("n") / F.max("n").over(_everything())
    intensity = F.when(F.col("n") == 0, 0)
    for value, bound in enumerate(HEATMAP_STEPS, start=1):
        intensity = intensity.when(ratio < bound, value)
    return cells.withColumn("intensity", intensity.otherwise(4).cast("int")).orderBy("dow", "hour")


def heatmap_peak(df: DataFrame, level: str | None = HEATMAP_LEVEL) -> DataFrame:
    """The cell that was first to reach the highest count; no row without entries."""
    return heatmap_peak_of_rollup(time_rollup(df, 3600), level)


def heatmap_peak_of_rollup(rollup: DataFrame, level: str | None = HEATMAP_LEVEL) -> DataFrame:
    # A cell reaches its final count at its last entry, and no two cells share a time.
    cells = _heat_cells(rollup, level)
    return cells.orderBy(F.desc("n"), "last_us").limit(1).select("dow", "hour", "n")


# --- groups -----------------------------------------------------------------------------


def _top(df: DataFrame, key: str, limit: int | None) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return first_rows(counts.orderBy(F.desc("n"), key), limit)


def top_errors(df: DataFrame, limit: int | None = TOP_ERRORS_LIMIT) -> DataFrame:
    """Most frequent signatures of entries of ERROR and above; a limit below 1 means 10, ``None`` all."""
    errors = df.where(F.col("severity") >= ERROR).select(
        error_signature(F.col("message"), F.col("stack_trace")).alias("signature")
    )
    return _top(errors, "signature", TOP_ERRORS_LIMIT if limit is not None and limit <= 0 else limit)


def count_by_logger(df: DataFrame, level: str | None = None, limit: int | None = TOP_NAMES_LIMIT) -> DataFrame:
    """Loggers with the most entries of a level expression; ``limit=None`` gives all."""
    return _top(filter_level_expression(df, level).where("logger IS NOT NULL"), "logger", limit)


def count_by_thread(df: DataFrame, limit: int | None = TOP_NAMES_LIMIT) -> DataFrame:
    """Threads with the most entries; ``limit=None`` gives all."""
    return _top(df.where("thread IS NOT NULL"), "thread", limit)
