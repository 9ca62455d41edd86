"""Message templates and the anomaly detectors: spikes, unique errors, rhythms, gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglake.functions.arguments import interval_seconds
from loglake.functions.expressions import from_micros, micros, normalize_message
from loglake.model import ERROR, LOAD_ORDER, WARN
from loglake.operators.calendar import beside
from loglake.operators.filters import first_rows
from loglake.operators.stats import minute_rollup
from loglake.operators.templates import minutes_of_rollup, template_rollup, unique_errors_of_rollup
from loglake.session import kept

# The limits and thresholds of the reports and detectors.
PATTERN_LIMIT = 10
FIRST_ERRORS_LIMIT = 20
FINDINGS_PER_DETECTOR = 5
SPIKE_BUCKET = "5m"
SPIKE_FACTOR = 3
SPIKE_MIN_COUNT = 5
SPIKE_MIN_ERRORS = 10
SPIKE_MIN_BUCKETS = 3
RHYTHM_MIN_OCCURRENCES = 5
RHYTHM_FACTOR = 0.5
GAP_FACTOR = 10.0
GAP_MIN_MINUTES = 5
CRITICAL = "CRITICO"
ALERT = "ALERTA"

_MINUTE_US = 60_000_000
#: Minutes ordered by one task when gaps are looked for: a week.
GAP_STRETCH = 7 * 24 * 60
#: Seconds whose buckets are summed up together when spikes are looked for.
SPIKE_STRETCH = 7 * 24 * 3600


def _templates(df: DataFrame, min_severity: int, *columns: str | Column) -> DataFrame:
    return df.where(F.col("severity") >= min_severity).select(
        normalize_message(F.col("message")).alias("pattern"), *columns
    )


# --- templates ------------------------------------------------------------------


def patterns(df: DataFrame, limit: int | None = PATTERN_LIMIT) -> DataFrame:
    """Templates of errors that occur more than once, most frequent first; ``limit=None`` gives all."""
    counts = _templates(df, ERROR).groupBy("pattern").agg(F.count("*").alias("n"))
    return first_rows(counts.where("n > 1").orderBy(F.desc("n"), "pattern"), limit)


def first_errors(df: DataFrame, limit: int | None = FIRST_ERRORS_LIMIT) -> DataFrame:
    """First entry of each error template, in load order; ``limit=None`` gives all."""
    first = F.min(F.struct(*LOAD_ORDER, "ts", "message")).alias("first")
    seen = _templates(df, ERROR, *LOAD_ORDER, "ts", "message").groupBy("pattern").agg(first)
    return first_rows(seen.select("first.*", "pattern").orderBy(*LOAD_ORDER), limit)


# --- detectors --------------------------------------------------------------------


def error_spikes(
    df: DataFrame, bucket: str | int = SPIKE_BUCKET, factor: int = SPIKE_FACTOR, min_count: int = SPIKE_MIN_COUNT
) -> DataFrame:
    """Clock buckets with more than ``factor`` times the average number of errors."""
    return error_spikes_of_rollup(minute_rollup(df), bucket, factor, min_count)


def error_spikes_of_rollup(
    rollup: DataFrame,
    bucket: str | int = SPIKE_BUCKET,
    factor: int = SPIKE_FACTOR,
    min_count: int = SPIKE_MIN_COUNT,
) -> DataFrame:
    step = interval_seconds(bucket)
    if step % 60:
        raise ValueError(f"spike buckets are whole minutes: {bucket!r}")
    errors = rollup.where((F.col("severity") >= ERROR) & F.col("slot").isNotNull())
    counts = errors.groupBy(F.expr(f"slot * 60 div {step} * {step}").alias("at")).agg(
        F.sum("n").alias("n")
    )
    totals = {"errors": ("sum", "n"), "buckets": ("count", "n")}
    stats = beside(counts, "at", SPIKE_STRETCH, totals=totals).withColumn("baseline", F.expr("errors div buckets"))
    enough = (F.col("errors") >= SPIKE_MIN_ERRORS) & (F.col("buckets") >= SPIKE_MIN_BUCKETS)
    high = (F.col("n") > F.col("baseline") * factor) & (F.col("n") > min_count)
    return (
        stats.where(enough & high)
        .select(F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "n", "baseline")
        .orderBy("ts")
    )


def unique_errors(df: DataFrame, limit: int | None = FINDINGS_PER_DETECTOR) -> DataFrame:
    """Error templates that occur exactly once, first in load order first."""
    only = F.min(F.struct(*LOAD_ORDER, "ts")).alias("only")
    counts = _templates(df, ERROR, *LOAD_ORDER, "ts").groupBy("pattern").agg(
        F.count("*").alias("n"), only
    )
    found = counts.where("n = 1").select("only.*", "pattern").orderBy(*LOAD_ORDER)
    return first_rows(found, limit)


def recurring_patterns(
    df: DataFrame, factor: float = RHYTHM_FACTOR, limit: int | None = FINDINGS_PER_DETECTOR
) -> DataFrame:
    """Templates of WARN and above that return at a steady pace, in whole minutes.

    Only an interval that crosses a minute mark can be a whole minute long, so entries of
    one template and minute are first folded to their first and last time. ``lag`` then
    runs over at most one row per minute, also for a template that holds most entries.
    The squared deviation from the integer mean is expanded, so one pass sums it.
    """
    t = micros(F.col("ts"))
    minutes = (
        _templates(df.where("ts IS NOT NULL"), WARN, t.alias("t"))
        .groupBy("pattern", F.floor(F.col("t") / _MINUTE_US).alias("minute"))
        .agg(F.count("*").alias("n"), F.min("t").alias("first_us"), F.max("t").alias("last_us"))
    )
    return recurring_of_minutes(minutes, factor, limit)


def recurring_of_minutes(minutes: DataFrame, factor: float = RHYTHM_FACTOR, limit: int | None = FINDINGS_PER_DETECTOR) -> DataFrame:
    """The same from ``(pattern, minute, n, first_us, last_us)``."""
    in_order = Window.partitionBy("pattern").orderBy("minute")
    spaced = minutes.withColumn(
        "gap", F.floor((F.col("first_us") - F.lag("last_us").over(in_order)) / _MINUTE_US)
    )
    sums = spaced.groupBy("pattern").agg(
        F.sum("n").alias("n"),
        F.min("first_us").alias("first_us"),
        F.coalesce(F.sum("gap"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).alias("squares"),
    )
    paced = (
        sums.where(F.col("n") >= RHYTHM_MIN_OCCURRENCES)
        .withColumn("mean", F.expr("total div (n - 1)"))
        .withColumn(
            "deviation",
            F.expr(
                "cast(floor(sqrt((squares - 2 * mean * total + (n - 1) * mean * mean) div (n - 1))) as bigint)"
            ),
        )
    )
    found = (
        paced.where((F.col("mean") > 0) & (F.col("deviation") < F.col("mean") * factor))
        .select(from_micros(F.col("first_us")).alias("ts"), "pattern", "n", "mean", "deviation")
        .orderBy("ts", "pattern")
    )
    return first_rows(found, limit)


def log_gaps(
    df: DataFrame, factor: float = GAP_FACTOR, limit: int | None = FINDINGS_PER_DETECTOR
) -> DataFrame:
    """Silences longer than five minutes and ``factor`` times the average spacing."""
    return log_gaps_of_rollup(kept(minute_rollup(df), "minutes"), factor, limit)


def log_gaps_of_rollup(
    rollup: DataFrame, factor: float = GAP_FACTOR, limit: int | None = FINDINGS_PER_DETECTOR
) -> DataFrame:
    """A gap of minutes lies between two occupied minutes, so per-minute rows suffice."""
    minutes = (
        rollup.where("slot IS NOT NULL")
        .groupBy("slot")
        .agg(
            F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")
        )
    )
    totals = {"entries": ("sum", "n"), "first": ("min", "first_us"), "last": ("max", "last_us")}
    spaced = beside(minutes, "slot", GAP_STRETCH, totals=totals, before_us="last_us").select(
        "before_us", "first_us", "entries", F.floor((F.col("last") - F.col("first")) / _MINUTE_US).alias("minutes")
    ).withColumn("gap_minutes", F.floor((F.col("first_us") - F.col("before_us")) / _MINUTE_US))
    threshold = F.col("minutes") / F.col("entries") * factor
    long = (F.col("gap_minutes") > GAP_MIN_MINUTES) & (F.col("gap_minutes") > threshold)
    found = (
        spaced.where((F.col("minutes") > 0) & long)
        .select(from_micros(F.col("before_us")).alias("ts"), "gap_minutes")
        .orderBy("ts")
    )
    return first_rows(found, limit)


# --- all of them ---------------------------------------------------------------------


def findings(
    df: DataFrame,
    rollup: DataFrame | None = None,
    spike_bucket: str | int = SPIKE_BUCKET,
    recurring_factor: float = RHYTHM_FACTOR,
    gap_factor: float = GAP_FACTOR,
    limit: int | None = FINDINGS_PER_DETECTOR,
    templates: DataFrame | None = None,
) -> DataFrame:
    """What all detectors report, in their order: ``(ord, detector, severity, ts, pattern, n, baseline)``.

    Spikes and gaps share one roll-up per minute, templates one per template and minute (see
    :mod:`loglake.operators.templates`). A caller may have them at hand; otherwise each is made in one scan and written, as
    both are small. Every detector but the spikes gives its first ``limit`` findings; ``None`` gives all.
    """
    rollup = kept(minute_rollup(df), "minutes") if rollup is None else rollup
    templates = kept(template_rollup(df), "templates") if templates is None else templates
    none = F.lit(None)

    def part(ord, detector, severity, found, pattern, n, baseline):
        return found.select(
            F.lit(ord).alias("ord"),
            F.lit(detector).alias("detector"),
            F.lit(severity).alias("severity"),
            "ts",
            pattern.cast("string").alias("pattern"),
            n.cast("bigint").alias("n"),
            baseline.cast("double").alias("baseline"),
        )

    parts = [
        part(1, "spike", CRITICAL, error_spikes_of_rollup(rollup, spike_bucket), none, F.col("n"), F.col("baseline")),
        part(2, "unique_error", CRITICAL, unique_errors_of_rollup(templates, limit), F.col("pattern"), F.lit(1), none),
        part(
            3, "recurring", ALERT, recurring_of_minutes(minutes_of_rollup(templates), recurring_factor, limit),
            F.col("pattern"), F.col("n"), F.col("mean"),
        ),
        part(4, "gap", ALERT, log_gaps_of_rollup(rollup, gap_factor, limit), none, F.col("gap_minutes"), none),
    ]
    return reduce(DataFrame.unionByName, parts)
