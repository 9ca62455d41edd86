"""Call flows: runs of entries of one thread without a long gap, and their clusters.

One thread may write a third of all entries, and one run may never end. So entries are
range-sorted by (thread, time): tasks get equal shares of the rows, cut at any point.
Each task folds its share to fragments in one pass; only the first and the last fragment
of a task can go on elsewhere, and just these few are stitched together.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglake.functions.arguments import duration_millis
from loglake.functions.expressions import from_micros, micros, minute_label, short_logger, thousands
from loglake.functions.tasks import FRAGMENT_SCHEMA, fold_sessions
from loglake.model import ERROR
from loglake.operators.filters import first_rows

FLOW_WINDOW = "2s"
FLOW_LIMIT = 10
CLUSTER_THREADS = 3
# Names a signature shows, how they are joined, and the label of no thread.
SIGNATURE_NAMES = 6
NAME_JOIN = " -> "
MORE_NAMES = " -> ..."
NO_THREAD = "(sem thread)"
# Threads of one signature are ranked in this many groups before the groups are merged.
_RANKING_GROUPS = 256


def _step_name() -> Column:
    name = short_logger(F.col("logger"))
    return F.when(name == "", F.col("level")).otherwise(name)


def _fragments(df: DataFrame, window_millis: int) -> DataFrame:
    order = ["thread", "t", "source_file", "line_number"]
    steps = df.where("ts IS NOT NULL").select(
        *order[:1],
        micros(F.col("ts")).alias("t"),
        *order[2:],
        (F.col("severity") >= ERROR).alias("is_error"),
        _step_name().alias("name"),
    )
    fold = partial(fold_sessions, window_millis=window_millis, keep=SIGNATURE_NAMES + 1)
    return (
        steps.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("thread", "t", "is_error", "name")
        .mapInArrow(fold, FRAGMENT_SCHEMA)
    )


def _signature(names: Column) -> Column:
    """The first names, dots for more; names are already free of consecutive repeats."""
    shown = F.array_join(F.slice(names, 1, SIGNATURE_NAMES), NAME_JOIN)
    return F.when(F.size(names) > SIGNATURE_NAMES, F.concat(shown, F.lit(MORE_NAMES))).otherwise(shown)


def _without_repeats(names: Column) -> Column:
    return F.filter(names, lambda name, i: (i == 0) | (name != F.get(names, i - 1)))


def flow_sessions(df: DataFrame, window: str | int = FLOW_WINDOW) -> DataFrame:
    """One row per session: a gap longer than ``window`` starts a new one.

    Entries without a time are left out; entries without a thread form a group of their own.
    """
    millis = duration_millis(window)
    fragments = _fragments(df, millis)
    # Inner fragments are complete and leave at once: the one shuffle is that of the entries.
    inner = fragments.where(~F.col("edge")).select(
        "thread", "start", "finish", F.col("entries").alias("n_entries"), "has_error", "names"
    )
    # The edges of one thread meet in a group of at most two rows per task.
    in_order = Window.partitionBy("thread").orderBy("task", "seq")
    gap = F.floor((F.col("start") - F.lag("finish").over(in_order)) / 1000)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        fragments.where("edge")
        .withColumn("_new", F.coalesce((gap > millis).cast("int"), F.lit(0)))
        .withColumn("_run", F.sum("_new").over(so_far))
    )
    parts = F.sort_array(F.collect_list(F.struct("task", "seq", "names")))["names"]
    stitched = numbered.groupBy("thread", "_run").agg(
        F.min("start").alias("start"),
        F.max("finish").alias("finish"),
        F.sum("entries").alias("n_entries"),
        F.bool_or("has_error").alias("has_error"),
        _without_repeats(F.flatten(parts)).alias("names"),
    )
    return inner.unionByName(stitched.drop("_run")).select(
        "thread",
        from_micros(F.col("start")).alias("start_ts"),
        from_micros(F.col("finish")).alias("end_ts"),
        "n_entries",
        _signature(F.col("names")).alias("signature"),
        "has_error",
    )


def flow_clusters(
    df: DataFrame,
    window: str | int = FLOW_WINDOW,
    min_sessions: int = 1,
    limit: int | None = FLOW_LIMIT,
    rarest_first: bool = False,
) -> DataFrame:
    """Sessions grouped by signature, the most frequent first; ``limit=None`` gives all.

    Sums go from (signature, thread) over groups of threads to the signature, and each
    group keeps its three busiest threads, so no signature is ranked in one task.
    """
    by_thread = flow_sessions(df, window).groupBy("signature", "thread").agg(
        F.count("*").alias("sessions"),
        F.sum("n_entries").alias("total_entries"),
        F.count_if("has_error").alias("error_sessions"),
        F.min(F.struct("start_ts", F.coalesce("thread", F.lit("")).alias("thread"), "end_ts")).alias("example"),
    )
    grouped = by_thread.withColumn("_group", F.pmod(F.xxhash64("thread"), F.lit(_RANKING_GROUPS)))
    rank = Window.partitionBy("signature", "_group").orderBy(F.desc("sessions"), "_label")
    label = F.coalesce("thread", F.lit(NO_THREAD))
    ranked = grouped.withColumn("_label", label).withColumn("_rank", F.row_number().over(rank))
    busiest = F.when(
        F.col("_rank") <= CLUSTER_THREADS, F.struct((-F.col("sessions")).alias("less"), F.col("_label"))
    )
    sums = [F.sum(c).alias(c) for c in ("sessions", "total_entries", "error_sessions")]
    groups = ranked.groupBy("signature", "_group").agg(
        *sums, F.min("example").alias("example"), F.collect_list(busiest).alias("busiest")
    )
    clusters = groups.groupBy("signature").agg(
        *sums,
        F.min("example").alias("example"),
        F.slice(F.sort_array(F.flatten(F.collect_list("busiest"))), 1, CLUSTER_THREADS).alias("busiest"),
    )
    top_threads = F.transform(
        "busiest", lambda b: F.struct(b["_label"].alias("thread"), (-b["less"]).alias("n"))
    )
    order = [F.asc("sessions") if rarest_first else F.desc("sessions"), F.desc("total_entries"), "signature"]
    shown = (
        clusters.where(F.col("sessions") >= max(1, min_sessions))
        .select(
            "signature",
            "sessions",
            "total_entries",
            "error_sessions",
            top_threads.alias("top_threads"),
            F.col("example.start_ts").alias("example_start"),
            F.col("example.end_ts").alias("example_end"),
        )
        .orderBy(*order)
    )
    return first_rows(shown, FLOW_LIMIT if limit is not None and limit <= 0 else limit)


def thread_summary(top_threads: Column) -> Column:
    """``exec-1 (1.204), exec-7 (18)``."""
    return F.array_join(
        F.transform(top_threads, lambda t: F.concat(t["thread"], F.lit(" ("), thousands(t["n"]), F.lit(")"))),
        ", ",
    )


def example_window(start: Column, end: Column) -> Column:
    return F.concat(minute_label(start), F.lit(NAME_JOIN), minute_label(end))


# --- the call around one line --------------------------------------------------------


def _call_entries(df: DataFrame, line: int, window: str | int, source_file: str | None) -> tuple[Column, DataFrame]:
    """The anchor entry, and the entries near it on its thread.

    The anchor is a scalar subquery: it runs when the result is asked for, and its time and thread are then values a
    columnar source prunes row groups by. Without an anchor, or one without a time, nothing is near.
    """
    wanted = F.col("line_number") == line
    if source_file is not None:
        wanted = wanted & (F.col("source_file") == source_file)
    row = F.struct("source_file", micros(F.col("ts")).alias("t"), "thread").alias("anchor")
    anchor = df.where(wanted).select(row).orderBy("anchor.source_file").limit(1).scalar()
    reach = (duration_millis(window) + 1) * 1000
    near = (F.col("ts") > from_micros(anchor["t"] - reach)) & (F.col("ts") < from_micros(anchor["t"] + reach))
    return anchor, df.where(near & (anchor["thread"].isNull() | (F.col("thread") == anchor["thread"])))


def probable_call(
    df: DataFrame, line: int, window: str | int = FLOW_WINDOW, source_file: str | None = None
) -> DataFrame:
    """Entries within the window around a line, on the line's thread (any, if it has none)."""
    anchor, entries = _call_entries(df, line, window, source_file)
    return entries.orderBy("ts", "line_number", "source_file").select(
        "source_file",
        "line_number",
        "ts",
        "level",
        "thread",
        short_logger(F.col("logger")).alias("logger"),
        "message",
        ((F.col("line_number") == line) & (F.col("source_file") == anchor["source_file"])).alias("is_anchor"),
    )


def probable_call_summary(
    df: DataFrame, line: int, window: str | int = FLOW_WINDOW, source_file: str | None = None
) -> DataFrame:
    """Thread, period, size and signature of the call around a line; no row if there is none."""
    anchor, entries = _call_entries(df, line, window, source_file)
    whole = 2 * duration_millis(window) + 2
    call = flow_sessions(entries.withColumn("thread", anchor["thread"]), f"{whole}ms")
    return call.withColumn("anchor_line", F.lit(line).cast("bigint"))
