"""The registered queries: every operator over the given tables.

The log is the projection of ``events``. Text sources and sinks go through real files: the
entries are written to the shared scratch folder as the text of a format, and read back.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loglake.operators import anomalies, context, filters, flows, stacks, stats
from loglake.plans.report import executive_report, write_report
from loglake.session import configure, scratch_dir
from loglake.sinks import export, rewrite
from loglake.sources.events import (
    CUSTOM_TEMPLATE,
    events_as_logs,
    ordered_logs,
    render_lines,
    stream_events,
    write_text_log,
    write_text_logs,
)
from loglake.sources.stored import load_entries, save_entries
from loglake.sources.text import (
    file_formats,
    lines_of,
    load_report,
    read_folder,
    read_glob,
    read_lines,
    read_logs,
)
from loglake.streaming.tail import tail_filter, tail_stream
from loglake.streaming.windows import end_marks, flow_sessions_stream, mark_end, timeline_stream

Query = Callable[[SparkSession, str], DataFrame]

# The moment "now" of the relative time filters, so that their results do not change.
NOW = datetime(2024, 1, 30, 12, 0, 0)
# Parameters that find something in events, which are sparse (about one in four minutes).
SPIKE_BUCKET = "60m"
RECURRING_FACTOR = 1.5
GAP_FACTOR = 5.0
SESSION_WINDOW = "600s"
CLUSTER_WINDOW = "2h"
CALL_LINE = 500
CALL_WINDOW = "6h"
PART_SIZE = "64KB"
LONG_MESSAGE = 70_000
TEXT_FORMATS = ("logback", "log4j", "json", "nginx", "apache")


def _on_logs(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """A query that applies an operator to the log of ``events``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return operator(events_as_logs(spark, sf_dir), *args, **kwargs)

    return run


def _filtered(**conditions) -> Query:
    def run(df: DataFrame) -> DataFrame:
        kept = filters.filter_logs(df, now=NOW, **conditions)
        return kept.select("line_number", "ts", "level", "logger", "thread", "message")

    return _on_logs(run)


def _filter_range_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    path = save_entries(events_as_logs(spark, sf_dir), scratch_dir(spark, "entries"))
    kept = load_entries(spark, path, "2024-01-10", "2024-01-12 18:30")
    return kept.select("line_number", "ts", "level", "logger", "thread", "message")


def _as_text_files(spark: SparkSession, sf_dir: str, kind: str) -> str:
    path = scratch_dir(spark, kind)
    write_text_logs(ordered_logs(spark, sf_dir), {kind: path})
    return path


_PARSED = ["line", "ts", "level", "severity", "logger", "thread", "message", "stack_trace", "raw"]


def _with_lines(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries with ``line``, their line counted through all files in the order of their names."""
    before = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    files = lines.groupBy("source_file").agg(F.count("*").alias("n"))
    offsets = files.select("source_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return entries.join(offsets, "source_file").withColumn("line", F.col("offset") + F.col("line_number"))


def _parsed(kind: str, format: str | None = None, pattern: str | None = None) -> Query:
    """Events written as text of a format, then parsed; the format is detected unless given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        path = _as_text_files(spark, sf_dir, kind)
        return _with_lines(read_logs(spark, path, format, pattern), read_lines(spark, path)).select(*_PARSED)

    return run


#: What the files of a folder, or of a tree, begin with: names that readers tend to lose, in the order of names.
ODD_NAMES = (".x-", "[1]-", "_x-", "b %41-", "day=7-")
ODD_FOLDERS = ("a/prod/", "b/_c/prod/", "b/other/", "day=1/prod/_", "prod/.")


def _as_log_files(spark: SparkSession, sf_dir: str, prefixes: tuple[str, ...]) -> str:
    """Events as a logback log in ``.log`` files: an entry's line number decides which prefix its file has."""
    root = scratch_dir(spark, "names")
    fs = spark._jvm.org.apache.hadoop.fs
    for i, prefix in enumerate(prefixes):
        some = events_as_logs(spark, sf_dir).where(F.col("line_number") % len(prefixes) == i)
        written = write_text_log(render_lines(some, "logback"), scratch_dir(spark, "names-part"))
        files = sorted(unquote(uri) for uri in spark.read.text(written).inputFiles())
        for n, file in enumerate(files):
            to = fs.Path(f"{root}/{prefix}{n:05d}.log")
            system = to.getFileSystem(spark._jsc.hadoopConfiguration())
            system.mkdirs(to.getParent())
            system.rename(fs.Path(file), to)
    return root


_ENTRY = ["ts", "level", "logger", "thread", "message", "stack_trace"]


def _read_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder whose files have names Spark's own readers pass over or take for patterns."""
    configure(spark)
    entries = read_folder(spark, _as_log_files(spark, sf_dir, ODD_NAMES))
    name = F.url_decode(F.replace(F.element_at(F.split("source_file", "/"), -1), F.lit("+"), F.lit("%2B")))
    return entries.select(F.regexp_replace(name, r"\d{5}\.log$", "").alias("name"), *_ENTRY)


def _read_glob_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree, of which the files in folders of one name are read, at any depth."""
    configure(spark)
    root = _as_log_files(spark, sf_dir, ODD_FOLDERS)
    return read_glob(spark, f"{root}/**/prod/*.log").select(*_ENTRY)


def _detect_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON log whose first line, and every thousandth, is very long: detection sees whole lines."""
    configure(spark)
    long = F.when(F.col("line_number") % 1000 == 1, F.repeat(F.lit("m"), F.lit(LONG_MESSAGE))).otherwise("")
    entries = events_as_logs(spark, sf_dir).withColumn("message", F.concat(long, "message"))
    path = write_text_log(render_lines(entries, "json"), scratch_dir(spark, "long"))
    return read_logs(spark, path).select("ts", "level", F.length("message").cast("bigint").alias("characters"))


def _parse_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formats in one folder tree; each file is read in its own format."""
    configure(spark)
    root = scratch_dir(spark, "mixed")
    write_text_logs(ordered_logs(spark, sf_dir), {kind: f"{root}/{kind}" for kind in TEXT_FORMATS})
    entries = read_glob(spark, f"{root}/**/*.txt")
    return entries.groupBy(_parent("source_file").alias("folder"), "level").agg(
        F.count("*").alias("n"), F.count("stack_trace").alias("stacks"), F.count("ts").alias("times")
    )


def _parent(path: str):
    return F.element_at(F.split(F.col(path), "/"), -2)


def _detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    root = scratch_dir(spark, "detect")
    write_text_logs(ordered_logs(spark, sf_dir), {kind: f"{root}/{kind}" for kind in TEXT_FORMATS})
    found = file_formats(spark, root, recursiveFileLookup="true")
    sizes = read_lines(spark, root, recursiveFileLookup="true").groupBy("source_file").agg(
        F.count("*").alias("lines")
    )
    return (
        found.join(sizes, "source_file")
        .groupBy(_parent("source_file").alias("folder"), "format")
        .agg(F.sum("lines").alias("lines"))
    )


def _load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    path = _as_text_files(spark, sf_dir, "logback")
    lines = read_lines(spark, path)
    formats = file_formats(spark, path)
    report = load_report(lines, formats)
    return report.groupBy("format").agg(F.sum("lines").alias("lines"), F.sum("entries").alias("entries"))


def _headers_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level counts of a logback log without assembling stack traces: a map-only parse."""
    configure(spark)
    path = _as_text_files(spark, sf_dir, "logback")
    entries = read_folder(spark, path, "txt", stacks=False)
    return stats.level_distribution(entries)


def _split(write: Callable[[DataFrame, str], str], key: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        path = write(events_as_logs(spark, sf_dir), scratch_dir(spark, f"split-{key}"))
        return spark.read.text(path).select(F.col(key).cast("string").alias(key), "value")

    return run


def _split_size(exact: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        lines = lines_of(render_lines(events_as_logs(spark, sf_dir), "nginx"))
        out = rewrite.write_parts(rewrite.assign_parts(lines, PART_SIZE, exact), scratch_dir(spark, "split-size"))
        return rewrite.read_ordered(spark, out, by="part").withColumn("part", F.col("part").cast("bigint"))

    return run


def _merge(order: str, *kinds: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        written = {kind: _as_text_files(spark, sf_dir, kind) for kind in dict.fromkeys(kinds)}
        out = rewrite.merge_files(spark, [written[kind] for kind in kinds], scratch_dir(spark, "merged"), order)
        return rewrite.read_ordered(spark, out)

    return run


def _merge_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    out = rewrite.merge_folder(spark, _as_log_files(spark, sf_dir, ODD_NAMES), scratch_dir(spark, "merged"))
    return rewrite.read_ordered(spark, out)


def _export(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        df = events_as_logs(spark, sf_dir)
        out = export.export_logs(df, kind, scratch_dir(spark, f"export-{kind}"), source="events")
        if kind == "json":
            schema = "line bigint, timestamp string, level string, logger string, thread string, message string, stackTrace string"
            return spark.read.schema(schema).json(out)
        return spark.read.text(out)

    return run


def _export_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spark.read.text(export.export_stacks(events_as_logs(spark, sf_dir), scratch_dir(spark, "stacks")))


def _flow_clusters(df: DataFrame) -> DataFrame:
    clusters = flows.flow_clusters(df, CLUSTER_WINDOW, min_sessions=2, limit=25)
    return clusters.select(
        "signature",
        "sessions",
        "total_entries",
        "error_sessions",
        flows.thread_summary(F.col("top_threads")).alias("threads"),
        flows.example_window(F.col("example_start"), F.col("example_end")).alias("example"),
    )


def _streamed(spark: SparkSession, stream: DataFrame, label: str, marks: str | None = None) -> DataFrame:
    """Run a stream over what is there now, into a table in the shared folder.

    With a folder of end marks, a second run from the same state emits what was open.
    """
    root = scratch_dir(spark, label)

    def run() -> None:
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{root}/rows")
            .option("checkpointLocation", f"{root}/state")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run()
    if marks is not None:
        mark_end(spark, marks)
        run()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def _tail_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    lines = tail_stream(spark, _as_text_files(spark, sf_dir, "logback"))
    return _streamed(spark, tail_filter(lines, "WARN", "order", ["Exception"]), "tail")


def _timeline_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    folder = scratch_dir(spark, "marks")
    stream = timeline_stream(stream_events(spark, sf_dir), "6h", marks=end_marks(spark, folder))
    return _streamed(spark, stream, "timeline", folder)


def _flow_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    folder = scratch_dir(spark, "marks")
    stream = flow_sessions_stream(stream_events(spark, sf_dir), SESSION_WINDOW, marks=end_marks(spark, folder))
    return _streamed(spark, stream, "sessions", folder)


def _findings(df: DataFrame) -> DataFrame:
    return anomalies.findings(
        df, spike_bucket=SPIKE_BUCKET, recurring_factor=RECURRING_FACTOR, gap_factor=GAP_FACTOR
    )


def _report(df: DataFrame) -> DataFrame:
    return executive_report(
        df, spike_bucket=SPIKE_BUCKET, recurring_factor=RECURRING_FACTOR, gap_factor=GAP_FACTOR
    )


def _write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    out = write_report(_report(events_as_logs(spark, sf_dir)), scratch_dir(spark, "report"))
    return rewrite.read_ordered(spark, out)


def registered_queries() -> dict[str, Query]:
    return {
        # aggregates
        "summary": _on_logs(stats.summary),
        "level_distribution": _on_logs(stats.level_distribution),
        "timeline": _on_logs(stats.timeline, "6h"),
        "timeline_errors": _on_logs(stats.timeline, "45m", "ERROR+"),
        "heatmap": _on_logs(stats.heatmap),
        "heatmap_peak": _on_logs(stats.heatmap_peak),
        "top_errors": _on_logs(stats.top_errors),
        "by_logger": _on_logs(stats.count_by_logger),
        "by_logger_level": _on_logs(stats.count_by_logger, "ERROR+"),
        "by_thread": _on_logs(stats.count_by_thread),
        # filters
        "filter_level": _filtered(level="warn, severe"),
        "filter_min_level": _filtered(min_level="ERROR"),
        "filter_today": _filtered(today=True),
        "filter_yesterday": _filtered(yesterday=True),
        "filter_range": _filtered(since="2024-01-10", until="2024-01-12 18:30"),
        "filter_range_stored": _filter_range_stored,
        "filter_last": _filtered(last="36h"),
        "filter_text": _filtered(text="ILLEGALSTATE"),
        "filter_regex": _filtered(regex=r"order #?\d*7\b"),
        "filter_logger": _filtered(logger="PAYMENT"),
        "filter_thread": _filtered(thread="EXEC-1"),
        "filter_exclude": _filtered(exclude="nullpointer", min_level="ERROR"),
        "filter_combined": _filtered(min_level="WARN", since="2024-01-05", text="timeout", thread="exec-2"),
        "filter_level_expression": _on_logs(
            lambda df: filters.filter_level_expression(df, "ERROR+").select("line_number", "level")
        ),
        "filter_report": _on_logs(filters.filter_report, min_level="ERROR", text="order", now=NOW),
        "page": _on_logs(filters.page, limit=50, offset=100),
        # templates and detectors
        "patterns": _on_logs(anomalies.patterns),
        "first_errors": _on_logs(anomalies.first_errors),
        "spikes": _on_logs(anomalies.error_spikes, SPIKE_BUCKET),
        "unique_errors": _on_logs(anomalies.unique_errors, None),
        "recurring": _on_logs(anomalies.recurring_patterns, RECURRING_FACTOR, None),
        "gaps": _on_logs(anomalies.log_gaps, GAP_FACTOR, None),
        "findings": _on_logs(_findings),
        "findings_default": _on_logs(anomalies.findings),
        "correlate": _on_logs(context.correlate, "ALREADY committed", "180m"),
        # flows
        "flow_sessions": _on_logs(flows.flow_sessions, SESSION_WINDOW),
        "flow_clusters": _on_logs(_flow_clusters),
        "probable_call": _on_logs(flows.probable_call, CALL_LINE, CALL_WINDOW),
        "probable_call_summary": _on_logs(flows.probable_call_summary, CALL_LINE, CALL_WINDOW),
        # stacks and selections
        "stack_list": _on_logs(stacks.list_stacks),
        "stack_groups": _on_logs(stacks.group_stacks),
        "stack_at": _on_logs(stacks.stack_at, 42),
        "digest": _on_logs(context.digest),
        "error_context": _on_logs(context.error_context, "IllegalState"),
        "error_context_text": _on_logs(context.error_context, "timeout after 7"),
        "root_cause": _on_logs(context.root_cause_entries),
        # text sources
        "parse_logback": _parsed("logback"),
        "parse_log4j": _parsed("log4j"),
        "parse_json": _parsed("json"),
        "parse_nginx": _parsed("nginx"),
        "parse_apache": _parsed("apache"),
        "parse_apache_error": _parsed("apache-error"),
        "parse_custom": _parsed("custom", "custom", CUSTOM_TEMPLATE),
        "parse_mixed": _parse_mixed,
        "parse_headers_only": _headers_only,
        "read_folder_names": _read_folder_names,
        "read_glob_deep": _read_glob_deep,
        "detect_format": _detect_format,
        "detect_long_lines": _detect_long_lines,
        "load_report": _load_report,
        # sinks
        "split_day": _split(rewrite.split_by_day, "day"),
        "split_level": _split(rewrite.split_by_level, "level"),
        "split_size": _split_size(True),
        "split_size_even": _split_size(False),
        "merge_files": _merge("file", "logback", "nginx"),
        "merge_sorted": _merge("line", "logback", "nginx"),
        "merge_by_time": _merge("timestamp", "logback", "nginx"),
        "merge_repeated": _merge("file", "nginx", "logback", "nginx"),
        "merge_folder": _merge_folder,
        "export_rows_json": _export("json"),
        "export_rows_csv": _export("csv"),
        "export_rows_html": _export("html"),
        "export_rows_markdown": _export("markdown"),
        "export_stacks": _export_stacks,
        "executive_report": _on_logs(_report),
        "write_report": _write_report,
        # streams
        "tail_filter": _tail_filter,
        "timeline_stream": _timeline_stream,
        "flow_sessions_stream": _flow_sessions_stream,
    }
