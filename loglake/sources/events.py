"""The ``events`` table as log entries, and entries rendered as the text of a format.

This is the bridge from the given tables to log data: the queries of the catalog read
``events`` as a log, or render it to log files and parse those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglake.functions.expressions import has_stack_trace
from loglake.model import LOG_COLUMNS, severity_of
from loglake.sources.formats import MULTI_LINE

# Which class logs which kind of event.
EVENT_LOGGERS = {
    "click": "com.example.web.ClickController",
    "view": "com.example.web.ViewController",
    "signup": "com.example.service.SignupService",
    "purchase": "com.example.service.PaymentService",
    "error": "com.example.repository.OrderRepository",
}
CUSTOM_TEMPLATE = "{data} [{thread}] {nivel} {classe} - {mensagem}"


def events_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a log."""
    return as_logs(spark.read.parquet(f"{sf_dir}/events.parquet"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a stream of log entries."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return as_logs(reader.parquet(sf_dir))


_LEVEL = """
    CASE WHEN e AND user_id % 10 = 0 THEN 'FATAL' WHEN e THEN 'ERROR'
         WHEN event_type = 'purchase' THEN 'WARN' WHEN event_type = 'signup' THEN 'DEBUG'
         WHEN event_type = 'view' AND k % 10 = 0 THEN 'TRACE' ELSE 'INFO' END"""
_LOGGER = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in EVENT_LOGGERS.items()) + " END"
_MESSAGE = """
    CASE WHEN e AND value > 150 THEN
           concat('Unclassified failure ', translate(md5(cast(event_id AS string)), '0123456789', 'ghijklmnop'))
         WHEN e AND k % 4 = 0 THEN concat('NullPointerException: order ', event_id, ' is null')
         WHEN e AND k % 4 = 1 THEN concat('Connection timeout after ', k, ' ms')
         WHEN e AND k % 4 = 2 THEN concat('IllegalStateException: tx ', event_id, ' already committed')
         WHEN e THEN concat('Failed to process payment for order #', event_id)
         WHEN event_type = 'purchase' THEN concat('Payment gateway slow (', k, 'ms)')
         ELSE concat(event_type, ' by user_', user_id, ' k=', k) END"""
_STACK = r"""
    CASE WHEN e AND value <= 150 AND k % 4 = 0 THEN
           concat('java.lang.NullPointerException: null\n\tat com.example.OrderService.load(OrderService.java:',
                  k % 20, ')\n\tat com.example.Web.call(Web.java:7)')
         WHEN e AND value <= 150 AND k % 4 = 2 THEN
           concat('java.lang.IllegalStateException: tx\n\tat com.example.Tx.commit(Tx.java:', k % 10, ')') END"""


def as_logs(events: DataFrame) -> DataFrame:
    """One log entry per event; the fields follow from the event's own columns."""
    entries = events.selectExpr(
        "*", "cast(get_json_object(props, '$.k') AS int) AS k", "event_type = 'error' AS e"
    ).selectExpr(
        "'events' AS source_file",
        "event_id + 1 AS line_number",
        "ts",
        f"{_LEVEL} AS level",
        f"{_LOGGER} AS logger",
        "concat('exec-', user_id % 16) AS thread",
        f"{_MESSAGE} AS message",
        f"{_STACK} AS stack_trace",
    )
    return entries.select(
        "*", severity_of(F.col("level")).alias("severity"), F.expr(_LOGBACK).alias("raw")
    ).select(*LOG_COLUMNS)


_LOGBACK = (
    "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), ' [', thread, '] ', level, ' ', logger, ' - ', message)"
)
_LOG4J = (
    "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS'), ' ', level, ' [', thread, '] ', logger, ' - ', message)"
)
_JSON = """to_json(named_struct(
    '@timestamp', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'level', level, 'logger', logger,
    'thread', thread, 'message', message, 'stack_trace', stack_trace))"""
_WEB = """concat(thread, ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' -0300] "GET /orders/', line_number,
    ' HTTP/1.1" ', CASE WHEN severity >= 4 THEN 500 WHEN severity = 3 THEN 404 ELSE 200 END, ' ', length(message))"""
_APACHE_ERROR = """concat('[', date_format(ts, 'EEE MMM dd HH:mm:ss.SSSSSS yyyy'), '] [', lower(level), '] [pid ',
    line_number, '] ', message)"""
_RENDERINGS = {
    "logback": _LOGBACK,
    "custom": _LOGBACK,
    "log4j": _LOG4J,
    "json": _JSON,
    "nginx": f"""concat({_WEB}, ' "-" "agent/', level, '"')""",
    "apache": _WEB,
    "apache-error": _APACHE_ERROR,
}


def render_lines(entries: DataFrame, format: str) -> DataFrame:
    """Entries as text ``(source_file, line_number, value)``; a stack follows its header.

    ``apache-error`` renders the error-log shape of the apache format.
    """
    if format not in _RENDERINGS:
        raise ValueError(f"cannot render {format!r}")
    value = F.expr(_RENDERINGS[format])
    if format in MULTI_LINE:
        stack = F.col("stack_trace")
        value = F.when(has_stack_trace(stack), F.concat(value, F.lit("\n"), stack)).otherwise(value)
    return entries.select("source_file", "line_number", value.alias("value"))


def ordered_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a log, partitions and their rows in load order.

    The events are dealt out before any field is derived from them, so sampling their range reads the table and no more.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return as_logs(events.repartitionByRange("event_id").sortWithinPartitions("event_id"))


def write_text_logs(ordered: DataFrame, paths: dict[str, str]) -> None:
    """The entries of :func:`ordered_logs` as ``.txt`` files in load order, a folder for each format.

    They are rendered where they lie, so no text is shuffled or made for a sample. An entry never spans two files.
    """
    for kind, path in paths.items():
        render_lines(ordered, kind).select("value").write.text(path)


def write_text_log(rendered: DataFrame, path: str) -> str:
    """Rendered entries as ``.txt`` files in load order; an entry never spans two files."""
    (
        rendered.repartitionByRange("source_file", "line_number")
        .sortWithinPartitions("source_file", "line_number")
        .select("value")
        .write.text(path)
    )
    return path
