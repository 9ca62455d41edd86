"""The log formats: how a header line looks and which fields it holds.

A format knows which lines are headers and how to project header lines to fields. Regex
formats are matched once per line for that: the match is rewritten to its groups, one per
line break (a line itself holds none), so no group costs a second pass over the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loglake.functions.expressions import trimmed
from loglake.model import normalize_level

# ---------------------------------------------------------------------------
# Line patterns, field names and template placeholders of the formats.

LOGBACK_LINE = (
    r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d{0,3})\s+"
    r"\[?([^\]]*?)\]?\s+"
    r"(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\s+"
    r"([\w.$]+)\s*[-:]\s*(.*)"
)
LOG4J_LINE = (
    r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[.,]\d{3})\s+"
    r"(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\s+"
    r"\[([^\]]*)\]\s+"
    r"([\w.$]+)\s*[-:]?\s*(.*)"
)
NGINX_LINE = (
    r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]+)"\s+(\d{3})\s+(\d+)\s+"([^"]*)"\s+"([^"]*)"'
)
APACHE_ACCESS_LINE = (
    r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]+)"\s+(\d{3})\s+(\d+|-)\s*"?([^"]*)"?\s*"?([^"]*)"?'
)
APACHE_ERROR_LINE = r"^\[([^\]]+)\]\s+\[(\w+)\]\s+(?:\[pid\s+\d+\]\s+)?(.+)"

JSON_TIME_FIELDS = ["timestamp", "@timestamp", "time", "datetime", "date", "ts"]
JSON_LEVEL_FIELDS = ["level", "severity", "log_level", "loglevel", "lvl"]
JSON_MESSAGE_FIELDS = ["message", "msg", "log", "text"]
JSON_LOGGER_FIELDS = ["logger", "logger_name", "loggerName", "class", "category"]
JSON_THREAD_FIELDS = ["thread", "thread_name", "threadName"]
JSON_STACK_FIELDS = ["stack_trace", "stackTrace", "exception", "error.stack_trace"]

CUSTOM_PLACEHOLDERS = {
    "data": r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d{0,3})",
    "nivel": r"(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)",
    "mensagem": r"(.*)",
    "classe": r"([\w.$]+)",
    "thread": r"([^\]]+)",
    "logger": r"([\w.$]+)",
}

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SERVER_ERROR_STATUS = 500
CLIENT_ERROR_STATUS = 400
# ---------------------------------------------------------------------------

FORMATS = ("logback", "log4j", "json", "nginx", "apache", "custom")
DETECTION_ORDER = ("json", "logback", "log4j", "nginx", "apache")
FALLBACK_FORMAT = "logback"
MULTI_LINE = frozenset({"logback", "log4j"})
DETECTION_LINES = 20

_FIELDS = ["ts", "level", "logger", "thread", "message", "stack_trace"]


def format_name(name: str) -> str:
    cleaned = name.strip().lower()
    cleaned = {"personalizado": "custom"}.get(cleaned, cleaned)
    if cleaned not in FORMATS:
        raise ValueError(f"unknown log format: {name!r}")
    return cleaned


# --- matching ---------------------------------------------------------------


def _rewritten(line: Column, pattern: str, groups: int, tag: str = "") -> Column:
    """A matching line as a line break, the tag, and its groups after a break each; others as is."""
    text = f"\n{tag}" + "".join(f"\n${i}" for i in range(1, groups + 1))
    return F.regexp_replace(line, f"^(?:{pattern})\\z", text)


def _with_groups(df: DataFrame, rewritten: Column, headers_only: bool) -> DataFrame:
    """``_g``: the tag and the groups of each header line; other lines are dropped.

    A generator drops them, because a filter would be pushed below the projection and
    match every line a second time.
    """
    if not headers_only:
        hit = F.filter(F.array(rewritten), lambda text: text.startswith("\n"))
        df, rewritten = df.select("*", F.explode(hit).alias("_hit")), F.col("_hit")
    return df.withColumn("_g", F.split(F.substr(rewritten, F.lit(2)), "\n", -1))


def _group(i: int) -> Column:
    return F.col("_g")[i]


def _matches(line: Column, pattern: str) -> Column:
    return F.coalesce(line.rlike(f"^(?:{pattern})\\z"), F.lit(False))


# --- timestamps: every format lists the shapes it accepts, anything else is null ------

_PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}([.,]\d{3})?\z"
_PLAIN_DOT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{3})?\z"
_ISO = r"(?i)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)?\z"
_ISO_LOCAL = r"(?i)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\z"
_WEB = rf"^\d{{2}}/({'|'.join(MONTHS)})/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}} [+-]\d{{4}}\z"


def _ntz(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _lenient_day(text: Column) -> Column:
    """``yyyy-MM-dd...`` where day 29 to 31 of a shorter month means its last day."""
    month_end = F.last_day(F.concat(F.substring(text, 1, 7), F.lit("-01")).try_cast("date"))
    clamped = F.concat(month_end.cast("string"), F.substr(text, F.lit(11)))
    return F.coalesce(
        _ntz(text), F.when(F.substring(text, 9, 2).between("29", "31"), _ntz(clamped))
    )


def _pattern_time(text: Column) -> Column:
    return _lenient_day(F.translate(text, ",T", ". "))


def logback_time(text: Column) -> Column:
    """The line pattern vouches for the digits; left to check are the fraction and its mark."""
    mark = F.substring(text, 20, 1)
    millis = (F.length(text) == 23) & ((mark == ".") | ((mark == ",") & (F.substring(text, 11, 1) == " ")))
    return F.when((F.length(text) == 19) | millis, _pattern_time(text))


def log4j_time(text: Column) -> Column:
    """The line pattern vouches for all but the blanks between date and time."""
    plain = (F.length(text) == 23) & (F.substring(text, 11, 1) == " ")
    return F.when(plain, _pattern_time(text))


def json_time(text: Column) -> Column:
    local = F.regexp_replace(text, r"(?i)(Z|[+-]\d{2}:\d{2}(:\d{2})?)\z", "")
    return F.when(text.rlike(_ISO), _ntz(F.upper(local))).when(
        text.rlike(_PLAIN), _pattern_time(text)
    )


def custom_time(text: Column) -> Column:
    return F.when(text.rlike(_PLAIN_DOT), _pattern_time(text)).when(
        text.rlike(_ISO_LOCAL), _ntz(F.upper(text))
    )


def web_time(text: Column) -> Column:
    """``10/Oct/2000:13:55:36 -0700`` as its wall-clock time; the offset is dropped."""
    month = F.floor((F.instr(F.lit("".join(MONTHS)), F.substring(text, 4, 3)) + 2) / 3)
    iso = F.concat(
        F.substring(text, 8, 4),
        F.lit("-"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lit("-"),
        F.substring(text, 1, 2),
        F.lit(" "),
        F.substring(text, 13, 8),
    )
    return F.when(text.rlike(_WEB), _lenient_day(iso))


# --- formats ------------------------------------------------------------------


@dataclass(frozen=True)
class LineFormat:
    """``matches(line)`` tells header lines; ``fields(df, headers_only)`` projects them.

    ``df`` holds a line in ``raw``; its other columns are kept. Lines that are no header
    are dropped, which costs nothing when the caller knows that all are.
    """

    name: str
    matches: Callable[[Column], Column]
    fields: Callable[[DataFrame, bool], DataFrame]

    @property
    def multi_line(self) -> bool:
        return self.name in MULTI_LINE

    def entries(self, line: Column) -> Column:
        """How many entries a line begins: 1 or 0."""
        return F.size(_json_objects(line)) if self.name == "json" else F.coalesce(self.matches(line), F.lit(False)).cast("int")


def _with_fields(df: DataFrame, **columns: Column | None) -> DataFrame:
    kept = [c for c in df.columns if not c.startswith("_")]
    texts = [
        (columns[f] if columns.get(f) is not None else F.lit(None).cast("string")).alias(f)
        for f in _FIELDS[1:]
    ]
    ts = columns.get("ts")
    ts = (ts if ts is not None else F.lit(None)).cast("timestamp_ntz").alias("ts")
    return df.select(*kept, ts, *texts)


def _pattern_format(name, pattern, n, ts, level, thread, logger, message, read_time) -> LineFormat:
    def fields(df: DataFrame, headers_only: bool = False) -> DataFrame:
        return _with_fields(
            _with_groups(df, _rewritten(F.col("raw"), pattern, n), headers_only),
            ts=read_time(_group(ts)),
            level=normalize_level(_group(level)),
            logger=trimmed(_group(logger)),
            thread=trimmed(_group(thread)),
            message=trimmed(_group(message)),
        )

    return LineFormat(name, lambda line: _matches(line, pattern), fields)


def _status_level(status: Column) -> Column:
    return (
        F.when(status >= SERVER_ERROR_STATUS, "ERROR")
        .when(status >= CLIENT_ERROR_STATUS, "WARN")
        .otherwise("INFO")
    )


def _nginx_fields(df: DataFrame, headers_only: bool = False) -> DataFrame:
    status = _group(5).cast("int")
    message = F.concat(
        _group(4), F.lit(" ["), status.cast("string"), F.lit("] "), _group(6), F.lit(" bytes - "), _group(8)
    )
    return _with_fields(
        _with_groups(df, _rewritten(F.col("raw"), NGINX_LINE, 8), headers_only),
        ts=web_time(_group(3)),
        level=_status_level(status),
        logger=F.lit("nginx"),
        thread=_group(1),
        message=message,
    )


def _apache_fields(df: DataFrame, headers_only: bool = False) -> DataFrame:
    # A rewritten access line starts with a break, so the error pattern leaves it alone.
    access_first = _rewritten(F.col("raw"), APACHE_ACCESS_LINE, 8, tag="access")
    either = _rewritten(access_first, APACHE_ERROR_LINE, 3, tag="error")
    access = _group(0) == "access"
    status = F.when(access, _group(5)).try_cast("int")
    request = F.concat(_group(4), F.lit(" ["), status.cast("string"), F.lit("] "), F.get("_g", F.lit(6)))
    return _with_fields(
        _with_groups(df, either, headers_only),
        ts=F.when(access, web_time(_group(3))),
        level=F.when(access, _status_level(status)).otherwise(normalize_level(_group(2))),
        logger=F.when(access, F.lit("apache")).otherwise(F.lit("apache-error")),
        thread=F.when(access, _group(1)),
        message=F.when(access, request).otherwise(_group(3)),
    )


_JSON_NAMES = list(
    dict.fromkeys(
        name.split(".")[0]
        for names in (
            JSON_TIME_FIELDS, JSON_LEVEL_FIELDS, JSON_MESSAGE_FIELDS,
            JSON_LOGGER_FIELDS, JSON_THREAD_FIELDS, JSON_STACK_FIELDS,
        )
        for name in names
    )
)
_JSON_SCHEMA = ", ".join(f"`{name}` STRING" for name in [*_JSON_NAMES, "_bad"])
_MARKERS = [*JSON_TIME_FIELDS, *JSON_LEVEL_FIELDS, *JSON_MESSAGE_FIELDS]


def _json_objects(line: Column) -> Column:
    """The line's known fields as text, read in one parse; empty when it is no JSON object."""
    parsed = F.from_json(line, _JSON_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    return F.filter(F.array(parsed), lambda fields: fields.isNotNull() & fields["_bad"].isNull())


def _json_text(path: str) -> str:
    """SQL for the text of one field; an object or array has none and reads as ``''``.

    Parsed fields show a container as its JSON text, which a string may look like too. Only
    for text that starts like one is the line parsed again to tell the two apart.
    """
    name, _, inner = path.partition(".")
    value, pointer = f"_j.`{name}`", f"$[''{name}'']".replace("''", '"')
    if inner:
        value, pointer = f"get_json_object({value}, '$.{inner}')", f"{pointer}.{inner}"
    kind = f"schema_of_variant(try_variant_get(try_parse_json(raw), '{pointer}', 'variant'))"
    return (
        f"CASE WHEN {value} RLIKE '^\\\\s*[{{\\\\[]' THEN CASE WHEN {kind} RLIKE '^(OBJECT|ARRAY)' THEN '' ELSE {value} END"
        f" ELSE {value} END"
    )


def _first_json_text(names: list[str], alias: str) -> str:
    return f"coalesce({', '.join(map(_json_text, names))}) AS {alias}"


def _json_fields(df: DataFrame, headers_only: bool = False) -> DataFrame:
    found = df.select("*", F.explode(_json_objects(F.col("raw"))).alias("_j"))
    texts = found.selectExpr(
        *[c for c in df.columns if not c.startswith("_")],
        _first_json_text(JSON_TIME_FIELDS, "_ts"),
        _first_json_text(JSON_LEVEL_FIELDS, "_level"),
        _first_json_text(JSON_LOGGER_FIELDS, "_logger"),
        _first_json_text(JSON_THREAD_FIELDS, "_thread"),
        _first_json_text(JSON_MESSAGE_FIELDS, "_message"),
        _first_json_text(JSON_STACK_FIELDS, "_stack"),
    )
    return _with_fields(
        texts, ts=json_time(F.col("_ts")), level=normalize_level(F.col("_level")),
        logger=F.col("_logger"), thread=F.col("_thread"), message=F.col("_message"),
        stack_trace=F.col("_stack"),
    )


def _json_matches(line: Column) -> Column:
    keys = F.json_object_keys(line)
    known = F.arrays_overlap(keys, F.array(*[F.lit(name) for name in _MARKERS]))
    return F.coalesce(trimmed(line).startswith("{") & known, F.lit(False))


def custom_format(template: str | None) -> LineFormat:
    """Format of a template such as ``[{data}] {nivel} {classe} - {mensagem}``.

    Text between the placeholders is literal. Without a template no line is an entry.
    """
    if not template:
        return LineFormat("custom", lambda line: F.lit(False), lambda df, headers_only=False: _with_fields(df.where("false")))
    names, pattern, at = [], "", 0
    for found in re.finditer(r"\{(\w+)\}", template):
        if found[1] not in CUSTOM_PLACEHOLDERS:
            continue
        if found[1] in names:
            raise ValueError(f"placeholder used twice: {found[0]}")
        names.append(found[1])
        pattern += re.escape(template[at : found.start()]) + CUSTOM_PLACEHOLDERS[found[1]]
        at = found.end()
    pattern += re.escape(template[at:])

    def fields(df: DataFrame, headers_only: bool = False) -> DataFrame:
        g = {name: _group(i) for i, name in enumerate(names, start=1)}
        return _with_fields(
            _with_groups(df, _rewritten(F.col("raw"), pattern, len(names)), headers_only),
            ts=custom_time(g["data"]) if "data" in g else None,
            level=normalize_level(g["nivel"]) if "nivel" in g else F.lit("INFO"),
            logger=g.get("logger", g.get("classe")),
            thread=g.get("thread"),
            message=g.get("mensagem"),
        )

    return LineFormat("custom", lambda line: _matches(line, pattern), fields)


_NAMED = {
    "logback": _pattern_format(
        "logback", LOGBACK_LINE, 5, ts=1, thread=2, level=3, logger=4, message=5, read_time=logback_time
    ),
    "log4j": _pattern_format(
        "log4j", LOG4J_LINE, 5, ts=1, level=2, thread=3, logger=4, message=5, read_time=log4j_time
    ),
    "json": LineFormat("json", _json_matches, _json_fields),
    "nginx": LineFormat("nginx", lambda line: _matches(line, NGINX_LINE), _nginx_fields),
    "apache": LineFormat(
        "apache",
        lambda line: _matches(line, APACHE_ACCESS_LINE) | _matches(line, APACHE_ERROR_LINE),
        _apache_fields,
    ),
}


def line_format(name: str, template: str | None = None) -> LineFormat:
    name = format_name(name)
    return custom_format(template) if name == "custom" else _NAMED[name]


def detected_format(line: Column) -> Column:
    """Name of the first format that takes the line for a header, or null."""
    chain = None
    for name in DETECTION_ORDER:
        found = _NAMED[name].matches(line)
        chain = (chain.when if chain is not None else F.when)(found, name)
    return F.when(F.coalesce(line.rlike(r"\S"), F.lit(False)), chain)
