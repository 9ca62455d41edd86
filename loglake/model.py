"""The one relation every operator works on: a log entry per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Level names in order of severity, and the words read as one of them.
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
LEVEL_ALIASES = {"WARNING": "WARN", "SEVERE": "ERROR", "CRITICAL": "FATAL"}
DEFAULT_LEVEL = "INFO"

SEVERITY = {name: rank for rank, name in enumerate(LEVELS)}
WARN = SEVERITY["WARN"]
ERROR = SEVERITY["ERROR"]

LOG_SCHEMA = T.StructType(
    [
        T.StructField("source_file", T.StringType(), False),
        T.StructField("line_number", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType(), True),
        T.StructField("level", T.StringType(), False),
        T.StructField("severity", T.IntegerType(), False),
        T.StructField("logger", T.StringType(), True),
        T.StructField("thread", T.StringType(), True),
        T.StructField("message", T.StringType(), True),
        T.StructField("stack_trace", T.StringType(), True),
        T.StructField("raw", T.StringType(), False),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# Load order of entries: line numbers restart in every file.
LOAD_ORDER = ["source_file", "line_number"]
TIME_ORDER = ["ts", "source_file", "line_number"]


def level_name(word: str) -> str:
    """Level a user named in an argument; unlike data, an unknown word is an error."""
    upper = word.strip().upper()
    name = LEVEL_ALIASES.get(upper, upper)
    if name not in SEVERITY:
        raise ValueError(f"unknown log level: {word!r}")
    return name


def _lookup(values: dict, key: Column) -> Column:
    """The value of a small fixed table at a key, null for other keys."""
    pairs = ", ".join(f"{k!r}, {v!r}" for k, v in values.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def normalize_level(text: Column) -> Column:
    """Level named by a column of free text; unknown or missing text reads as INFO."""
    words = {**{name: name for name in LEVELS}, **LEVEL_ALIASES}
    word = F.btrim(text)
    # Most words are in capitals already; changing case is the dear part.
    return F.coalesce(_lookup(words, word), _lookup(words, F.upper(word)), F.lit(DEFAULT_LEVEL))


def severity_of(level: Column) -> Column:
    """Rank 0..5 of a normalised level."""
    return F.coalesce(_lookup(SEVERITY, level), F.lit(SEVERITY[DEFAULT_LEVEL]))


def level_of(severity: Column) -> Column:
    """Level name of a rank, the inverse of :func:`severity_of`."""
    return F.element_at(F.expr(f"array({', '.join(map(repr, LEVELS))})"), severity + 1)
