"""Column expressions over log entries. All stay inside the JVM: no Python per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The masks of message templates, applied in this order.
TEMPLATE_MASKS = [
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<TIMESTAMP>"),
    (r"\d+", "<N>"),
]

# Words that give a raw line its level; the first level found wins.
LINE_LEVEL_WORDS = [
    ("FATAL", ["FATAL"]),
    ("ERROR", ["ERROR", "SEVERE"]),
    ("WARN", ["WARN"]),
    ("INFO", ["INFO"]),
    ("DEBUG", ["DEBUG"]),
    ("TRACE", ["TRACE"]),
]

# Length of a bare-message signature and the text joining its two halves.
SIGNATURE_LENGTH = 80
SIGNATURE_JOIN = " em "

# Everything up to and including the space counts as blank at either end of a text.
_BLANKS = "".join(map(chr, range(0x21)))
_FIRST_FRAME = r"(?md)^[\x00-\x09\x0B-\x20]*(at [^\n]*[^\x00-\x20])"
_FRAME_LOCATION = r"^[^()]+\(([^)]*)\)"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less time (the session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def has_stack_trace(stack: Column) -> Column:
    return F.coalesce(stack.rlike(r"\S"), F.lit(False))


def full_message(message: Column, stack: Column) -> Column:
    return F.when(has_stack_trace(stack), F.concat(message, F.lit("\n"), stack)).otherwise(message)


def contains_text(column: Column, needle: str) -> Column:
    """Case-insensitive substring test; null in, null out."""
    return F.lower(column).contains(needle.lower())


def mentions(needle: str) -> Column:
    """The message or the stack trace holds the text, in any case."""
    return F.coalesce(contains_text(F.col("message"), needle), F.lit(False)) | F.coalesce(
        contains_text(F.col("stack_trace"), needle), F.lit(False)
    )


def normalize_message(message: Column) -> Column:
    """The message template: ids, times and numbers masked; a missing message is ``''``."""
    masked = message
    for pattern, mask in TEMPLATE_MASKS:
        masked = F.regexp_replace(masked, pattern, mask)
    return F.coalesce(trimmed(masked), F.lit(""))


def first_frame(stack: Column) -> Column:
    """First ``at ...`` line of a stack trace, trimmed; ``''`` when there is none."""
    return F.coalesce(F.regexp_extract(stack, _FIRST_FRAME, 1), F.lit(""))


def error_signature(message: Column, stack: Column) -> Column:
    """What groups one error with another: exception and code location, else the message start."""
    text = F.coalesce(message, F.lit(""))
    exception = F.when(F.instr(text, ":") > 1, F.substring_index(text, ":", 1)).otherwise(text)
    frame = first_frame(stack)
    with_frame = F.when(
        frame.rlike(_FRAME_LOCATION),
        F.concat(exception, F.lit(SIGNATURE_JOIN), F.regexp_extract(frame, _FRAME_LOCATION, 1)),
    ).otherwise(exception)
    short = F.when(
        F.length(text) > SIGNATURE_LENGTH,
        F.concat(F.substring(text, 1, SIGNATURE_LENGTH), F.lit("...")),
    ).otherwise(text)
    return F.when(has_stack_trace(stack), with_frame).otherwise(short)


def stack_signature(message: Column, stack: Column) -> Column:
    """What groups one stack trace with another: text before the first colon, and the first frame."""
    text = F.coalesce(message, F.lit(""))
    return F.concat(F.substring_index(text, ":", 1), F.lit("|"), first_frame(stack))


def short_logger(logger: Column) -> Column:
    """Last dotted part of a logger name; a name that only starts or ends with a dot stays whole."""
    tail = F.substring_index(logger, ".", -1)
    cut = (F.length(tail) > 0) & (F.length(tail) < F.length(logger) - 1)
    return F.when(~F.coalesce(logger.rlike(r"\S"), F.lit(False)), F.lit("")).otherwise(
        F.when(cut, tail).otherwise(logger)
    )


def truncated(text: Column, length: int) -> Column:
    """At most ``length`` characters, the last three dots when something was cut; null is ``''``."""
    shown = F.coalesce(text, F.lit(""))
    return F.when(
        F.length(shown) > length, F.concat(F.substring(shown, 1, length - 3), F.lit("..."))
    ).otherwise(shown)


def thousands(number: Column) -> Column:
    """``1234567`` as ``1.234.567``."""
    return F.translate(F.format_number(number, 0), ",", ".")


def duration_label(seconds: Column) -> Column:
    """``D dias, H horas`` from one day on, below it ``H horas, M min``; ``0 min`` at least."""
    days = F.floor(seconds / 86400)
    hours = F.floor(seconds / 3600) % 24
    minutes = F.floor(seconds / 60) % 60
    below_day = F.concat_ws(
        ", ",
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" horas"))),
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" min"))),
    )
    return F.when(
        days > 0,
        F.concat(days.cast("string"), F.lit(" dias, "), hours.cast("string"), F.lit(" horas")),
    ).otherwise(F.when(below_day == "", F.lit("0 min")).otherwise(below_day))


def second_label(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def minute_label(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm``."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def escape_csv(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\n]'), quoted).otherwise(F.coalesce(value, F.lit("")))


def escape_html(value: Column) -> Column:
    shown = F.coalesce(value, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        shown = F.replace(shown, F.lit(char), F.lit(entity))
    return shown


def escape_markdown(value: Column) -> Column:
    shown = F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.replace(shown, F.lit("\n"), F.lit("<br>"))


def level_in_line(line: Column) -> Column:
    """Level a raw line names anywhere, or null."""
    upper = F.upper(line)
    chain = None
    for level, words in LINE_LEVEL_WORDS:
        found = upper.contains(words[0])
        for word in words[1:]:
            found = found | upper.contains(word)
        chain = (chain.when if chain is not None else F.when)(found, level)
    return chain


def highlight(line: Column, terms: Sequence[str], before: str = "«", after: str = "»") -> Column:
    """The line with every occurrence of each term put between two markers."""
    marked = line
    for term in terms:
        if term.strip():
            word = term.strip()
            marked = F.replace(marked, F.lit(word), F.lit(f"{before}{word}{after}"))
    return marked


def entry_text(with_stack: bool = True) -> Column:
    """One entry as text: ``ts level logger - message`` and its stack trace below."""
    head = F.concat(
        F.coalesce(F.concat(second_label(F.col("ts")), F.lit(" ")), F.lit("")),
        F.col("level"),
        F.lit(" "),
        F.coalesce(F.concat(F.col("logger"), F.lit(" - ")), F.lit("")),
        F.coalesce(F.col("message"), F.lit("null")),
    )
    if not with_stack:
        return head
    stack = F.col("stack_trace")
    return F.when(has_stack_trace(stack), F.concat(head, F.lit("\n"), stack)).otherwise(head)
