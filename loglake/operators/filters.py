"""Row filters, the filter report and the page view. All predicates are ANDed."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loglake.functions.arguments import datetime_argument, level_expression, time_ago
from loglake.functions.expressions import contains_text, has_stack_trace, mentions, short_logger
from loglake.model import LOAD_ORDER, SEVERITY, level_name

PAGE_STACK_LINES = 3


def _passes(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def _time(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _day(now: datetime) -> tuple[Column, Column]:
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return _time(midnight), _time(midnight + timedelta(days=1))


def log_predicate(
    level: str | list[str] | None = None,
    min_level: str | None = None,
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    last: str | int | None = None,
    text: str | None = None,
    regex: str | None = None,
    logger: str | None = None,
    thread: str | None = None,
    exclude: str | None = None,
    today: bool = False,
    yesterday: bool = False,
    now: datetime | None = None,
) -> Column:
    """The conjunction of the given conditions; nulls never pass, except for ``exclude``.

    ``level`` is a list or comma-separated names, ``last`` a span before ``now`` such as
    ``30m``. Level and time conditions are plain comparisons with literals, so a columnar
    source can skip row groups by them.
    """
    now = now or datetime.now(UTC).replace(tzinfo=None)
    conditions: list[Column] = []
    if level:
        names = level.split(",") if isinstance(level, str) else level
        conditions.append(F.col("level").isin([level_name(n) for n in names]))
    if min_level:
        conditions.append(F.col("severity") >= SEVERITY[level_name(min_level)])
    for wanted, day in ((today, now), (yesterday, now - timedelta(days=1))):
        if wanted:
            start, end = _day(day)
            conditions.append((F.col("ts") >= start) & (F.col("ts") < end))
    if since:
        conditions.append(F.col("ts") >= _time(datetime_argument(since)))
    if until:
        conditions.append(F.col("ts") <= _time(datetime_argument(until)))
    if last is not None and str(last).strip():
        conditions.append(F.col("ts") >= _time(time_ago(last, now)))
    if text:
        conditions.append(mentions(text))
    if regex:
        pattern = f"(?i){regex}"
        conditions.append(
            _passes(F.col("message").rlike(pattern)) | _passes(F.col("stack_trace").rlike(pattern))
        )
    if logger:
        conditions.append(contains_text(F.col("logger"), logger))
    if thread:
        conditions.append(contains_text(F.col("thread"), thread))
    if exclude:
        conditions.append(~mentions(exclude))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filter_logs(df: DataFrame, **conditions) -> DataFrame:
    """Entries that pass :func:`log_predicate`."""
    return df.where(log_predicate(**conditions))


def filter_level_expression(df: DataFrame, expression: str | None) -> DataFrame:
    """Entries of ``ERROR`` exactly, of ``ERROR+`` and above, or all for a blank expression."""
    levels = level_expression(expression)
    if levels is None:
        return df
    if len(levels) == 1:
        return df.where(F.col("severity") == SEVERITY[levels[0]])
    return df.where(F.col("severity") >= SEVERITY[levels[0]])


def filter_report(df: DataFrame, **conditions) -> DataFrame:
    """How many entries a filter keeps, of how many, in whole percent; one pass."""
    counted = df.agg(
        F.count_if(_passes(log_predicate(**conditions))).alias("kept"), F.count("*").alias("total")
    )
    share = F.when(F.col("total") > 0, F.expr("kept * 100 div total")).otherwise(F.lit(0))
    return counted.select("kept", "total", share.cast("bigint").alias("pct"))


def stack_lines(stack: Column) -> Column:
    """Lines of a stack trace; trailing empty ones do not count."""
    return F.split(F.regexp_replace(stack, r"\n+\z", ""), "\n", -1)


def first_rows(ordered: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of an ordered relation; ``None`` means all."""
    return ordered if limit is None else ordered.limit(limit)


def page(df: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Entries ``offset+1 .. offset+limit`` in load order, with the head of their stack."""
    rows = df.orderBy(*LOAD_ORDER).offset(offset).limit(limit)
    lines = F.when(has_stack_trace(F.col("stack_trace")), stack_lines(F.col("stack_trace")))
    return rows.select(
        *LOAD_ORDER,
        "ts",
        "level",
        short_logger(F.col("logger")).alias("logger"),
        "message",
        F.array_join(F.slice(lines, 1, PAGE_STACK_LINES), "\n").alias("stack_head"),
        F.greatest(F.coalesce(F.size(lines), F.lit(0)) - PAGE_STACK_LINES, F.lit(0))
        .cast("bigint")
        .alias("stack_lines_left"),
    )
