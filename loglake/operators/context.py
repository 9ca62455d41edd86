"""Entries around an event, and the selections a written explanation starts from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from loglake.functions.arguments import duration_millis
from loglake.functions.expressions import entry_text, from_micros, mentions, micros, truncated
from loglake.model import ERROR, LOAD_ORDER, WARN
from loglake.operators.filters import first_rows

CORRELATE_WINDOW = "5m"
CORRELATE_LIMIT = 50
CORRELATE_WIDTH = 80
ERROR_CONTEXT_LIMIT = 5
ROOT_CAUSE_LIMIT = 20
DIGEST_TOP = 5
DIGEST_RECENT = 20


def correlate(
    df: DataFrame, text: str, window: str | int = CORRELATE_WINDOW, limit: int | None = CORRELATE_LIMIT
) -> DataFrame:
    """Entries around the first mention of a text, in load order; no row if there is none.

    One pass finds the first mention and counts all. It is a scalar subquery, so it runs when the result is asked for, and
    the second pass reads only what lies in the window. A bare number means minutes; ``limit=None`` gives all of them.
    """
    mention = df.where(F.col("ts").isNotNull() & mentions(text)).agg(
        F.struct(
            F.count("*").alias("matches"), F.min(F.struct(*LOAD_ORDER, micros(F.col("ts")).alias("t"))).alias("first")
        )
    ).scalar()
    first = mention["first"]
    reach = duration_millis(window, default_unit="m") * 1000
    near = F.col("ts").between(from_micros(first["t"] - reach), from_micros(first["t"] + reach))
    is_event = (F.col("source_file") == first["source_file"]) & (F.col("line_number") == first["line_number"])
    return first_rows(df.where(near).orderBy(*LOAD_ORDER), limit).select(
        *LOAD_ORDER, "ts", "level", truncated(F.col("message"), CORRELATE_WIDTH).alias("message"),
        is_event.alias("is_event"), mention["matches"].alias("matches"),
    )


def error_context(df: DataFrame, text: str, limit: int | None = ERROR_CONTEXT_LIMIT) -> DataFrame:
    """First errors whose message or stack holds the text exactly as written; ``limit=None`` gives all."""
    holds = F.coalesce(F.col("message").contains(text), F.lit(False)) | F.coalesce(
        F.col("stack_trace").contains(text), F.lit(False)
    )
    return _as_text(df.where((F.col("severity") >= ERROR) & holds), limit)


def root_cause_entries(df: DataFrame, limit: int | None = ROOT_CAUSE_LIMIT) -> DataFrame:
    """First errors in load order; ``limit=None`` gives all."""
    return _as_text(df.where(F.col("severity") >= ERROR), limit)


def _as_text(df: DataFrame, limit: int | None) -> DataFrame:
    return first_rows(df.orderBy(*LOAD_ORDER), limit).select(*LOAD_ORDER, entry_text().alias("text"))


def digest(df: DataFrame, top: int = DIGEST_TOP, recent: int = DIGEST_RECENT) -> DataFrame:
    """State of a log as ``(section, ord, text, n)``: totals, top error messages, latest entries."""
    totals = df.agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("severity") >= ERROR).alias("errors"),
        F.count_if(F.col("severity") == WARN).alias("warnings"),
    ).select(
        F.lit("totals").alias("section"),
        F.stack(
            F.lit(3),
            F.lit(1), F.lit("entries"), F.col("entries"),
            F.lit(2), F.lit("errors"), F.col("errors"),
            F.lit(3), F.lit("warnings"), F.col("warnings"),
        ).alias("ord", "text", "n"),
    ).withColumn("ord", F.col("ord").cast("bigint"))
    top_rows = (
        df.where(F.col("severity") >= ERROR)
        .groupBy(F.coalesce("message", F.lit("")).alias("text"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "text")
        .limit(top)
    )
    recent_rows = (
        df.orderBy(*[F.desc(c) for c in LOAD_ORDER])
        .limit(recent)
        .select(*LOAD_ORDER, entry_text().alias("text"), F.lit(None).cast("bigint").alias("n"))
    )
    parts = [
        totals,
        _numbered(top_rows, [F.desc("n"), "text"], "top_errors"),
        _numbered(recent_rows, LOAD_ORDER, "recent"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _numbered(rows: DataFrame, order: list, section: str) -> DataFrame:
    return rows.select(
        F.lit(section).alias("section"),
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("ord"),
        "text",
        "n",
    )
