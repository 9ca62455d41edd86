"""Stack traces: list, group, pick one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loglake.functions.expressions import has_stack_trace, stack_signature
from loglake.model import LOAD_ORDER
from loglake.operators.filters import stack_lines

LIST_LIMIT = 20
LIST_LINES = 5
GROUP_LINES = 3


def with_stack(df: DataFrame) -> DataFrame:
    return df.where(has_stack_trace(F.col("stack_trace")))


def list_stacks(df: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """First stack traces in load order, numbered, with their first lines."""
    rows = with_stack(df).orderBy(*LOAD_ORDER).limit(limit)
    lines = stack_lines(F.col("stack_trace"))
    return rows.select(
        F.row_number().over(Window.orderBy(*LOAD_ORDER)).cast("bigint").alias("idx"),
        *LOAD_ORDER,
        "ts",
        "message",
        F.array_join(F.slice(lines, 1, LIST_LINES), "\n").alias("stack_head"),
        F.greatest(F.size(lines) - LIST_LINES, F.lit(0)).cast("bigint").alias("stack_lines_left"),
    )


def group_stacks(df: DataFrame) -> DataFrame:
    """Stack traces with the same exception and first frame: count, period, first entry."""
    sample = F.min(F.struct(*LOAD_ORDER, "message", "stack_trace")).alias("sample")
    groups = (
        with_stack(df)
        .groupBy(stack_signature(F.col("message"), F.col("stack_trace")).alias("signature"))
        .agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), sample)
    )
    lines = stack_lines(F.col("sample.stack_trace"))
    return groups.select(
        "signature",
        "n",
        "first_ts",
        "last_ts",
        F.col("sample.message").alias("sample_message"),
        F.array_join(F.slice(lines, 1, GROUP_LINES), "\n").alias("sample_head"),
    ).orderBy(F.desc("n"), "signature")


def stack_at(df: DataFrame, index: int) -> DataFrame:
    """The stack trace number ``index`` in load order, from 1; no row beyond the last."""
    if index < 1:
        raise ValueError(f"stack traces are numbered from 1: {index}")
    row = with_stack(df).orderBy(*LOAD_ORDER).offset(index - 1).limit(1)
    return row.select(*LOAD_ORDER, "ts", "message", "stack_trace")
