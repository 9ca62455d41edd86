"""Exports of entries and of stack traces. Each writes a folder of files in log order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loglake.functions.expressions import (
    escape_csv,
    escape_html,
    has_stack_trace,
    second_label,
)
from loglake.model import LOAD_ORDER

# Column names of the exports.
CSV_COLUMNS = ["linha", "timestamp", "nivel", "logger", "thread", "mensagem"]
TABLE_COLUMNS = ["#", "Timestamp", "Nivel", "Logger", "Mensagem"]


def _time_text() -> Column:
    return F.coalesce(second_label(F.col("ts")), F.lit(""))


def _in_load_order(df: DataFrame) -> DataFrame:
    return df.repartitionByRange(*LOAD_ORDER).sortWithinPartitions(*LOAD_ORDER)


def json_rows(df: DataFrame) -> DataFrame:
    """Entries under their export names; absent fields are null and left out when written."""
    return df.select(
        F.col("line_number").alias("line"),
        _iso_time(F.col("ts")).alias("timestamp"),
        "level",
        "logger",
        "thread",
        "message",
        F.when(has_stack_trace(F.col("stack_trace")), F.col("stack_trace")).alias("stackTrace"),
    )


def _iso_time(ts: Column) -> Column:
    """ISO local time; the fraction shows 3 or 6 digits or none, seconds only when not zero."""
    fraction = F.date_format(ts, "SSSSSS")
    whole_minute = (fraction == "000000") & (F.second(ts) == 0)
    return (
        F.when(whole_minute, F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
        .when(fraction == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(fraction.endswith("000"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    )


def csv_rows(df: DataFrame) -> DataFrame:
    """Entries as one CSV line each, without stack traces."""
    fields = [
        F.col("line_number").cast("string"),
        _time_text(),
        F.col("level"),
        *[escape_csv(F.col(c)) for c in ("logger", "thread", "message")],
    ]
    return df.select(*LOAD_ORDER, F.concat_ws(",", *fields).alias("value"))


def html_rows(df: DataFrame) -> DataFrame:
    """Entries as table rows classed by level; a stack trace is a block in the message cell."""
    cell = lambda content: F.concat(F.lit("<td>"), content, F.lit("</td>"))
    stack = F.when(
        has_stack_trace(F.col("stack_trace")),
        F.concat(F.lit('<div class="stack">'), escape_html(F.col("stack_trace")), F.lit("</div>")),
    ).otherwise(F.lit(""))
    row = F.concat(
        F.lit('<tr class="'), F.col("level"), F.lit('">'),
        cell(F.col("line_number").cast("string")),
        cell(_time_text()),
        cell(F.col("level")),
        cell(escape_html(F.col("logger"))),
        cell(F.concat(escape_html(F.col("message")), stack)),
        F.lit("</tr>"),
    )
    return df.select(*LOAD_ORDER, row.alias("value"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """Entries as rows of a Markdown table."""
    row = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            F.col("line_number").cast("string"),
            _time_text(),
            F.col("level"),
            F.coalesce("logger", F.lit("")),
            F.replace(F.coalesce("message", F.lit("")), F.lit("|"), F.lit("\\|")),
        ),
        F.lit(" |"),
    )
    return df.select(*LOAD_ORDER, row.alias("value"))


def stack_blocks(df: DataFrame) -> DataFrame:
    """Entries with a stack trace as ``=== time LEVEL ===`` blocks, a blank line after each."""
    time = F.coalesce(F.concat(second_label(F.col("ts")), F.lit(" ")), F.lit(""))
    block = F.concat(
        F.lit("=== "), time, F.col("level"), F.lit(" ===\n"),
        F.coalesce("message", F.lit("null")), F.lit("\n"), F.col("stack_trace"), F.lit("\n"),
    )
    kept = df.where(has_stack_trace(F.col("stack_trace")))
    return kept.select(*LOAD_ORDER, block.alias("value"))


#: How rows of a level, and stacks, look.
LEVEL_COLOURS = {".ERROR, .FATAL": "#f44", ".WARN": "#fa0", ".INFO": "#4c4", ".DEBUG": "#4cc"}
LEVEL_STYLE = " ".join(f"{rows} {{ color: {colour}; }}" for rows, colour in LEVEL_COLOURS.items()) + " .stack { white-space: pre; }"


# Stands for the number of entries; no name of a source holds it.
ENTRIES = "\0"


def _document(df: DataFrame, rows: DataFrame, before: list[str], after: list[str], path: str) -> None:
    """Rows between opening and closing lines, as consecutive files.

    ``ENTRIES`` in an opening line becomes the number of entries, counted within the same job.
    """
    spark = df.sparkSession
    counting = [(i, text.partition(ENTRIES)) for i, text in enumerate(before) if ENTRIES in text]
    frame = [(0, "", i, text) for i, text in enumerate(before) if ENTRIES not in text]
    frame += [(2, "", i, text) for i, text in enumerate(after)]
    whole = rows.select(F.lit(1).alias("zone"), *LOAD_ORDER, "value")
    if frame:
        schema = "zone int, source_file string, line_number bigint, value string"
        whole = whole.unionByName(spark.createDataFrame(frame, schema))
    for i, (lead, _, rest) in counting:
        total = F.concat(F.lit(lead), F.count("*").cast("string"), F.lit(rest)).alias("value")
        place = [F.lit(0).alias("zone"), F.lit("").alias("source_file"), F.lit(i).cast("bigint").alias("line_number")]
        whole = whole.unionByName(df.agg(total).select(*place, "value"))
    order = ["zone", *LOAD_ORDER]
    whole.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def export_logs(df: DataFrame, format: str, path: str, source: str = "") -> str:
    """Write entries as ``json`` (lines), ``csv``, ``html`` or ``markdown`` (``md``)."""
    kind = format.strip().lower()
    # Titles and labels of the documents.
    if kind == "json":
        json_rows(_in_load_order(df)).write.json(path)
    elif kind == "csv":
        _document(df, csv_rows(df), [",".join(CSV_COLUMNS)], [], path)
    elif kind == "html":
        head = "".join(f"<th>{name}</th>" for name in TABLE_COLUMNS)
        before = [
            f'<!DOCTYPE html><html><head><meta charset="UTF-8"><title>Log Report - {source}</title>',
            f"<style>{LEVEL_STYLE}</style></head><body>",
            "<h1>Log Report</h1><p>Fonte: " + source + " | Entradas: " + ENTRIES + "</p>",
            f"<table><tr>{head}</tr>",
        ]
        _document(df, html_rows(df), before, ["</table></body></html>"], path)
    elif kind in ("markdown", "md"):
        before = [
            "# Log Report", "", "**Fonte:** " + source + "  ", "**Entradas:** " + ENTRIES, "",
            "| " + " | ".join(TABLE_COLUMNS) + " |", "|---|---|---|---|---|",
        ]
        _document(df, markdown_rows(df), before, [], path)
    else:
        raise ValueError(f"cannot export to {format!r}")
    return path


def export_stacks(df: DataFrame, path: str) -> str:
    """Write all stack traces as text blocks."""
    _document(df, stack_blocks(df), [], [], path)
    return path
