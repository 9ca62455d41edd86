"""The executive report: several analyses of one log in one long table."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglake.functions.expressions import (
    duration_label,
    escape_html,
    escape_markdown,
    minute_label,
    second_label,
    thousands,
)
from loglake.operators.anomalies import findings
from loglake.operators.stats import (
    heatmap_of_rollup,
    heatmap_peak_of_rollup,
    level_distribution_of_rollup,
    minute_rollup,
    summary_of_rollup,
    timeline_of_rollup,
    top_errors,
)
from loglake.operators.templates import template_rollup
from loglake.session import kept

# Weekday labels, Monday first, and the sign of each heatmap intensity.
WEEKDAYS = ["Seg", "Ter", "Qua", "Qui", "Sex", "Sab", "Dom"]
INTENSITY_SIGNS = [".", "░", "▒", "▓", "█"]
TIMELINE_INTERVAL = "1h"
REPORT_ERRORS = 10


def _weekday(dow: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), dow + 1)


def _hour(hour: Column) -> Column:
    return F.lpad(hour.cast("string"), 2, "0")


def executive_report(df: DataFrame, generated_at: datetime | None = None, **detector_options) -> DataFrame:
    """``(section, ord, key, value)`` rows: summary, levels, top errors, timeline, anomalies, heatmap.

    Summary, levels, timeline, spikes, gaps and heatmap all come from one per-minute
    roll-up, templates from another one; both are written once because they are small. Only the top
    errors, which look at stacks, read the entries a third time. Nothing stays cached.
    """
    rollup = kept(minute_rollup(df), "minutes")
    templates = kept(template_rollup(df), "templates")
    facts = summary_of_rollup(rollup)
    peak = heatmap_peak_of_rollup(rollup)

    def section(name: str, rows: DataFrame, ord: Column, key: Column, value: Column) -> DataFrame:
        return rows.select(
            F.lit(name).alias("section"),
            ord.cast("bigint").alias("ord"),
            key.cast("string").alias("key"),
            value.cast("string").alias("value"),
        )

    def ranked(rows: DataFrame, *order) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))

    labels = ["total", "start", "end", "duration"]
    values = [
        thousands(F.col("total")),
        minute_label(F.col("start_ts")),
        minute_label(F.col("end_ts")),
        duration_label(F.col("duration_s")),
    ]
    if generated_at is not None:
        labels.append("generated_at")
        values.append(F.lit(generated_at.strftime("%Y-%m-%d %H:%M:%S")))
    facts = facts.select(
        F.posexplode(F.array(*[F.struct(F.lit(l).alias("k"), v.alias("v")) for l, v in zip(labels, values)]))
    )
    found = ranked(findings(df, rollup, templates=templates, **detector_options), "ord", "ts", "pattern")
    described = F.concat_ws(
        " | ",
        "detector",
        second_label(F.col("ts")),
        "pattern",
        F.concat(F.lit("n="), F.col("n")),
        F.concat(F.lit("baseline="), F.col("baseline").cast("bigint")),
    )
    heat = heatmap_of_rollup(rollup)
    sign = F.element_at(F.array(*[F.lit(s) for s in INTENSITY_SIGNS]), F.col("intensity") + 1)
    cell = F.when(F.col("n") == 0, sign).otherwise(F.concat(sign, F.col("n").cast("string")))
    parts = [
        section("summary", facts, F.col("pos") + 1, F.col("col.k"), F.col("col.v")),
        section("levels", level_distribution_of_rollup(rollup), F.col("severity"), F.col("level"), thousands(F.col("n"))),
        section(
            "top_errors",
            ranked(top_errors(df, REPORT_ERRORS), F.desc("n"), "signature"),
            F.col("rank"), F.col("signature"), thousands(F.col("n")),
        ),
        section(
            "timeline",
            ranked(timeline_of_rollup(rollup, TIMELINE_INTERVAL), "bucket"),
            F.col("rank"), F.date_format("bucket", "dd/MM HH:mm"), thousands(F.col("n")),
        ),
        section("anomalies", found, F.col("rank"), F.col("severity"), described),
        section(
            "heatmap_peak",
            peak,
            F.lit(1),
            F.concat(_weekday(F.col("dow")), F.lit(" "), _hour(F.col("hour")), F.lit(":00")),
            thousands(F.col("n")),
        ),
        section(
            "heatmap",
            heat,
            F.col("dow") * 24 + F.col("hour") + 1,
            F.concat(_weekday(F.col("dow")), F.lit(" "), _hour(F.col("hour"))),
            cell,
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


# Report sections in order, with the titles of their two columns.
SECTIONS = [
    ("summary", "Summary", "Fact", "Value"),
    ("levels", "Levels", "Level", "Count"),
    ("top_errors", "Top Errors", "Signature", "Count"),
    ("timeline", "Timeline", "Bucket", "Count"),
    ("anomalies", "Anomalies", "Severity", "Finding"),
    ("heatmap_peak", "Heatmap Peak", "Cell", "Count"),
    ("heatmap", "Temporal Heatmap", "Cell", "Count"),
]


def write_report(report: DataFrame, path: str, format: str = "markdown") -> str:
    """The report as a Markdown or HTML table per section, in section order."""
    spark = report.sparkSession
    markdown = format.strip().lower() in ("markdown", "md", "markdown-report")
    if not markdown and format.strip().lower() not in ("html", "html-report"):
        raise ValueError(f"cannot write a report as {format!r}")
    if markdown:
        line = F.concat(
            F.lit("| "), escape_markdown(F.col("key")), F.lit(" | "), escape_markdown(F.col("value")), F.lit(" |")
        )
    else:
        line = F.concat(
            F.lit("<tr><td>"), escape_html(F.col("key")), F.lit("</td><td>"), escape_html(F.col("value")),
            F.lit("</td></tr>"),
        )
    frame = []
    for i, (name, title, left, right) in enumerate(SECTIONS):
        if markdown:
            head = f"\n## {title}\n\n| {left} | {right} |\n|---|---|"
        else:
            head = f"<h2>{title}</h2><table><tr><th>{left}</th><th>{right}</th></tr>"
            frame.append((i, 2_000_000_000, "</table>"))
        frame.append((i, -1, head))
    opening = "# Executive Log Report" if markdown else "<!DOCTYPE html><html><body><h1>Executive Log Report</h1>"
    frame.append((-1, 0, opening))
    if not markdown:
        frame.append((len(SECTIONS), 0, "</body></html>"))
    place = None
    for i, (name, *_) in enumerate(SECTIONS):
        place = (place.when if place is not None else F.when)(F.col("section") == name, i)
    rows = report.select(place.alias("zone"), "ord", line.alias("value")).unionByName(
        spark.createDataFrame(frame, "zone int, ord bigint, value string")
    )
    rows.orderBy("zone", "ord").select("value").write.text(path)
    return path
