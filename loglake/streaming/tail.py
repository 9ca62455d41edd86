"""Following a growing log: a stateless stream of the lines worth showing.

Spark's file stream sees new files, not bytes appended to a file, so the input is a
folder of rolled log files; any streaming DataFrame with a ``value`` column works too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loglake.functions.expressions import contains_text, highlight, level_in_line
from loglake.model import SEVERITY, level_name, severity_of


def tail_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Lines of the files that appear in a folder."""
    return spark.readStream.options(**options).text(folder)


def tail_filter(
    lines: DataFrame, min_level: str | None = None, text: str | None = None, terms: Sequence[str] = ()
) -> DataFrame:
    """Lines holding a text and naming at least a level, with their level and marked terms.

    With a minimum level, lines that name none are dropped. Works on batches and streams.
    """
    seen = lines.withColumn("level", level_in_line(F.col("value")))
    if text and text.strip():
        seen = seen.where(contains_text(F.col("value"), text))
    if min_level:
        bound = SEVERITY[level_name(min_level)]
        seen = seen.where(F.col("level").isNotNull() & (severity_of(F.col("level")) >= bound))
    return seen.withColumn("shown", highlight(F.col("value"), terms))


class Tail:
    """A running tail that can be stopped; starting it again replaces the former one."""

    def __init__(self, name: str = "tail"):
        self.name = name
        self._query: StreamingQuery | None = None

    def start(self, lines: DataFrame, sink: str = "console", checkpoint: str | None = None, **trigger) -> StreamingQuery:
        self.stop()
        writer = lines.writeStream.format(sink).queryName(self.name).outputMode("append")
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        if trigger:
            writer = writer.trigger(**trigger)
        self._query = writer.start()
        return self._query

    @property
    def is_running(self) -> bool:
        return self._query is not None and self._query.isActive

    def stop(self) -> None:
        if self.is_running:
            self._query.stop()
