"""Parsed entries kept as a table, so that text is parsed once and queried many times."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglake.functions.arguments import datetime_argument
from loglake.model import LOAD_ORDER, LOG_COLUMNS


def save_entries(entries: DataFrame, path: str) -> str:
    """Parquet in folders by day, each day in load order and over as many files as it needs."""
    by_day = entries.withColumn("day", F.to_date("ts"))
    order = ["day", *LOAD_ORDER]
    by_day.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("day").parquet(path)
    return path


def load_entries(
    spark: SparkSession, path: str, since: str | datetime | None = None, until: str | datetime | None = None
) -> DataFrame:
    """Stored entries; with bounds, only those between them, reading only their days."""
    entries = spark.read.parquet(path)
    for bound, keeps in ((since, "__ge__"), (until, "__le__")):
        if bound:
            moment = datetime_argument(bound)
            ts = F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
            entries = entries.where(getattr(F.col("day"), keeps)(F.lit(moment.date())))
            entries = entries.where(getattr(F.col("ts"), keeps)(ts))
    return entries.select(*LOG_COLUMNS)
