"""Helpers the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with null texts as empty ones; other columns are not read."""
    return documents.select("doc_id", F.coalesce(documents["text"], F.lit("")).alias("text"))


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a reread, not a recomputation. The table goes when the
    session's file system is closed.
    """
    spark = df.sparkSession
    jvm, path = spark._jvm, f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return memory that this process has freed, but Arrow and the C library keep for later, to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries lack this call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(task: Callable) -> Callable:
    """A function for ``mapInArrow`` whose worker, idle or used by another task next, keeps none of what ``task`` has freed."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
