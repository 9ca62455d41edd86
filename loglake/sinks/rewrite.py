"""Split and merge: log text written again as other files.

Every write is range-partitioned on its order, so a day or level that holds most of the
log becomes several files in sequence instead of one task. File names sort in log order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loglake.functions.arguments import size_bytes
from loglake.functions.expressions import has_stack_trace
from loglake.functions.parts import (
    BLOCK_ENTRIES_SCHEMA,
    ENTRIES_SCHEMA,
    GROUPS_SCHEMA,
    PLACED_SCHEMA,
    RUNS_SCHEMA,
    TABLES_SCHEMA,
    block_tables,
    compose_tables,
    pack_runs,
    place_lines,
    walk_blocks,
    walk_clusters,
)
from loglake.model import LOAD_ORDER
from loglake.session import configure, scratch_dir
from loglake.sources.files import ListedFiles, existing, folder_files, literal_path
from loglake.sources.text import BLOCK, blocks_are_few, list_files, read_lines, read_logs


def entry_lines(header_only: bool = False) -> Column:
    """An entry as it stood in its file: the header line and, unless left out, its stack."""
    raw, stack = F.col("raw"), F.col("stack_trace")
    if header_only:
        return raw
    return F.when(has_stack_trace(stack), F.concat(raw, F.lit("\n"), stack)).otherwise(raw)


def _write_ordered(rows: DataFrame, order: Sequence[str], path: str, by: str | None = None) -> None:
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = ordered.select(*([by] if by else []), "value").write
    (writer.partitionBy(by) if by else writer).text(path)


def split_by_day(df: DataFrame, path: str, header_only: bool = False) -> str:
    """Folders ``day=yyyy-MM-dd`` with the entries of each day; entries without time are left out."""
    rows = df.where("ts IS NOT NULL").select(
        F.to_date("ts").alias("day"), *LOAD_ORDER, entry_lines(header_only).alias("value")
    )
    _write_ordered(rows, ["day", *LOAD_ORDER], path, by="day")
    return path


def split_by_level(df: DataFrame, path: str, header_only: bool = False) -> str:
    """Folders ``level=error`` and so on with the entries of each level."""
    rows = df.select(
        F.lower("level").alias("level"), *LOAD_ORDER, entry_lines(header_only).alias("value")
    )
    _write_ordered(rows, ["level", *LOAD_ORDER], path, by="level")
    return path


# --- split by size -------------------------------------------------------------------


def _line_bytes() -> Column:
    return (F.octet_length("value") + 1).cast("int")


def assign_parts(lines: DataFrame, size: str | int, exact: bool = True, few_blocks: bool = False) -> DataFrame:
    """``(source_file, block, pos, value, part)``: lines packed in order into parts of a size.

    Exact packing closes a part before the line that would overflow it, so where a part begins depends on all parts
    before it. Each block is therefore described by a jump table over its line lengths (see
    :mod:`loglake.functions.parts`); tables are composed, first those of a cluster of blocks, then those of a file's
    clusters, and give the state every block is entered with. No task sees more lines than a block's, or more
    tables than the square root of a file's blocks. ``exact=False`` cuts at multiples of the size instead: a plain prefix
    sum, where a part may exceed the size by less than one line.

    ``few_blocks`` says that lines come from a scan (see :func:`blocks_are_few`): then states are broadcast, and no
    line is shuffled. Otherwise lines are brought together by block.
    """
    limit = size_bytes(size)
    sized = lines.select(*BLOCK, "pos", "value", _line_bytes().alias("bytes"))
    entries = _entries(sized, limit) if exact else _bytes_before(sized)
    if few_blocks:
        placed = sized.join(F.broadcast(entries), BLOCK)
    else:
        placed = sized.join(entries.hint("shuffle_hash"), BLOCK).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "pos")
    return placed.mapInArrow(partial(place_lines, limit=limit, exact=exact), PLACED_SCHEMA)


def _bytes_before(sized: DataFrame) -> DataFrame:
    """Bytes before each block of a file, in the form of an entry state."""
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.groupBy(*BLOCK).agg(F.sum("bytes").alias("n"))
    return blocks.select(*BLOCK, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("used"), F.lit(0).cast("bigint").alias("parts"))


def _entries(sized: DataFrame, limit: int) -> DataFrame:
    """``(source_file, block, used, parts)``: bytes of the part open where a block begins, and parts up to it."""
    spark = sized.sparkSession
    runs = sized.select(*BLOCK, "pos", "bytes").mapInArrow(pack_runs, RUNS_SCHEMA)
    tables = (
        runs.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "pos").mapInArrow(partial(block_tables, limit=limit), TABLES_SCHEMA)
    )
    path = scratch_dir(spark, "jump-tables")
    tables.write.parquet(path)
    tables = spark.read.schema(TABLES_SCHEMA).parquet(path)
    in_file = Window.partitionBy("source_file")
    placed = tables.select(*BLOCK).select(
        *BLOCK,
        F.row_number().over(in_file.orderBy("block")).alias("place"),
        F.ceil(F.sqrt(F.count("*").over(in_file))).alias("width"),
    ).select(*BLOCK, F.floor((F.col("place") - 1) / F.col("width")).alias("cluster"))
    placed = tables.join(placed, BLOCK)
    cluster = ["source_file", "cluster"]

    def in_order(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
        return rows.repartition(*by).sortWithinPartitions(*by, *order)

    clusters = in_order(placed.select(*cluster, "block", "total", "table"), cluster, "block").mapInArrow(
        partial(compose_tables, limit=limit), GROUPS_SCHEMA
    )
    states = in_order(clusters, ["source_file"], "cluster").mapInArrow(partial(walk_clusters, limit=limit), ENTRIES_SCHEMA)
    none = F.lit(None)
    both = states.select(
        *cluster, none.cast("bigint").alias("block"), "used", "parts", none.cast("bigint").alias("total"), none.cast("binary").alias("table")
    ).unionByName(
        placed.select(*cluster, "block", none.cast("bigint").alias("used"), none.cast("bigint").alias("parts"), "total", "table")
    )
    # Nulls come first: a cluster's own state before its blocks.
    return in_order(both, cluster, "block").mapInArrow(partial(walk_blocks, limit=limit), BLOCK_ENTRIES_SCHEMA)


def split_by_size(
    spark: SparkSession, file: str, size: str | int, path: str, exact: bool = True
) -> str:
    """Folders ``part=1``, ``part=2`` and so on with the lines of a file, each at most ``size``."""
    lines = read_lines(spark, file)
    return write_parts(assign_parts(lines, size, exact, blocks_are_few(lines)), path)


def write_parts(parts: DataFrame, path: str) -> str:
    """Folders ``part=1``, ``part=2`` and so on with lines that know their part (see :func:`assign_parts`)."""
    _write_ordered(parts, ["part", "source_file", "block", "pos"], path, by="part")
    return path


# --- merge ---------------------------------------------------------------------------


#: Paths and ranks that may be broadcast.
RANKS_BROADCAST_BYTES = 8 << 20


def _by_rank(spark: SparkSession, names: Sequence[str]) -> tuple[ListedFiles, list[tuple[str, int]]]:
    """The files of names, and each with the places its name has in the list: a repeated name gives repeated rows."""
    roots = existing(spark, names)
    listed = ListedFiles(list_files(spark, [literal_path(name) for name in roots]) if roots else [])
    within: dict[str, list[str]] = {}
    for file in listed:
        for root in {file, file.rsplit("/", 1)[0]}:
            within.setdefault(root, []).append(file)
    return listed, [
        (file, rank) for rank, name in enumerate(names) if name in roots for file in within.get(roots[name].rstrip("/"), ())
    ]


def merge_files(
    spark: SparkSession, files: Sequence[str], path: str, order: str = "file", format: str | None = None
) -> str:
    """Lines of several files in one log; names that do not exist are skipped.

    Names are literal, also with ``[`` or ``*`` in them; a name given twice counts twice.

    ``order='file'`` keeps the given order of files, ``'line'`` sorts all lines as text,
    ``'timestamp'`` sorts whole entries by time, so stacks stay with their header.
    """
    if order not in ("file", "line", "timestamp"):
        raise ValueError(f"unknown order: {order!r}")
    # Every file is scanned once; the join with its ranks repeats it as often as it was named.
    once, ranked = _by_rank(spark, [name if isinstance(files, ListedFiles) else name.strip() for name in files])
    if not ranked:
        raise ValueError("none of the files exists")
    ranks = spark.createDataFrame(ranked, "source_file string, rank int")
    if sum(len(file) + 16 for file, _ in ranked) <= RANKS_BROADCAST_BYTES:
        ranks = F.broadcast(ranks)
    if order == "timestamp":
        entries = read_logs(spark, once, format).join(ranks, "source_file")
        rows = entries.select("ts", *LOAD_ORDER, entry_lines().alias("value"))
        _write_ordered(rows, ["ts", *LOAD_ORDER], path)
        return path
    rows = read_lines(spark, once).join(ranks, "source_file")
    if order == "line":
        # The address breaks ties: a line repeated a billion times still spreads over tasks.
        _write_ordered(rows, ["value", *BLOCK, "pos"], path)
        return path
    _write_ordered(rows, ["rank", *BLOCK, "pos"], path)
    return path


def merge_folder(spark: SparkSession, folder: str, path: str, order: str = "file") -> str:
    """The ``*.log`` files directly in a folder, merged in name order."""
    return merge_files(spark, [unquote(file) for file in folder_files(spark, folder)], path, order)


def read_ordered(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """``([by,] position, value)`` of what :mod:`loglake.sinks` wrote: lines numbered from 1 in written order.

    Files are in sequence by the number in their name; with ``by``, each of its folders is numbered on its own. Counting
    takes one row per block of a file; lines themselves are neither sorted nor shuffled.
    """
    configure(spark)
    schema = f"value string, {by} string" if by else "value string"
    scan = spark.read.schema(schema).text(path)
    lines = scan.select(
        *([by] if by else []), F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value",
    )
    keys = [by] if by else []
    blocks = lines.groupBy(*keys, *BLOCK).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    number = F.regexp_extract("source_file", r"part-(\d+)-[^/]*$", 1).cast("bigint")
    before = Window.partitionBy(*keys).orderBy(number, *BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*BLOCK, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = lines.join(F.broadcast(offsets) if blocks_are_few(lines) else offsets, BLOCK)
    return joined.select(*keys, (F.col("offset") + F.col("pos") - F.col("first") + 1).alias("position"), "value")
