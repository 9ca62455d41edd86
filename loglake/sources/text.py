"""Log text to entries: scan, line numbers, format detection, multi-line assembly.

A line is addressed by ``(source_file, block, pos)``: the split of the file it was
scanned from, and a position that grows within the split. Splits bound every group
below: no step needs a whole file in one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import partial, reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loglake.functions.tasks import FORMAT_SCHEMA, first_formats
from loglake.model import LOG_COLUMNS, severity_of
from loglake.session import configure, scratch_dir
from loglake.sources.files import (
    ListedFiles,
    exact_path,
    folder_files,
    glob_exists,
    has_partitions,
    hidden_files,
    is_file,
    is_hidden,
    literal_path,
    plain_uri,
    read_hidden,
    tree_files,
    visible_files,
)
from loglake.sources.formats import (
    DETECTION_LINES,
    DETECTION_ORDER,
    FALLBACK_FORMAT,
    LineFormat,
    detected_format,
    format_name,
    line_format,
)

# The table of blocks goes to every executor only up to this size; beyond it Spark shuffles.
BLOCK_TABLE_BROADCAST_BYTES = 256 * 1024 * 1024
_BLOCK_ROW_BYTES = 256
# Lines that already carry a number are cut into blocks of this many.
NUMBERED_BLOCK_LINES = 1 << 20

BLOCK = ["source_file", "block"]


# --- scans ------------------------------------------------------------------


def read_lines(spark: SparkSession, paths: str | Sequence[str], **options: str) -> DataFrame:
    """Lines of text files as ``(source_file, block, pos, value)``, split by Spark as usual.

    A folder stands for the files directly in it (``recursiveFileLookup`` for all below). Files of any name are
    read: those Spark's reader passes over come from a source of their own.
    """
    configure(spark)
    return _scan(spark, _as_list(paths), options)


def _as_list(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else paths if isinstance(paths, ListedFiles) else list(paths)


def _scan(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    hidden = hidden_files(spark, paths, _recursive(options))
    scans = [_scan_visible(spark, seen, options)] if (seen := _readable(spark, paths, options)) else []
    if hidden:
        scans.append(read_hidden(spark, hidden))
    return reduce(DataFrame.unionAll, scans)


def _scan_visible(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    return spark.read.options(**options).text(paths).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def _recursive(options: dict[str, str]) -> bool:
    return options.get("recursiveFileLookup") == "true"


def _readable(spark: SparkSession, paths: list[str], options: dict[str, str]) -> list[str]:
    """The paths as Spark's reader takes them without loss: hidden files apart, folders with ``key=value`` subfolders as their files."""
    if isinstance(paths, ListedFiles):
        return [exact_path(file) for file in paths if not is_hidden(unquote(file).rsplit("/", 1)[-1])]
    if _recursive(options):
        return paths
    kept = []
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if is_hidden(name.replace("\\", "")) and is_file(spark, path):
            continue
        kept += [literal_path(f) for f in visible_files(spark, path)] if has_partitions(spark, path) else [path]
    return kept


def lines_of(numbered: DataFrame) -> DataFrame:
    """Lines from a table ``(source_file, line_number, value)``, addressed like scanned ones."""
    return numbered.select(
        "source_file",
        F.floor((F.col("line_number") - 1) / NUMBERED_BLOCK_LINES).alias("block"),
        F.col("line_number").alias("pos"),
        "value",
    )


def list_files(spark: SparkSession, paths: str | Sequence[str], **options: str) -> list[str]:
    """Files behind paths and globs, in path order, named as in ``source_file``: URIs with special characters encoded."""
    paths = _as_list(paths)
    if isinstance(paths, ListedFiles):
        return sorted(paths)
    seen = _readable(spark, paths, options)
    uris = spark.read.options(**options).text(seen).inputFiles() if seen else []
    return sorted({plain_uri(uri) for uri in uris} | {uri for uri, _ in hidden_files(spark, paths, _recursive(options))})


# --- line numbers -------------------------------------------------------------


def blocks_are_few(lines: DataFrame) -> bool:
    """Whether the block table of scanned lines surely fits a broadcast.

    Blocks are at most one per scan task plus one per file, both known from planning.
    """
    rows = len(lines.inputFiles()) + lines.rdd.getNumPartitions()
    return rows * _BLOCK_ROW_BYTES <= BLOCK_TABLE_BROADCAST_BYTES


def block_table(lines: DataFrame, header=None) -> DataFrame:
    """One row per block: lines before it in its file, first position, and header positions.

    Counting is a map-side aggregate; only one row per block and task is shuffled. The
    prefix sum then runs over blocks, not lines.
    """
    counted = [F.count("*").alias("_lines"), F.min("pos").alias("_first_pos")]
    if header is not None:
        counted += [
            F.min(F.when(header, F.col("pos"))).alias("_first_header"),
            F.max(F.when(header, F.col("block"))).alias("_headed"),
        ]
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    table = lines.groupBy(*BLOCK).agg(*counted).withColumn(
        "_offset", F.coalesce(F.sum("_lines").over(before), F.lit(0))
    )
    if header is None:
        return table
    return table.withColumn("_owner", F.last("_headed", ignorenulls=True).over(before))


def _join_blocks(lines: DataFrame, blocks: DataFrame, few_blocks: bool) -> DataFrame:
    return lines.join(F.broadcast(blocks) if few_blocks else blocks, BLOCK)


def _line_number():
    return (F.col("_offset") + F.col("pos") - F.col("_first_pos") + 1).alias("line_number")


def with_line_numbers(lines: DataFrame, few_blocks: bool = False) -> DataFrame:
    """``(source_file, line_number, value)``, numbered from 1 in every file, without a sort.

    ``few_blocks`` (see :func:`blocks_are_few`) sends the block table to the lines;
    otherwise Spark picks the join.
    """
    numbered = _join_blocks(lines, block_table(lines), few_blocks)
    return numbered.select("source_file", _line_number(), "value")


# --- entries ------------------------------------------------------------------


def _as_entries(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("severity", severity_of(F.col("level"))).select(*LOG_COLUMNS)


def single_line_entries(lines: DataFrame, fmt: LineFormat, few_blocks: bool = False) -> DataFrame:
    """Entries of the lines that match; all others are dropped. No line is shuffled."""
    numbered = with_line_numbers(lines, few_blocks)
    return _as_entries(fmt.fields(numbered.withColumnRenamed("value", "raw"), False))


def multi_line_entries(lines: DataFrame, fmt: LineFormat, few_blocks: bool = False) -> DataFrame:
    """Entries whose following non-header lines form the stack trace.

    Lines a block starts with belong to the last header of an earlier block, which the block table names. They are
    joined block by block first, so what is sent to that block is one piece per block that begins without a header, not its
    lines: an entry may go on over any number of blocks, and no task sorts more than a block. There a running
    maximum finds each line's header. Lines before a file's first header have no owner and are dropped unshuffled.
    """
    header = fmt.matches(F.col("value"))
    tagged = lines.withColumn("_head", header)
    blocks = block_table(tagged, F.col("_head")).drop("_lines", "_headed")
    leading = F.col("_first_header").isNull() | (F.col("pos") < F.col("_first_header"))
    begun = F.col("_first_header").isNotNull() & (F.col("pos") >= F.col("_first_header"))
    inner = _join_blocks(tagged, blocks, few_blocks).where(begun).select(
        "source_file", F.col("block").alias("_home"), _line_number(), "_head", "value"
    )
    owned_lines = _join_blocks(lines, blocks, few_blocks).where(leading & F.col("_owner").isNotNull())
    ordered = F.sort_array(F.collect_list(F.struct(_line_number(), "value")))
    pieces = (
        owned_lines.groupBy("source_file", "block", "_owner")
        .agg(ordered.alias("_lines"))
        .select(
            "source_file",
            F.col("_owner").alias("_home"),
            F.col("_lines")[0]["line_number"].alias("line_number"),
            F.lit(False).alias("_head"),
            F.array_join(F.col("_lines")["value"], "\n").alias("value"),
        )
    )
    routed = inner.unionByName(pieces)
    in_order = (
        Window.partitionBy("source_file", "_home")
        .orderBy("line_number")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    owned = routed.withColumn(
        "_entry", F.max(F.when(F.col("_head"), F.col("line_number"))).over(in_order)
    )
    follower = F.when(~F.col("_head"), F.struct("line_number", "value"))
    grouped = owned.groupBy("source_file", "_home", "_entry").agg(
        F.first(F.when(F.col("_head"), F.col("value")), ignorenulls=True).alias("raw"),
        F.collect_list(follower).alias("_followers"),
    )
    joined = F.array_join(F.sort_array("_followers")["value"], "\n")
    entries = grouped.select(
        "source_file",
        F.col("_entry").alias("line_number"),
        "raw",
        F.nullif(F.regexp_replace(joined, r"^\n+", ""), F.lit("")).alias("stack"),
    )
    parsed = fmt.fields(entries, True).withColumn("stack_trace", F.col("stack"))
    return _as_entries(parsed)


def parse_lines(
    lines: DataFrame,
    format: str,
    pattern: str | None = None,
    stacks: bool = True,
    few_blocks: bool = False,
) -> DataFrame:
    """Lines of one format to entries.

    ``stacks=False`` skips the assembly of multi-line entries for callers that never look
    at stack traces; it saves the only shuffle of the text.
    """
    fmt = line_format(format, pattern)
    if fmt.multi_line and stacks:
        return multi_line_entries(lines, fmt, few_blocks)
    return single_line_entries(lines, fmt, few_blocks)


# --- format detection ---------------------------------------------------------


def detect_formats(numbered: DataFrame) -> DataFrame:
    """``(source_file, format)`` from the first lines of ``(source_file, line_number, value)``."""
    seen = numbered.where(F.col("line_number") <= DETECTION_LINES).withColumn(
        "format", detected_format(F.col("value"))
    )
    first = F.min(F.when(F.col("format").isNotNull(), F.struct("line_number", "format")))
    return seen.groupBy("source_file").agg(
        F.coalesce(first["format"], F.lit(FALLBACK_FORMAT)).alias("format")
    )


# A file is one split when only its first lines are wanted.
_HEAD_SPLIT_BYTES = 1 << 40


def file_formats(
    spark: SparkSession, paths: str | Sequence[str], limit: int = DETECTION_LINES, **options: str
) -> DataFrame:
    """``(source_file, format)`` of every file that has lines, written to the shared folder.

    Spark's own text scan reads the first lines of each file, so on any file system it knows: every file is one split, a
    task matches whole lines, and stops after those it wants. What leaves a task is a word per file. The
    scan belongs to a session of its own, with these split sizes.
    """
    paths = _as_list(paths)
    path = scratch_dir(spark, "formats")

    def write(scan: DataFrame) -> None:
        heads = scan.select("source_file", detected_format(F.col("value")).alias("format"))
        found = heads.mapInArrow(partial(first_formats, limit=limit, fallback=FALLBACK_FORMAT), FORMAT_SCHEMA)
        # Tasks take several files each, one after the other.
        found.coalesce(4 * spark.sparkContext.defaultParallelism).write.mode("append").parquet(path)

    if seen := _readable(spark, paths, options):
        session = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if key.startswith("fs."):
                session.conf.set(key, value)
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            session.conf.set(key, str(_HEAD_SPLIT_BYTES))
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(limit))
        write(_scan_visible(session, seen, options))
    if hidden := hidden_files(spark, paths, _recursive(options)):
        write(read_hidden(spark, hidden, limit))
    return spark.read.schema(FORMAT_SCHEMA).parquet(path)


# --- entry points -------------------------------------------------------------


def read_logs(
    spark: SparkSession,
    paths: str | Sequence[str],
    format: str | None = None,
    pattern: str | None = None,
    stacks: bool = True,
    **options: str,
) -> DataFrame:
    """Entries of files, folders or globs; the format is detected per file unless given.

    Files of one format are scanned together, so each gets the cheapest plan for it: a
    map-only parse for one-line formats, one shuffle for multi-line ones.
    """
    configure(spark)
    if format is not None and format.strip():
        lines = read_lines(spark, paths, **options)
        return parse_lines(lines, format_name(format), pattern, stacks, blocks_are_few(lines))
    formats = file_formats(spark, paths, **options)
    # At most as many rows as there are formats.
    kinds = sorted(r["format"] for r in formats.select("format").distinct().collect())
    if not kinds and not list_files(spark, paths, **options):
        raise ValueError(f"no log files found in {paths!r}")
    if len(kinds) < 2:
        lines = read_lines(spark, paths, **options)
        return parse_lines(lines, kinds[0] if kinds else FALLBACK_FORMAT, stacks=stacks, few_blocks=blocks_are_few(lines))
    parts = []
    for name in kinds:
        # Only where formats are mixed: a reader takes names, so they go through the driver, as in any listing.
        members = ListedFiles(r["source_file"] for r in formats.where(F.col("format") == name).collect())
        lines = read_lines(spark, members)
        parts.append(parse_lines(lines, name, stacks=stacks, few_blocks=blocks_are_few(lines)))
    return reduce(DataFrame.unionByName, parts)


def read_folder(spark: SparkSession, folder: str, extension: str = "log", stacks: bool = True) -> DataFrame:
    """Entries of the files ``*.extension`` directly in a folder (see :func:`folder_files`)."""
    files = folder_files(spark, folder, extension)
    if not files:
        raise ValueError(f"no *.{extension} files in {folder!r}")
    return read_logs(spark, files, stacks=stacks)


def read_glob(
    spark: SparkSession, pattern: str, format: str | None = None, stacks: bool = True
) -> DataFrame:
    """Entries of the files a glob matches; ``**`` descends into folders."""
    if "**" not in pattern:
        if not glob_exists(spark, pattern):
            raise ValueError(f"no log files found in {pattern!r}")
        return read_logs(spark, pattern, format, stacks=stacks)
    base = pattern.partition("**")[0].rpartition("/")[0] or "/"
    wanted = _glob_regex(pattern)
    files = ListedFiles(file for file in tree_files(spark, base) if wanted.search(re.sub(r"^[\w+.-]+:/+", "/", unquote(file))))
    if not files:
        raise ValueError(f"no log files found in {pattern!r}")
    return read_logs(spark, files, format, stacks=stacks)


def _glob_regex(pattern: str) -> re.Pattern[str]:
    """A whole glob as a pattern over listed paths: ``**/`` is any number of folders, ``*`` stays in one."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]/]+\]|\{[^}/]+\})", re.sub(r"^[a-z0-9]+:/+", "/", pattern))
    made = []
    for part in parts:
        if part in _GLOB_WORDS:
            made.append(_GLOB_WORDS[part])
        elif part.startswith("[") and part.endswith("]"):
            made.append("[" + part[1:-1].replace("!", "^", 1) + "]" if part[1] == "!" else part)
        elif part.startswith("{") and part.endswith("}"):
            made.append("(?:" + "|".join(re.escape(x) for x in part[1:-1].split(",")) + ")")
        else:
            made.append(re.escape(part))
    return re.compile("".join(made) + r"\Z")


_GLOB_WORDS = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def load_report(lines: DataFrame, formats: DataFrame | None = None, format: str | None = None) -> DataFrame:
    """Lines, entries and format of every source, in path order; formats per file, or one for all.

    An entry begins at a line its format matches, so lines are counted where they are read and nothing is assembled.
    """
    kinds = [format_name(format)] if formats is None else list(DETECTION_ORDER)
    begun = [F.sum(line_format(kind).entries(F.col("value"))).alias(f"_{kind}") for kind in kinds]
    counted = lines.groupBy("source_file").agg(F.count("*").alias("lines"), *begun)
    if formats is None:
        report = counted.withColumn("format", F.lit(kinds[0]))
    else:
        report = counted.join(formats, "source_file", "left")
    entries = F.coalesce(*[F.when(F.col("format") == kind, F.col(f"_{kind}")) for kind in kinds], F.lit(0))
    return report.select("source_file", "format", "lines", entries.alias("entries")).orderBy("source_file")
