"""Listing files by any name, and a text source for the names Spark's own readers pass over.

Spark's readers take names that begin with ``_`` or ``.`` for bookkeeping and leave them out without a word. Log folders do hold
such files, so whatever is listed here is read: by Spark's text reader, or, for hidden names, by :class:`HiddenLines`.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES_SCHEMA = "source_file string, block bigint, pos bigint, value string"
_READ_BYTES = 1 << 20
_BATCH_LINES = 4096


# --- listing ----------------------------------------------------------------------------


class ListedFiles(list):
    """Files by the names a listing gave them: no globs, no folders, nothing left to look up."""


def literal_path(name: str) -> str:
    """A name as a reader argument that matches just this name."""
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in name)


def exact_path(source_file: str) -> str:
    """A listed file as a reader argument that matches just this file."""
    return literal_path(unquote(source_file))


def is_hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file of this name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _hadoop(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), location


def _uri(status) -> str:
    """A file's name as ``source_file`` shows it."""
    return plain_uri(status.getPath().toUri().toString())


def plain_uri(uri: str) -> str:
    """One form for ``file:///x`` and ``file:/x``."""
    return re.sub(r"^([\w+.-]+):///", r"\1:/", uri)


def _has_glob(path: str) -> bool:
    return re.search(r"(?<!\\)[*?\[{]", path) is not None


def folder_files(spark: SparkSession, folder: str, extension: str = "log") -> ListedFiles:
    """The files ``*.extension`` directly in a folder, sorted; subfolders do not matter."""
    fs, base = _hadoop(spark, folder)
    files = (s for s in fs.listStatus(base) if s.isFile() and s.getPath().getName().endswith(f".{extension}"))
    return ListedFiles(sorted(map(_uri, files), key=unquote))


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a reader argument names one file."""
    fs, location = _hadoop(spark, re.sub(r"\\(.)", r"\1", path))
    return not _has_glob(path) and fs.exists(location) and fs.getFileStatus(location).isFile()


def glob_exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a pattern matches anything."""
    fs, location = _hadoop(spark, pattern)
    return bool(len(fs.globStatus(location) or ()))


def has_partitions(spark: SparkSession, path: str) -> bool:
    """Whether a folder has subfolders named ``key=value``: Spark's readers then leave out the files beside them."""
    fs, location = _hadoop(spark, path.rstrip("/") + "/*=*")
    return any(status.isDirectory() for status in fs.globStatus(location) or ())


def visible_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly in the folders a path stands for, but for hidden ones."""
    fs, location = _hadoop(spark, path.rstrip("/") + "/*")
    names = (s.getPath() for s in fs.globStatus(location) or () if s.isFile())
    return [name.toString() for name in names if not is_hidden(name.getName())]


def tree_files(spark: SparkSession, base: str) -> ListedFiles:
    """All files below a folder, of any name and at any depth, sorted."""
    fs, location = _hadoop(spark, base)
    files = ListedFiles()
    if fs.exists(location):
        found = fs.listFiles(location, True)
        while found.hasNext():
            files.append(_uri(found.next()))
    return ListedFiles(sorted(files))


def existing(spark: SparkSession, names: Sequence[str]) -> dict[str, str]:
    """The names that exist, taken literally, each with the name its files begin with in a listing."""
    found = {}
    for name in dict.fromkeys(names):
        fs, location = _hadoop(spark, name)
        if fs.exists(location):
            found[name] = plain_uri(fs.makeQualified(location).toUri().toString())
    return found


def hidden_files(spark: SparkSession, paths: Sequence[str], recursive: bool = False) -> list[tuple[str, int]]:
    """``(uri, bytes)`` of the files behind paths, folders and globs that Spark's readers would leave out.

    The file system is asked for just these names, so a folder of a million files is not listed for them.
    """
    found: dict[str, int] = {}
    if isinstance(paths, ListedFiles):
        for uri in paths:
            name = unquote(uri)
            if is_hidden(name.rsplit("/", 1)[-1]):
                fs, location = _hadoop(spark, name)
                found[uri] = fs.getFileStatus(location).getLen()
        return sorted(found.items())

    def take(statuses) -> None:
        for status in statuses or ():
            if status.isFile() and is_hidden(status.getPath().getName()):
                found[_uri(status)] = status.getLen()

    for path in paths:
        if recursive:
            fs, location = _hadoop(spark, re.sub(r"\\(.)", r"\1", path))
            files = fs.listFiles(location, True)
            while files.hasNext():
                take([files.next()])
            continue
        fs, location = _hadoop(spark, path)
        for name in _hidden_patterns(path.rstrip("/").rsplit("/", 1)[-1]):
            parent = path.rstrip("/")[: -len(path.rstrip("/").rsplit("/", 1)[-1])]
            take(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(parent + name)))
        # Names inside, if the path is, or matches, folders.
        take(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/{_*,.*,*._COPYING_}")))
    return sorted(found.items())


def _hidden_patterns(name: str) -> list[str]:
    """Patterns for the hidden ones among the names a last path component stands for."""
    if not _has_glob(name):
        return [name] if is_hidden(name.replace("\\", "")) else []
    if name.startswith("*"):
        rest = name.lstrip("*")
        return [f"[_.]*{rest}"] + ([rest] if rest[:1] in ("_", ".") else [])
    return [name]


# --- text of hidden files ---------------------------------------------------------------------


class _Split(InputPartition):
    def __init__(self, uri: str, start: int, end: int, lines: int | None):
        self.uri, self.start, self.end, self.lines = uri, start, end, lines


class HiddenLines(DataSource):
    """Lines of listed files of any name, in splits like those of Spark's text reader.

    Options: ``files``, a JSON list of (uri, bytes); ``split``, bytes of a split; ``lines``, how many lines of each
    file are wanted (all, if left out).
    """

    @classmethod
    def name(cls) -> str:
        return "loglake_hidden_lines"

    def schema(self) -> str:
        return LINES_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


class _LineReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.split = int(options["split"])
        self.lines = int(options["lines"]) if "lines" in options else None

    def partitions(self) -> list[_Split]:
        if self.lines is not None:
            return [_Split(uri, 0, size, self.lines) for uri, size in self.files]
        return [
            _Split(uri, start, min(start + self.split, size), None)
            for uri, size in self.files
            for start in range(0, max(size, 1), self.split)
        ]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        """A split owns the lines that begin after its first byte, up to one that begins right at its end."""
        names = ["source_file", "block", "pos", "value"]
        run: list[str] = []
        pos = 0
        for line in _lines_of(partition.uri, partition.start, partition.end):
            run.append(line.decode("utf-8", "replace"))
            if partition.lines is not None and pos + len(run) >= partition.lines:
                break
            if len(run) == _BATCH_LINES:
                yield self._batch(partition, pos, run, names)
                pos, run = pos + len(run), []
        if run:
            yield self._batch(partition, pos, run, names)

    @staticmethod
    def _batch(partition: _Split, pos: int, run: list[str], names: list[str]) -> pa.RecordBatch:
        n = len(run)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([partition.uri] * n), pa.array([partition.start] * n, pa.int64()),
                pa.array(range(pos, pos + n), pa.int64()), pa.array(run, pa.string()),
            ],
            names,
        )


def _opened(uri: str):
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path), "rb")  # noqa: SIM115
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(unquote(uri))
    return system.open_input_file(path)


def _lines_of(uri: str, start: int, end: int) -> Iterator[bytes]:
    r"""Lines of the split ``[start, end)``: ended by ``\n``, ``\r`` or ``\r\n``, the last also by the end of the file."""
    with _opened(uri) as file:
        file.seek(start)
        at, tail, parts, skip = start, b"", [], start > 0
        done = False
        while not done:
            data = file.read(_READ_BYTES)
            done = not data
            data = tail + data
            # A carriage return at the very end may be half of an end of line.
            tail = b"\r" if data.endswith(b"\r") and not done else b""
            if tail:
                data = data[:-1]
            begin = 0
            for mark in re.finditer(rb"\r\n|\r|\n", data):
                parts.append(data[begin : mark.start()])
                line, parts = b"".join(parts), []
                if skip:
                    skip = False
                else:
                    yield line
                at, begin = at + len(line) + mark.end() - mark.start(), mark.end()
                if at > end:
                    return
            parts.append(data[begin:])
        last = b"".join(parts)
        if last and not skip:
            yield last


def read_hidden(spark: SparkSession, files: Sequence[tuple[str, int]], lines: int | None = None) -> DataFrame:
    """``(source_file, block, pos, value)`` of hidden files."""
    spark.dataSource.register(HiddenLines)
    reader = spark.read.format(HiddenLines.name()).option("files", json.dumps(list(files)))
    size = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    reader = reader.option("split", str(size))
    return (reader if lines is None else reader.option("lines", str(lines))).load()
