"""Following one growing file: a streaming source whose offset is how many bytes of which file were read.

A file is known by what it is (device, inode and first line), not by its name. So a log that is renamed and begun anew is
two files: the rest of the old one is read under its new name, the new one from its start; and a log that is copied and cut
to nothing is a new file, too. Only whole lines are read: what a writer has not ended yet comes with a later batch.

The file must be visible under the same path to the driver and to the executors.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of the file that exist already and are shown at the start.
LAST_BYTES = 4096
#: Bytes of one input partition, and of one read.
SPLIT_BYTES = 32 << 20
_READ_BYTES = 1 << 20
_HEAD_BYTES = 4096


class _Range(InputPartition):
    """Whole lines that begin in ``[start, end)`` of a file."""

    def __init__(self, path: str, identity: str, start: int, end: int):
        self.path, self.identity, self.start, self.end = path, identity, start, end


def identity(path: str) -> str | None:
    """What a file is, whatever its name; None while it has no whole line, or if it is gone."""
    try:
        with open(path, "rb") as file:
            head = file.read(_HEAD_BYTES)
            stat = os.fstat(file.fileno())
    except (FileNotFoundError, IsADirectoryError):
        return None
    line, mark, _ = head.partition(b"\n")
    if not mark and len(head) < _HEAD_BYTES:
        return None
    return f"{stat.st_dev}:{stat.st_ino}:{zlib.crc32(line)}"


def _versions(path: str) -> dict[str, str]:
    """The file and its rotated former versions (``name.*``): identity to path."""
    folder, name = os.path.split(os.path.abspath(path))
    found: dict[str, str] = {}
    for other in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if other == name or other.startswith(f"{name}."):
            full = os.path.join(folder, other)
            if (known := identity(full)) is not None and (known not in found or other == name):
                found[known] = full
    return found


def _whole_lines(path: str) -> int:
    """Bytes up to the end of the last whole line."""
    with open(path, "rb") as file:
        at = file.seek(0, os.SEEK_END)
        while at > 0:
            size = min(_READ_BYTES, at)
            file.seek(at - size)
            found = file.read(size).rfind(b"\n")
            if found >= 0:
                return at - size + found + 1
            at -= size
    return 0


def _start(path: str, last: int) -> int:
    """Where the last bytes of a file begin, without the line they begin in the middle of."""
    with open(path, "rb") as file:
        size = file.seek(0, os.SEEK_END)
        if size <= last:
            return 0
        file.seek(size - last - 1)
        file.readline()
        return file.tell()


class _Follower(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.last = int(options.get("lastbytes", LAST_BYTES))

    def initialOffset(self) -> dict:
        """Former versions count as read; of the file itself, the last bytes are still to come."""
        offset = {}
        for known, path in _versions(self.path).items():
            current = os.path.basename(path) == os.path.basename(self.path)
            offset[known] = min(_start(path, self.last), _whole_lines(path)) if current else _whole_lines(path)
        return {"files": json.dumps(offset, sort_keys=True)}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({known: _whole_lines(path) for known, path in _versions(self.path).items()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        paths = _versions(self.path)
        out = []
        for known, until in now.items():
            at = before.get(known, 0)
            # A file that is shorter than what was read of it was cut, and has begun anew.
            at = 0 if until < at else at
            path = paths.get(known, self.path)
            out += [_Range(path, known, a, min(a + SPLIT_BYTES, until)) for a in range(at, until, SPLIT_BYTES)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        path = partition.path
        if identity(path) != partition.identity:
            # Renamed since this batch was planned.
            path = _versions(self.path).get(partition.identity)
            if path is None:
                raise FileNotFoundError(f"{partition.path} was replaced before it was read, and its former version is gone")
        for lines in _lines(path, partition.start, partition.end):
            yield pa.RecordBatch.from_arrays([pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())], ["value"])


def _lines(path: str, start: int, end: int) -> Iterator[list[bytes]]:
    with open(path, "rb") as file:
        if start:
            file.seek(start - 1)
            file.readline()
        at = file.tell()
        while at < end:
            lines, size = [], 0
            while at < end and size < _READ_BYTES:
                line = file.readline()
                if not line:
                    break
                at += len(line)
                size += len(line)
                lines.append(line.rstrip(b"\n").removesuffix(b"\r"))
            if not lines:
                return
            yield lines


class FollowedFile(DataSource):
    """Lines of one file as it grows. Options: ``path``, ``lastBytes``."""

    @classmethod
    def name(cls) -> str:
        return "loglake_followed_file"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Follower(self.options)


def follow_file(spark: SparkSession, path: str, last_bytes: int = LAST_BYTES) -> DataFrame:
    """A stream of the lines of a file: those in its last bytes, then every line that is appended, each once.

    With a checkpoint, a stream that starts again goes on where it ended; rotated versions
    (``name.1`` and so on) are read as far as they were not.
    """
    spark.dataSource.register(FollowedFile)
    return spark.readStream.format(FollowedFile.name()).option("path", path).option("lastBytes", str(last_bytes)).load()
