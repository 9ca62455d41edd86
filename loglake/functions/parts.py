"""Filling parts up to a size, in order, over line lengths: functions that run inside Python tasks.

A part takes lines while their bytes sum to at most the limit; a longer line gets a part of its own. Where a part
begins depends on all parts before it, so a stretch of lines cannot be cut alone. It can be described alone: a
:class:`JumpTable` says, for every line a part might be full before, how many parts begin from there to the end and how many
bytes the last one holds. Two tables in sequence make one, so the chain is followed over tables, not lines.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUNS_SCHEMA = "source_file string, block bigint, pos bigint, bytes binary"
TABLES_SCHEMA = "source_file string, block bigint, lines bigint, total bigint, table binary"
GROUPS_SCHEMA = "source_file string, cluster bigint, total bigint, table binary"
ENTRIES_SCHEMA = "source_file string, cluster bigint, used bigint, parts bigint"
BLOCK_ENTRIES_SCHEMA = "source_file string, block bigint, used bigint, parts bigint"
_RUN_LINES = 4096


class JumpTable:
    """What a stretch of lines does to a part that holds some bytes already.

    ``ends`` are bytes from the stretch's start through each line the part might not take (it can be full no later than
    ``limit`` bytes in); ``parts`` and ``used`` are the parts that begin from that line on and the bytes of the last.
    A part that is full before none of them goes on past the stretch.
    """

    def __init__(self, limit: int, total: int, ends: np.ndarray, parts: np.ndarray, used: np.ndarray):
        self.limit, self.total, self.ends, self.parts, self.used = limit, total, ends, parts, used

    @classmethod
    def of_lines(cls, sizes: np.ndarray, limit: int) -> JumpTable:
        ends = np.cumsum(sizes, dtype=np.int64)
        n, total = len(ends), int(ends[-1]) if len(ends) else 0
        starts = ends - sizes
        following = np.maximum(np.searchsorted(ends, starts + limit, side="right"), np.arange(1, n + 1))
        parts, last, at = np.ones(n, np.int64), np.arange(n), following
        # Jumps of twice the length each round.
        while len(going := np.flatnonzero(at < n)):
            to = at[going]
            new_parts, new_last, new_at = parts[to], last[to], at[to]
            parts = parts.copy()
            last, at = last.copy(), at.copy()
            parts[going] += new_parts
            last[going], at[going] = new_last, new_at
        reach = int(np.searchsorted(starts, limit, side="right"))
        return cls(limit, total, ends[:reach], parts[:reach], (total - starts[last])[:reach])

    def after(self, used: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the open part and number of parts, past this stretch."""
        at = np.searchsorted(self.ends, self.limit - used, side="right")
        full = at < len(self.ends)
        where = np.where(full, at, 0)
        if not len(self.ends):
            return used + self.total, parts
        return np.where(full, self.used[where], used + self.total), np.where(full, parts + self.parts[where], parts)

    def then(self, other: JumpTable) -> JumpTable:
        """Both stretches as one."""
        used, parts = other.after(self.used, self.parts)
        starts = np.r_[0, other.ends[:-1]][: len(other.ends)]
        keep = int(np.searchsorted(starts, self.limit - self.total, side="right"))
        return JumpTable(
            self.limit, self.total + other.total, np.r_[self.ends, self.total + other.ends[:keep]],
            np.r_[parts, other.parts[:keep]], np.r_[used, other.used[:keep]],
        )

    def to_bytes(self) -> bytes:
        """Differences of sorted numbers, and numbers that repeat: both compress well."""
        columns = np.concatenate([np.diff(self.ends, prepend=0), self.parts, self.used])
        planes = np.ascontiguousarray(columns.view(np.uint8).reshape(-1, 8).T).tobytes()
        return len(columns).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")

    @classmethod
    def from_bytes(cls, limit: int, total: int, raw: bytes) -> JumpTable:
        n = int.from_bytes(raw[:8], "little")
        planes = pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
        columns = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(np.int64).ravel()
        steps, parts, used = np.split(columns, 3)
        return cls(limit, total, np.cumsum(steps), parts, used)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(name) for name in names]
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in columns)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields]
    )


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def pack_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line lengths of consecutive positions of a block as one value under the first position."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        pos = batch.column("pos").to_numpy(zero_copy_only=False)
        block = batch.column("block").to_numpy(zero_copy_only=False)
        sizes = batch.column("bytes").to_numpy(zero_copy_only=False).astype("<i4")
        cut = np.arange(n) % _RUN_LINES == 0
        cut[1:] |= (np.diff(pos) != 1) | (np.diff(block) != 0) | (np.diff(_codes(batch.column("source_file"))) != 0)
        starts = np.flatnonzero(cut)
        take = pa.array(starts)
        packed = [x.tobytes() for x in np.split(sizes, starts[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("source_file").take(take), batch.column("block").take(take), batch.column("pos").take(take), pa.array(packed)],
            ["source_file", "block", "pos", "bytes"],
        )


def block_tables(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The jump table of every block, from its runs in order: one block's lengths are held at a time."""
    for (file, block), runs in groupby(_rows(batches, ["source_file", "block", "pos", "bytes"]), key=itemgetter(0, 1)):
        sizes = np.concatenate([np.frombuffer(run[3], "<i4") for run in runs]).astype(np.int64)
        table = JumpTable.of_lines(sizes, limit)
        yield _batch([(file, block, len(sizes), table.total, table.to_bytes())], TABLES_SCHEMA)


def compose_tables(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """One table per cluster of consecutive blocks."""
    rows = _rows(batches, ["source_file", "cluster", "total", "table"])
    for (file, cluster), tables in groupby(rows, key=itemgetter(0, 1)):
        whole = None
        for _, _, total, raw in tables:
            table = JumpTable.from_bytes(limit, total, raw)
            whole = table if whole is None else whole.then(table)
        yield _batch([(file, cluster, whole.total, whole.to_bytes())], GROUPS_SCHEMA)


def walk_clusters(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The state each cluster of a file is entered with. A file begins as if a full part lay before it."""
    for file, tables in groupby(_rows(batches, ["source_file", "cluster", "total", "table"]), key=itemgetter(0)):
        used, parts = np.array([limit]), np.array([0])
        for _, cluster, total, raw in tables:
            yield _batch([(file, cluster, int(used[0]), int(parts[0]))], ENTRIES_SCHEMA)
            used, parts = JumpTable.from_bytes(limit, total, raw).after(used, parts)


def walk_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The state each block is entered with: rows of a cluster are its own state, then the tables of its blocks."""
    names = ["source_file", "cluster", "block", "used", "parts", "total", "table"]
    for (file, _), rows in groupby(_rows(batches, names), key=itemgetter(0, 1)):
        _, _, _, used, parts, _, _ = next(rows)
        state = np.array([used]), np.array([parts])
        out = []
        for _, _, block, _, _, total, raw in rows:
            out.append((file, block, int(state[0][0]), int(state[1][0])))
            state = JumpTable.from_bytes(limit, total, raw).after(*state)
        yield _batch(out, BLOCK_ENTRIES_SCHEMA)


PLACED_SCHEMA = "source_file string, block bigint, pos bigint, value string, part bigint"


def place_lines(batches: Iterator[pa.RecordBatch], limit: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """The part of every line; lines of a block come in order, with the state the block is entered with.

    Not exact, ``used`` counts all bytes before the block, and parts are cut at multiples of the limit.
    """
    at_block, used, part = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        block = batch.column("block").to_numpy(zero_copy_only=False)
        code = _codes(batch.column("source_file"))
        sizes = batch.column("bytes").to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.r_[True, (np.diff(block) != 0) | (np.diff(code) != 0)]
        edges = [*np.flatnonzero(cut).tolist(), n]
        numbers = np.empty(n, np.int64)
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            name = (batch.column("source_file")[first].as_py(), int(block[first]))
            if name != at_block:
                at_block = name
                used, part = batch.column("used")[first].as_py(), batch.column("parts")[first].as_py()
            until = np.cumsum(sizes[first:last])
            if not exact:
                numbers[first:last] = (used + until - sizes[first:last]) // limit + 1
                used += int(until[-1])
                continue
            at, done = 0, 0
            while at < len(until):
                to = int(np.searchsorted(until, done + limit - used, side="right"))
                if to <= at:
                    part, used = part + 1, 0
                    to = max(at + 1, int(np.searchsorted(until, done + limit, side="right")))
                numbers[first + at : first + to] = part
                used += int(until[to - 1]) - done
                at, done = to, int(until[to - 1])
        kept = [batch.column(c) for c in ("source_file", "block", "pos", "value")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers)], ["source_file", "block", "pos", "value", "part"])
