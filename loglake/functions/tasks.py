"""Functions that run inside Python tasks, over Arrow batches.

They are shipped with the job by value, so workers need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT_SCHEMA = "source_file string, format string"


def first_formats(batches: Iterator[pa.RecordBatch], limit: int, fallback: str) -> Iterator[pa.RecordBatch]:
    """The format of each file a task scans: that of the first line, among the first ``limit``, that has one.

    Reading stops with the first lines of a task's last file; a task that scans one file reads no more than those.
    """
    seen: dict[str, list] = {}
    for batch in batches:
        for file, name in zip(batch.column("source_file").to_pylist(), batch.column("format").to_pylist(), strict=True):
            state = seen.setdefault(file, [0, None])
            if state[0] < limit:
                state[0] += 1
                state[1] = state[1] or name
        if len(seen) == 1 and next(iter(seen.values()))[0] >= limit:
            break
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.string()), pa.array([name or fallback for _, name in seen.values()], pa.string())],
        ["source_file", "format"],
    )


FRAGMENT_SCHEMA = (
    "thread string, start bigint, finish bigint, entries bigint, has_error boolean, "
    "names array<string>, task int, seq bigint, edge boolean"
)
FRAGMENT_COLUMNS = [part.split()[0] for part in FRAGMENT_SCHEMA.split(", ")]


class _Fragment:
    """A run of entries of one thread with no long gap, as far as one task saw it."""

    __slots__ = ("thread", "start", "finish", "entries", "has_error", "names", "last")

    def __init__(self, thread, start, finish, entries, has_error, names, last):
        self.thread, self.start, self.finish = thread, start, finish
        self.entries, self.has_error, self.names, self.last = entries, has_error, names, last

    def extend(self, other: "_Fragment", keep: int) -> None:
        """Append what follows; its first name is new unless this run ended with it."""
        follow = other.names[1:] if other.names[0] == self.last else other.names
        self.names = (self.names + follow)[:keep]
        self.finish, self.last = other.finish, other.last
        self.entries += other.entries
        self.has_error |= other.has_error


def _codes(column: pa.Array) -> np.ndarray:
    """Equal integers for equal values, null being a value of its own."""
    encoded = column.dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def fold_sessions(
    batches: Iterator[pa.RecordBatch], window_millis: int, keep: int
) -> Iterator[pa.RecordBatch]:
    """Fragments of entries sorted by ``(thread, t, ...)``: one pass, constant memory.

    Rows are ``(thread, t, is_error, name)`` with ``t`` in microseconds. A fragment ends
    where the thread changes or the gap exceeds the window (in whole milliseconds); its
    ``names`` are the first ``keep`` names after dropping consecutive repeats. The first
    and the last fragment of a task may go on in its neighbours: they are ``edge``.
    """
    task = TaskContext.get().partitionId()
    open_run: _Fragment | None = None
    seq = 0

    def emit(thread, start, finish, entries, has_error, names, last: bool = False) -> pa.RecordBatch:
        nonlocal seq
        n = len(start)
        number = np.arange(seq, seq + n)
        seq += n
        return pa.RecordBatch.from_arrays(
            [
                thread,
                pa.array(start, pa.int64()),
                pa.array(finish, pa.int64()),
                pa.array(entries, pa.int64()),
                pa.array(has_error, pa.bool_()),
                names,
                pa.array(np.full(n, task), pa.int32()),
                pa.array(number, pa.int64()),
                pa.array((number == 0) | last, pa.bool_()),
            ],
            names=FRAGMENT_COLUMNS,
        )

    def emit_one(run: _Fragment, last: bool = False) -> pa.RecordBatch:
        names = pa.array([run.names], pa.list_(pa.string()))
        thread = pa.array([run.thread], pa.string())
        return emit(thread, [run.start], [run.finish], [run.entries], [run.has_error], names, last)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        thread, name = batch.column("thread"), batch.column("name")
        t = batch.column("t").to_numpy(zero_copy_only=False)
        error = batch.column("is_error").to_numpy(zero_copy_only=False)
        thread_code, name_code = _codes(thread), _codes(name)

        new_run = np.ones(len(t), bool)
        new_run[1:] = (thread_code[1:] != thread_code[:-1]) | (np.diff(t) // 1000 > window_millis)
        new_name = new_run.copy()
        new_name[1:] |= name_code[1:] != name_code[:-1]

        starts = np.flatnonzero(new_run)
        ends = np.append(starts[1:], len(t))
        has_error = np.logical_or.reduceat(error, starts)
        # Rows that bring a new name, as far as their run still shows names.
        changes = np.flatnonzero(new_name)
        run_of_change = np.searchsorted(starts, changes, side="right") - 1
        rank = np.arange(len(changes)) - np.searchsorted(changes, starts)[run_of_change]
        changes, run_of_change = changes[rank < keep], run_of_change[rank < keep]
        names_until = np.searchsorted(run_of_change, np.arange(len(starts) + 1))

        def single(i: int) -> _Fragment:
            shown = changes[names_until[i] : names_until[i + 1]]
            return _Fragment(
                thread[int(starts[i])].as_py(),
                int(t[starts[i]]),
                int(t[ends[i] - 1]),
                int(ends[i] - starts[i]),
                bool(has_error[i]),
                name.take(pa.array(shown)).to_pylist(),
                name[int(ends[i]) - 1].as_py(),
            )

        lo, hi = 0, len(starts) - 1
        if open_run is not None:
            first = single(0)
            if open_run.thread == first.thread and (first.start - open_run.finish) // 1000 <= window_millis:
                open_run.extend(first, keep)
                lo = 1
                if hi == 0:
                    continue
            yield emit_one(open_run)
        if lo < hi:
            inner = changes[names_until[lo] : names_until[hi]]
            offsets = pa.array(names_until[lo : hi + 1] - names_until[lo], pa.int32())
            yield emit(
                thread.take(pa.array(starts[lo:hi])),
                t[starts[lo:hi]],
                t[ends[lo:hi] - 1],
                ends[lo:hi] - starts[lo:hi],
                has_error[lo:hi],
                pa.ListArray.from_arrays(offsets, name.take(pa.array(inner))),
            )
        open_run = single(hi)
    if open_run is not None:
        yield emit_one(open_run, last=True)
