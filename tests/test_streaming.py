from datetime import datetime, timedelta

import pytest

from loglake.operators.flows import flow_sessions
from loglake.operators.stats import timeline
from loglake.streaming import (
    Tail,
    end_marks,
    flow_sessions_stream,
    follow_file,
    mark_end,
    tail_filter,
    tail_stream,
    timeline_stream,
)

LINES = [
    "2023-01-01 ERROR Boom", "2023-01-01 INFO boom ok", "2023-01-01 DEBUG boom", "boom without level", "2023-01-01 WARN other",
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.log").write_text("\n".join(LINES) + "\n")
    return str(tmp_path / "in")


def test_tail_filter(spark):
    df = spark.createDataFrame([(line,) for line in LINES], "value string")
    assert {r.value for r in tail_filter(df, "info", "BOOM").collect()} == set(LINES[:2])
    assert tail_filter(df, text="boom").count() == 4
    assert tail_filter(df).count() == 5
    shown = tail_filter(df, "ERROR", terms=["Boom"]).first()
    assert (shown.level, shown.shown) == ("ERROR", "2023-01-01 ERROR «Boom»")


def test_tail_follows_new_files(spark, folder, tmp_path):
    tail = Tail("tail_test")
    assert not tail.is_running
    stream = tail_filter(tail_stream(spark, folder), "INFO", "boom")
    query = tail.start(stream, "memory")
    query.processAllAvailable()
    assert tail.is_running and spark.table("tail_test").count() == 2
    (tmp_path / "in" / "two.log").write_text("late ERROR boom\n")
    query.processAllAvailable()
    assert spark.table("tail_test").count() == 3
    replaced = tail.start(stream, "memory")
    assert not query.isActive and replaced.isActive
    tail.stop()
    assert not tail.is_running
    tail.stop()


@pytest.fixture
def stored(spark, entries, tmp_path):
    t0 = datetime(2025, 3, 3, 9, 0)
    minutes = [0, 1, 2, 65, 66, 130, 131, 131, 500]
    df = entries(*[dict(ts=t0 + timedelta(minutes=m), thread=f"t{i % 2}", level="ERROR" if i == 3 else "INFO") for i, m in enumerate(minutes)])
    path = str(tmp_path / "entries")
    df.write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def _rows(spark, make, tmp_path):
    """All rows of a stream, the open ones after the end mark in a second run."""
    marks, rows = str(tmp_path / "marks"), str(tmp_path / "rows")
    stream = make(end_marks(spark, marks))
    counts = []
    for _ in range(2):
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True).start(rows)
        )
        query.awaitTermination()
        counts.append(spark.read.schema(stream.schema).parquet(rows).count())
        mark_end(spark, marks)
    assert counts[0] < counts[1]
    return {tuple(r) for r in spark.read.schema(stream.schema).parquet(rows).collect()}


@pytest.mark.parametrize("interval, level", [("1h", None), ("45m", "INFO")])
def test_timeline_stream_equals_batch(spark, stored, tmp_path, interval, level):
    df, stream = stored
    batch = timeline(df, interval, level).where("n > 0").select("bucket", "n").collect()
    start = datetime(2025, 3, 3, 9)
    got = _rows(spark, lambda marks: timeline_stream(stream, interval, level, start=start, marks=marks), tmp_path)
    assert got == {tuple(r) for r in batch}


def test_flow_sessions_stream_equals_batch(spark, stored, tmp_path):
    df, stream = stored
    batch = flow_sessions(df, "5m").select("thread", "start_ts", "end_ts", "n_entries", "has_error")
    got = _rows(spark, lambda marks: flow_sessions_stream(stream, "5m", marks=marks), tmp_path)
    assert got == {tuple(r) for r in batch.collect()}


@pytest.fixture
def followed(spark, tmp_path):
    """Run a follower over what is there now, and give all lines it has shown so far."""
    log, out, state = tmp_path / "app.log", tmp_path / "out", tmp_path / "state"

    def run(last=4096):
        query = (
            follow_file(spark, str(log), last).writeStream.format("parquet").option("path", str(out))
            .option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return [r.value for r in spark.read.schema("value string").parquet(str(out)).collect()]

    return log, run


def append(file, text):
    with open(file, "a", newline="") as f:
        f.write(text)


def test_appended_lines_appear_once(followed):
    log, run = followed
    append(log, "one\ntwo\r\nhal")
    assert sorted(run()) == ["one", "two"]
    assert sorted(run()) == ["one", "two"]
    append(log, "f\nfour\n")
    assert sorted(run()) == ["four", "half", "one", "two"]
    append(log, "".join(f"line {i}\n" for i in range(5000)))
    append(log, "é" * 10)
    shown = run()
    assert len(shown) == 5004 and len(set(shown)) == 5004
    append(log, "\n")
    assert [x for x in run() if x.startswith("é")] == ["é" * 10]


def test_only_the_last_bytes_of_what_was_there(followed):
    log, run = followed
    append(log, "".join(f"{i:09d}\n" for i in range(1000)))
    assert sorted(run(last=95)) == [f"{i:09d}" for i in range(991, 1000)]
    append(log, "next\n")
    assert sorted(run(last=95))[-1] == "next" and len(run(last=95)) == 10


def test_rotation_loses_and_repeats_nothing(followed):
    log, run = followed
    append(log, "a1\na2\n")
    assert sorted(run()) == ["a1", "a2"]
    append(log, "a3\n")
    log.rename(log.with_name("app.log.1"))
    append(log, "b1\n")
    log.with_name("app.log.1").rename(log.with_name("app.log.2"))
    log.rename(log.with_name("app.log.1"))
    append(log, "c1\nc2\nc")
    assert sorted(run()) == ["a1", "a2", "a3", "b1", "c1", "c2"]
    append(log.with_name("app.log.1"), "b2\n")  # written late, through a handle still open
    append(log, "3\n")
    assert sorted(run()) == ["a1", "a2", "a3", "b1", "b2", "c1", "c2", "c3"]
    log.write_text("d1\n")  # cut and begun anew
    assert sorted(run())[-1] == "d1" and len(run()) == 9


def test_a_file_that_comes_later(followed):
    log, run = followed
    append(log.with_name("app.log.0"), "old\n")
    assert run() == []
    append(log, "first\n")
    assert run() == ["first"]


def test_long_lines_across_splits(spark, tmp_path, monkeypatch):
    from loglake.streaming import follow

    file = tmp_path / "x.log"
    lines = [b"x" * (i * 37 % 100) for i in range(200)]
    file.write_bytes(b"\n".join(lines) + b"\n")
    size = file.stat().st_size
    for split in (1, 7, 64, 1000, size):
        found = [x for a in range(0, size, split) for some in follow._lines(str(file), a, min(a + split, size)) for x in some]
        assert found == lines
