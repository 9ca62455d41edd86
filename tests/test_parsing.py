import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loglake.sources import (
    file_formats,
    detect_formats,
    list_files,
    load_report,
    parse_lines,
    read_folder,
    read_glob,
    read_lines,
    read_logs,
    with_line_numbers,
)
from loglake.sources.events import events_as_logs, ordered_logs, render_lines, write_text_logs
from loglake.sources.text import blocks_are_few

LOGBACK = "2031-11-17 21:43:08.907 [press-4] ERROR org.orchard.Harvest - crate 17 is short"
LOG4J = "2031-11-17 21:43:08,907 ERROR [press-4] org.orchard.Harvest - crate 17 is short"
JSON = '{"timestamp":"2031-11-17T21:43:08","level":"ERROR","message":"crate 17 is short","logger":"org.orchard.Harvest","thread":"press-4","stackTrace":"at Scale.read"}'
NGINX = '172.30.8.19 - mila [17/Nov/2031:21:43:08 +0130] "PUT /crates/17 HTTP/2.0" 503 1187 "-" "orchard-sync/3.2"'
APACHE = '192.168.77.5 - - [17/Nov/2031:21:44:59 +0000] "HEAD /press/log HTTP/1.1" 410 - "-" "probe"'
APACHE_ERROR = "[Mon Nov 17 21:45:31.000777 2031] [error] [pid 8841] press stalled"


def test_logback_with_stack(parse):
    rows = parse([LOGBACK, "\tat org.orchard.Harvest.weigh(Harvest.java:88)", LOGBACK.replace("ERROR", "INFO ")], "logback")
    assert [(r.line_number, r.level, r.thread, r.logger, r.message) for r in rows] == [
        (1, "ERROR", "press-4", "org.orchard.Harvest", "crate 17 is short"), (3, "INFO", "press-4", "org.orchard.Harvest", "crate 17 is short"),
    ]
    assert rows[0].stack_trace == "\tat org.orchard.Harvest.weigh(Harvest.java:88)" and rows[1].stack_trace is None
    assert rows[0].ts == datetime(2031, 11, 17, 21, 43, 8, 907000) and rows[0].severity == 4
    assert rows[0].raw == LOGBACK


def test_stack_lines(parse):
    rows = parse(["lost", LOGBACK, "", "", "a", "", "b", LOGBACK, "", LOGBACK], "logback")
    assert [(r.line_number, r.stack_trace) for r in rows] == [(2, "a\n\nb"), (8, None), (10, None)]


def test_without_stacks(parse):
    rows = parse(["lost", LOGBACK, "at x", LOGBACK], "logback", stacks=False)
    assert [(r.line_number, r.stack_trace) for r in rows] == [(2, None), (4, None)]


def test_log4j(parse):
    (row,) = parse([LOG4J, "java.lang.IllegalStateException: x", "\tat A.b(A.java:3)"], "log4j")
    assert row.stack_trace == "java.lang.IllegalStateException: x\n\tat A.b(A.java:3)"
    assert (row.ts, row.level, row.thread) == (datetime(2031, 11, 17, 21, 43, 8, 907000), "ERROR", "press-4")


def test_logback_thread_may_span_words(parse):
    (row,) = parse(["2025-03-05 10:00:00 INFO c.A - retry WARN x.y: z"], "logback")
    assert (row.level, row.thread, row.logger, row.message) == ("WARN", "INFO c.A - retry", "x.y", "z")


@pytest.mark.parametrize(
    "text, ts",
    [
        ("2025-03-05 10:00:00", datetime(2025, 3, 5, 10)),
        ("2025-03-05T10:00:00.120", datetime(2025, 3, 5, 10, 0, 0, 120000)),
        ("2025-03-05T10:00:00,120", None),
        ("2025-03-05 10:00:00.1", None),
        ("2025-02-30 10:00:00", datetime(2025, 2, 28, 10)),
        ("2025-13-01 10:00:00", None),
    ],
)
def test_logback_times(parse, text, ts):
    (row,) = parse([f"{text} [main] INFO a.B - m"], "logback")
    assert row.ts == ts


def test_json(parse):
    rows = parse(
        [
            JSON, "{invalid", "",
            '{"@timestamp":"2025-03-05T10:00:00.5+02:00","level":null,"severity":"warning","msg":{"a":1},"error":{"stack_trace":"at X"}}',
            '{"message":"{\\"a\\":1}","ts":"2025-03-05T10:00Z","lvl":"fatal"}',
        ],
        "json",
    )
    assert [(r.line_number, r.ts, r.level, r.message, r.stack_trace) for r in rows] == [
        (1, datetime(2031, 11, 17, 21, 43, 8), "ERROR", "crate 17 is short", "at Scale.read"),
        (4, datetime(2025, 3, 5, 10, 0, 0, 500000), "WARN", "", "at X"),
        (5, datetime(2025, 3, 5, 10), "FATAL", '{"a":1}', None),
    ]


def test_nginx(parse):
    rows = parse([NGINX, "noise", NGINX.replace(" 503 ", " 301 ")], "nginx")
    assert [(r.level, r.logger, r.thread, r.message) for r in rows] == [
        ("ERROR", "nginx", "172.30.8.19", "PUT /crates/17 HTTP/2.0 [503] 1187 bytes - orchard-sync/3.2"),
        ("INFO", "nginx", "172.30.8.19", "PUT /crates/17 HTTP/2.0 [301] 1187 bytes - orchard-sync/3.2"),
    ]
    assert rows[0].ts == datetime(2031, 11, 17, 21, 43, 8)


def test_apache(parse):
    access, error = parse([APACHE, APACHE_ERROR, "[core:error] x"], "apache")
    assert (access.level, access.logger, access.message) == ("WARN", "apache", "HEAD /press/log HTTP/1.1 [410] -")
    assert (error.level, error.logger, error.thread, error.message, error.ts) == (
        "ERROR", "apache-error", None, "press stalled", None,
    )


def test_custom(parse):
    template = "[{data}] ({thread}) {nivel} {classe} - {mensagem}"
    (row,) = parse(["[2031-11-17 21:46:00] (press-4) ERROR org.orchard.Scale - empty tray", "noise"], "personalizado", template)
    assert (row.ts, row.level, row.logger, row.thread, row.message) == (
        datetime(2031, 11, 17, 21, 46), "ERROR", "org.orchard.Scale", "press-4", "empty tray",
    )
    (row,) = parse(["a.B: hello"], "custom", "{logger}: {mensagem}")
    assert (row.level, row.ts, row.logger, row.message) == ("INFO", None, "a.B", "hello")
    assert parse(["anything"], "custom") == []
    with pytest.raises(ValueError):
        parse(["x"], "custom", "{thread} {thread}")
    with pytest.raises(ValueError):
        parse(["x"], "syslog")


@pytest.mark.parametrize(
    "lines, format",
    [
        (["", JSON], "json"), (["?", LOG4J], "log4j"), ([LOGBACK], "logback"), ([NGINX], "nginx"), ([APACHE], "apache"),
        ([APACHE_ERROR], "apache"), (["not a known log format"], "logback"), (["x"] * 20 + [JSON], "logback"), (['{"other":1}', NGINX], "nginx"),
        (['{"level":null}'], "json"),
    ],
)
def test_detection(spark, lines, format):
    numbered = spark.createDataFrame(
        [("f", i, line) for i, line in enumerate(lines, 1)], "source_file string, line_number bigint, value string"
    )
    assert detect_formats(numbered).first()["format"] == format


# --- files -----------------------------------------------------------------------


def _log(n, tag=""):
    """Entries whose stack traces have zero to six lines of uneven length."""
    lines = [f"preamble {tag}", "more"]
    for i in range(n):
        lines.append(f"2025-03-05 10:{i // 60 % 60:02d}:{i % 60:02d}.000 [t-{i % 3}] {'ERROR' if i % 7 == 0 else 'INFO'} a.b.C{i % 5} - message {tag}{i}")
        lines += [f"\tat frame {i} {j} " + "x" * (i * j % 40) for j in range(i % 7)]
        if i % 11 == 0:
            lines.append("")
    return lines


def _expected(lines):
    entries = []
    for number, line in enumerate(lines, 1):
        if line.startswith("2025-"):
            entries.append([number, line, []])
        elif entries:
            entries[-1][2].append(line)
    result = []
    for number, line, stack in entries:
        text = "\n".join(stack).lstrip("\n")
        result.append((number, line, text or None))
    return result


@pytest.fixture
def split_bytes(spark):
    """Cut files into splits of a given size for one test."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism"]
    before = {k: spark.conf.get(k) for k in keys}

    def use(size):
        for key, value in zip(keys, [str(size), "1", "1"]):
            spark.conf.set(key, value)

    yield use
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
def test_any_split_gives_the_same_entries(spark, tmp_path, split_bytes, size):
    logs = {"a.log": _log(60, "a"), "b.log": _log(25, "b"), "c.log": ["only", "noise"] * 50}
    for name, lines in logs.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    split_bytes(size)
    lines = read_lines(spark, str(tmp_path))
    assert blocks_are_few(lines)
    if size < 1000:
        assert lines.select("source_file", "block").distinct().count() > 20
    numbered = {(r.source_file.rsplit("/", 1)[-1], r.line_number, r.value) for r in with_line_numbers(lines).collect()}
    assert numbered == {(name, i, line) for name, ls in logs.items() for i, line in enumerate(ls, 1)}
    for few in (True, False):
        got = parse_lines(lines, "logback", few_blocks=few).collect()
        found = sorted((r.source_file.rsplit("/", 1)[-1], r.line_number, r.raw, r.stack_trace or "") for r in got)
        assert found == sorted((n, i, raw, s or "") for n in ("a.log", "b.log") for i, raw, s in _expected(logs[n]))


def test_one_header_and_many_blocks(spark, tmp_path, split_bytes):
    follow = [f"\tat line {i} " + "x" * (i % 37) for i in range(3000)]
    (tmp_path / "a.log").write_text("\n".join(["noise", LOGBACK, "", *follow, LOGBACK, "last"]) + "\n")
    split_bytes(700)
    lines = read_lines(spark, str(tmp_path))
    assert lines.select("block").distinct().count() > 100
    for few in (True, False):
        rows = sorted(parse_lines(lines, "logback", few_blocks=few).collect(), key=lambda r: r.line_number)
        assert [r.line_number for r in rows] == [2, 3004]
        assert rows[0].stack_trace == "\n".join(follow) and rows[1].stack_trace == "last"


def test_folder_glob_and_mixed_formats(spark, tmp_path):
    (tmp_path / "a.log").write_text(f"{LOGBACK}\n\tat x\n")
    (tmp_path / "b [1].log").write_text(f"{JSON}\n{JSON}\n")
    (tmp_path / "c.txt").write_text(f"{NGINX}\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d %41.log").write_text(f"{APACHE}\n")
    (tmp_path / "empty.log").write_text("")
    folder = str(tmp_path)
    count = lambda df: dict(df.groupBy("logger").count().collect())
    assert count(read_folder(spark, folder)) == {"org.orchard.Harvest": 3}
    assert count(read_folder(spark, folder, "txt")) == {"nginx": 1}
    assert count(read_glob(spark, f"{folder}/*.txt")) == {"nginx": 1}
    assert count(read_glob(spark, f"{folder}/**/*.log")) == {"org.orchard.Harvest": 3, "apache": 1}
    assert count(read_logs(spark, f"{folder}/a.log", "LOGBACK")) == {"org.orchard.Harvest": 1}
    found = file_formats(spark, folder, recursiveFileLookup="true").collect()
    formats = {r.source_file.rsplit("/", 1)[-1]: r.format for r in found}
    assert len(found) == 4
    assert formats["a.log"] == "logback" and formats["c.txt"] == "nginx" and formats["d%20%2541.log"] == "apache"
    with pytest.raises(Exception):
        read_folder(spark, folder, "nothing").count()


def test_folder_loses_no_file(spark, tmp_path):
    (tmp_path / "a.log").write_text(f"{LOGBACK}\n")
    (tmp_path / "b %41 {x}.log").write_text(f"{LOGBACK}\n" * 50_000)
    (tmp_path / "day=1").mkdir()
    (tmp_path / "day=1" / "c.log").write_text(f"{LOGBACK}\n")
    assert read_folder(spark, str(tmp_path)).count() == 50_001
    assert read_logs(spark, str(tmp_path), "logback").count() == 50_001


def test_hidden_names_are_read(spark, tmp_path, split_bytes):
    names = ["a.log", "_h.log", ".d.log", "_p=1.log", "b [1] %41.log"]
    for i, name in enumerate(names):
        (tmp_path / name).write_text(f"{LOGBACK}\r\n\tat line {i}\n" * 5 + "é end without a mark")
    deep = tmp_path / "prod" / "_old" / "prod"
    deep.mkdir(parents=True)
    (deep / "_z.log").write_text(f"{LOGBACK}\n")
    (tmp_path / "day=1").mkdir()
    (tmp_path / "day=1" / ".c.log").write_text(f"{LOGBACK}\n")
    folder = str(tmp_path)
    split_bytes(64)
    for entries in (
        read_folder(spark, folder), read_logs(spark, folder), read_glob(spark, f"{folder}/*.log"),
        read_logs(spark, [f"{folder}/{name}" if "[" not in name else f"{folder}/b*.log" for name in names], "logback"),
    ):
        rows = entries.collect()
        assert len(rows) == 25
        by_file = {}
        for r in rows:
            by_file.setdefault(r.source_file, []).append((r.line_number, r.stack_trace))
        assert len(by_file) == 5
        for file, found in by_file.items():
            i = [k for k, n in enumerate(names) if file.endswith(n.replace("%", "%25").replace(" ", "%20").replace("[", "%5B").replace("]", "%5D"))]
            stack = f"\tat line {i[0]}"
            assert sorted(found) == [(1, stack), (3, stack), (5, stack), (7, stack), (9, stack + "\né end without a mark")]
    assert read_glob(spark, f"{folder}/**/*.log").count() == 27
    assert read_glob(spark, f"{folder}/**/prod/*.log").count() == 1
    assert read_glob(spark, f"{folder}/**/prod/**/*.log").count() == 1
    assert read_lines(spark, f"{folder}/_h.log").count() == 11
    with pytest.raises(ValueError):
        read_glob(spark, f"{folder}/*.nothing")


def test_long_first_line_decides_the_format(spark, tmp_path):
    message = "m" * 70_000
    (tmp_path / "a.log").write_text('{"message": "%s", "level": "ERROR"}\n' % message)
    (tmp_path / "b.log").write_text("\n" * 19 + f"{NGINX}\n")
    (tmp_path / "c.log").write_text("\n" * 20 + f"{NGINX}\n")
    (tmp_path / "_d.log").write_text("x" * 3_000_000 + f"\n{NGINX}\n")
    formats = {r.source_file.rsplit("/", 1)[-1]: r.format for r in file_formats(spark, str(tmp_path)).collect()}
    assert formats == {"a.log": "json", "b.log": "nginx", "c.log": "logback", "_d.log": "nginx"}
    entries = read_folder(spark, str(tmp_path)).collect()
    assert sorted(len(r.message) for r in entries if r.logger is None) == [70_000] and len(entries) == 3


def test_load_report(spark, tmp_path):
    (tmp_path / "a.log").write_text(f"{LOGBACK}\n\tat x\n")
    (tmp_path / "b.log").write_text("noise\n")
    lines = read_lines(spark, str(tmp_path))
    rows = load_report(lines, format="logback").collect()
    assert [(r.format, r.lines, r["entries"]) for r in rows] == [("logback", 2, 1), ("logback", 1, 0)]
    (tmp_path / "c.log").write_text(f'{JSON}\n{{"a": 1}}\nbroken {{\n\n')
    (tmp_path / "_d.log").write_text(f"{NGINX}\nno line of it\n{NGINX}\n")
    lines = read_lines(spark, str(tmp_path))
    rows = load_report(lines, file_formats(spark, str(tmp_path))).collect()
    found = {r.source_file.rsplit("/", 1)[-1]: (r.format, r.lines, r["entries"]) for r in rows}
    assert found == {"a.log": ("logback", 2, 1), "b.log": ("logback", 1, 0), "c.log": ("json", 4, 2), "_d.log": ("nginx", 3, 2)}
    read = {r.source_file.rsplit("/", 1)[-1]: r["count"] for r in read_logs(spark, str(tmp_path)).groupBy("source_file").count().collect()}
    assert read == {name: n for name, (_, _, n) in found.items() if n}


def test_text_takes_one_shuffle(spark, tmp_path):
    (tmp_path / "a.log").write_text(f"{LOGBACK}\n")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    lines = read_lines(spark, str(tmp_path))
    # Two exchanges build the block table (once for each branch, reused when run); one brings the lines a block starts
    # with together, one moves lines to their entry. None moves text for headers only.
    assert plan(parse_lines(lines, "logback", few_blocks=True)).count("Exchange hashpartitioning") == 6
    assert plan(parse_lines(lines, "logback", stacks=False, few_blocks=True)).count("Exchange hashpartitioning") == 2
    assert plan(parse_lines(lines, "nginx", few_blocks=True)).count("Exchange hashpartitioning") == 2


def test_events_are_put_in_order_before_anything_is_derived_from_them(spark, tmp_path):
    """Range sampling runs its input: below the exchange there is to be nothing but the table."""
    ids = [(7 * i) % 500 for i in range(500)]
    rows = [(i, datetime(2024, 1, 1, 0, i // 60, i % 60), i % 7, "error" if i % 4 == 0 else "view", 1.0, f'{{"k": {i}}}') for i in ids]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    ordered = ordered_logs(spark, str(tmp_path))
    plan = ordered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("get_json_object") < plan.index("RepartitionByExpression")
    paths = {kind: f"{tmp_path}/{kind}" for kind in ("logback", "json", "nginx")}
    write_text_logs(ordered, paths)
    for kind, path in paths.items():
        expected = [r.value for r in render_lines(events_as_logs(spark, str(tmp_path)), kind).orderBy("line_number").collect()]
        files = sorted(f for f in os.listdir(path) if f.endswith(".txt"))
        written = "".join(open(f"{path}/{f}").read() for f in files)
        assert written == "".join(f"{text}\n" for text in expected)
