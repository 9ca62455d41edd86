import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from loglake.plans.report import executive_report, write_report
from loglake.sinks import (
    assign_parts,
    export_logs,
    export_stacks,
    merge_files,
    merge_folder,
    split_by_day,
    split_by_level,
    split_by_size,
)
from loglake.sources import lines_of, read_lines

T0 = datetime(2025, 3, 3, 9, 0)


def text_of(path):
    """Lines of a written folder, its files in name order."""
    return [line for part in sorted(Path(path).glob("part-*")) for line in part.read_text().splitlines()]


@pytest.fixture
def three(entries):
    return entries(
        dict(ts=T0, level="ERROR", message='say "a, b"', stack_trace="at A\nat B", raw="r1"),
        dict(ts=T0 + timedelta(days=1, microseconds=500_000), message="a|b <c>", raw="r2", logger=None),
        dict(ts=None, message=None, raw="r3", thread=None),
    )


def test_split_by_day(three, tmp_path):
    out = split_by_day(three, str(tmp_path / "d"))
    assert text_of(f"{out}/day=2025-03-03") == ["r1", "at A", "at B"]
    assert text_of(f"{out}/day=2025-03-04") == ["r2"]
    assert len(list(Path(out).glob("day=*"))) == 2
    bare = split_by_day(three, str(tmp_path / "h"), header_only=True)
    assert text_of(f"{bare}/day=2025-03-03") == ["r1"]


def test_split_by_level(three, tmp_path):
    out = split_by_level(three, str(tmp_path / "l"))
    assert text_of(f"{out}/level=error") == ["r1", "at A", "at B"]
    assert text_of(f"{out}/level=info") == ["r2", "r3"]


def _next_fit(sizes, limit):
    parts, part, used = [], 0, 0
    for size in sizes:
        if part == 0 or (used + size > limit and used > 0):
            part, used = part + 1, 0
        used += size
        parts.append(part)
    return parts


@pytest.mark.parametrize("limit", [1, 16, 50, 333, 100_000])
def test_parts_are_filled_like_a_loop_would(spark, limit):
    rnd = random.Random(limit)
    texts = {name: ["é" * rnd.choice([0, 1, 5, 7, 30, 60]) for _ in range(n)] for name, n in (("a", 900), ("b", 70), ("c", 1))}
    rows = [(name, i, text) for name, lines in texts.items() for i, text in enumerate(lines, 1)]
    rnd.shuffle(rows)
    lines = lines_of(spark.createDataFrame(rows, "source_file string, line_number bigint, value string"))
    got = {(r.source_file, r.pos): (r.value, r.part) for r in assign_parts(lines, limit).collect()}
    for name, file_lines in texts.items():
        parts = _next_fit([len(t.encode()) + 1 for t in file_lines], limit)
        assert [got[name, i] for i in range(1, len(file_lines) + 1)] == list(zip(file_lines, parts))


def test_split_by_size_of_a_file_in_many_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 13) for i in range(200)]
    file = tmp_path / "app.log"
    file.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert read_lines(spark, str(file)).select("block").distinct().count() > 5
        out = split_by_size(spark, str(file), "250B", str(tmp_path / "parts"))
        even = split_by_size(spark, str(file), "250B", str(tmp_path / "even"), exact=False)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parts = _next_fit([len(line) + 1 for line in lines], 250)
    for part in range(1, max(parts) + 1):
        assert text_of(f"{out}/part={part}") == [line for line, p in zip(lines, parts) if p == part]
    folders = sorted(Path(even).glob("part=*"), key=lambda p: int(p.name[5:]))
    assert [line for folder in folders for line in text_of(folder)] == lines


def test_line_longer_than_a_part_stands_alone(spark, tmp_path):
    file = tmp_path / "uneven.log"
    file.write_text("ab\nabcdefgh\nabc\nabcdefghijklmnopqrs\na\nb\n")
    out = split_by_size(spark, str(file), 10, str(tmp_path / "p"))
    assert [text_of(f"{out}/part={i}") for i in range(1, 6)] == [
        ["ab"], ["abcdefgh"], ["abc"], ["abcdefghijklmnopqrs"], ["a", "b"],
    ]


def test_merge(spark, tmp_path):
    stamp = "2025-03-05 10:00:0{} [m] INFO a.B - {}".format
    (tmp_path / "b.log").write_text("\n".join([stamp(1, "one"), "\tat x", stamp(3, "three")]) + "\n")
    (tmp_path / "a.log").write_text("\n".join([stamp(2, "two"), stamp(4, "four")]) + "\n")
    (tmp_path / "c.txt").write_text("ignored\n")
    a, b, gone = (str(tmp_path / n) for n in ("a.log", "b.log", "gone.log"))
    first, second = (tmp_path / "b.log").read_text().splitlines(), (tmp_path / "a.log").read_text().splitlines()
    out = merge_files(spark, [b, gone, a], str(tmp_path / "o1"))
    assert text_of(out) == first + second
    assert text_of(merge_folder(spark, str(tmp_path), str(tmp_path / "o2"))) == second + first
    assert text_of(merge_files(spark, [b, a], str(tmp_path / "o3"), "line")) == sorted(first + second)
    by_time = merge_files(spark, [a, b], str(tmp_path / "o4"), "timestamp")
    assert text_of(by_time) == [first[0], first[1], second[0], first[2], second[1]]
    with pytest.raises(ValueError):
        merge_files(spark, [gone], str(tmp_path / "o5"))


def test_exports(three, tmp_path):
    rows = [json.loads(line) for line in text_of_json(export_logs(three, "json", str(tmp_path / "j")))]
    assert rows[0] == {
        "line": 1, "timestamp": "2025-03-03T09:00", "level": "ERROR", "logger": "com.example.App", "thread": "main",
        "message": 'say "a, b"', "stackTrace": "at A\nat B",
    }
    assert rows[1]["timestamp"] == "2025-03-04T09:00:00.500" and "logger" not in rows[1]
    assert rows[2] == {"line": 3, "level": "INFO", "logger": "com.example.App"}
    assert text_of(export_logs(three, "csv", str(tmp_path / "c"))) == [
        "linha,timestamp,nivel,logger,thread,mensagem",
        '1,2025-03-03 09:00:00,ERROR,com.example.App,main,"say ""a, b"""',
        "2,2025-03-04 09:00:00,INFO,,main,a|b <c>",
        "3,,INFO,com.example.App,,",
    ]
    markdown = text_of(export_logs(three, "md", str(tmp_path / "m"), source="app.log"))
    assert markdown[2:4] == ["**Fonte:** app.log  ", "**Entradas:** 3"]
    assert markdown[-2:] == ["| 2 | 2025-03-04 09:00:00 | INFO |  | a\\|b <c> |", "| 3 |  | INFO | com.example.App |  |"]
    html = text_of(export_logs(three, "html", str(tmp_path / "h")))
    assert html[-1] == "</table></body></html>"
    assert '<td>a|b &lt;c&gt;</td></tr>' in html[-3] and '<div class="stack">at A' in html[4]
    assert html[0].endswith("<title>Log Report - </title>") and ".WARN { color: #fa0; }" in html[1]
    assert text_of(export_stacks(three, str(tmp_path / "s"))) == [
        "=== 2025-03-03 09:00:00 ERROR ===", 'say "a, b"', "at A", "at B", "",
    ]
    with pytest.raises(ValueError):
        export_logs(three, "xml", str(tmp_path / "x"))


def text_of_json(path):
    return [line for part in sorted(Path(path).glob("part-*.json")) for line in part.read_text().splitlines()]


def test_report(entries, tmp_path):
    df = entries(
        *[dict(ts=T0 + timedelta(minutes=m), level="ERROR", message=f"e|{'abc'[m]}") for m in range(3)],
        *[dict(ts=T0 + timedelta(hours=1, minutes=m)) for m in range(3)],
    )
    report = executive_report(df, generated_at=datetime(2025, 4, 1))
    rows = {(r.section, r.key): r.value for r in report.collect()}
    assert rows["summary", "total"] == "6" and rows["summary", "generated_at"] == "2025-04-01 00:00:00"
    assert rows["heatmap", "Seg 09"] == "█3" and rows["heatmap", "Ter 09"] == "."
    assert rows["heatmap_peak", "Seg 09:00"] == "3" and rows["timeline", "03/03 10:00"] == "3"
    markdown = text_of(write_report(report, str(tmp_path / "md")))
    assert markdown[0] == "# Executive Log Report" and "| e\\|a | 1 |" in markdown
    titles = [line for line in markdown if line.startswith("## ")]
    assert titles[0] == "## Summary" and titles[-1] == "## Temporal Heatmap"
    html = text_of(write_report(report, str(tmp_path / "html"), "html"))
    assert html[-1] == "</body></html>" and "<tr><td>e|a</td><td>1</td></tr>" in html
