from datetime import datetime

import pytest

from loglake.functions.arguments import (
    datetime_argument,
    duration_millis,
    interval_seconds,
    level_expression,
    size_bytes,
    time_ago,
)
from loglake.model import level_name


@pytest.mark.parametrize(
    "text, millis", [("500ms", 500), ("2s", 2000), ("3", 3000), ("1m", 60_000), ("5min", 300_000), (" 1H ", 3_600_000), ("2d", 172_800_000)]
)
def test_durations(text, millis):
    assert duration_millis(text) == millis


@pytest.mark.parametrize("text", ["", "x", "1h30m", "-5s", "5 weeks"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        duration_millis(text)


def test_intervals():
    assert interval_seconds("15m") == 900
    assert interval_seconds("1h") == 3600
    assert interval_seconds("30s") == 30
    assert interval_seconds(15) == 900
    with pytest.raises(ValueError):
        interval_seconds("0m")
    with pytest.raises(ValueError):
        interval_seconds("10ms")


def test_sizes():
    assert [size_bytes(s) for s in ("16", "16B", "2kb", "3 MB", "1GB")] == [16, 16, 2048, 3 * 1024**2, 1024**3]
    for bad in ("0", "1.5MB", "MB", "1TB"):
        with pytest.raises(ValueError):
            size_bytes(bad)


def test_dates():
    assert datetime_argument("2025-03-05") == datetime(2025, 3, 5)
    assert datetime_argument("2025-03-05 10:15") == datetime(2025, 3, 5, 10, 15)
    assert datetime_argument("2025-03-05 10:15:30") == datetime(2025, 3, 5, 10, 15, 30)
    with pytest.raises(ValueError):
        datetime_argument("yesterday")
    assert time_ago("30m", datetime(2025, 1, 1)) == datetime(2024, 12, 31, 23, 30)
    assert time_ago(90, datetime(2025, 1, 1)) == datetime(2024, 12, 31, 22, 30)


def test_levels():
    assert level_expression("error") == ["ERROR"]
    assert level_expression("WARN+") == ["WARN", "ERROR", "FATAL"]
    assert level_expression(" ") is None
    assert [level_name(w) for w in ("warning", "severe", "Critical")] == ["WARN", "ERROR", "FATAL"]
    with pytest.raises(ValueError):
        level_name("loud")


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from loglake.session import shared_folder

    def session(master, **conf):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.replace(".", "_"), default)),
            sparkContext=SimpleNamespace(master=master),
        )

    assert shared_folder(session("spark://x", spark_checkpoint_dir="hdfs:/c/")) == "hdfs:/c"
    assert shared_folder(session("local[2]", spark_sql_warehouse_dir="file:/w")) == "file:/w"
    assert shared_folder(session("yarn", spark_sql_warehouse_dir="s3a://w/x")) == "s3a://w/x"
    for folder in ("file:/w", "/w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session("yarn", spark_sql_warehouse_dir=folder))
