import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(__file__)]

from loglake.model import LOG_COLUMNS, LOG_SCHEMA, SEVERITY  # noqa: E402
from loglake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "loglake-tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def entries(spark):
    """Build entries from dicts; fields left out are filled in."""

    def make(*rows):
        full = []
        for i, row in enumerate(rows, start=1):
            row = {
                "source_file": "app.log", "line_number": i, "ts": None, "level": "INFO", "logger": "com.example.App",
                "thread": "main", "message": "m", "stack_trace": None, **row,
            }
            row.setdefault("raw", f"raw {row['line_number']}")
            row["severity"] = SEVERITY[row["level"]]
            full.append(tuple(row[c] for c in LOG_COLUMNS))
        return spark.createDataFrame(full, LOG_SCHEMA)

    return make


@pytest.fixture
def parse(spark):
    """Parse a list of lines as one file."""
    from loglake.sources import lines_of, parse_lines

    def run(lines, format, pattern=None, stacks=True):
        numbered = spark.createDataFrame(
            [("f", i, line) for i, line in enumerate(lines, start=1)],
            "source_file string, line_number bigint, value string",
        )
        parsed = parse_lines(lines_of(numbered), format, pattern, stacks)
        return parsed.orderBy("line_number").collect()

    return run
