import pytest
from pyspark.sql import functions as F

from loglake.functions import expressions as ex
from loglake.model import normalize_level


@pytest.fixture
def value(spark):
    """Evaluate a column expression on one row of strings."""

    def run(build, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        row = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names))
        return row.select(build(*[F.col(n) for n in names]).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize(
    "text, level",
    [(" warn ", "WARN"), ("warning", "WARN"), ("Severe", "ERROR"), ("critical", "FATAL"), ("crit", "INFO"), (None, "INFO"), ("trace", "TRACE")],
)
def test_normalize_level(value, text, level):
    assert value(normalize_level, text) == level


@pytest.mark.parametrize(
    "message, template",
    [
        (None, ""),
        ("\t order 12 of 3400 \n", "order <N> of <N>"),
        ("at 2025-03-05T10:00:00.123 id 1a5a4a94-ca1e-4a8e-a63d-e10ca77bc5db", "at <TIMESTAMP>.<N> id <UUID>"),
        ("1A5A4A94-CA1E", "<N>A<N>A<N>A<N>-CA<N>E"),
    ],
)
def test_normalize_message(value, message, template):
    assert value(ex.normalize_message, message) == template


STACK = "java.lang.X: y\n\tat com.example.A.run(A.java:12)  \n\tat com.example.B.go(B.java:7)"


@pytest.mark.parametrize(
    "message, stack, signature",
    [
        ("Boom: detail", STACK, "Boom em A.java:12"),
        (":x", STACK, ":x em A.java:12"),
        ("Boom: detail", "no frames here", "Boom"),
        ("Boom: detail", "at a.B.c without place", "Boom"),
        ("Boom: detail", "at a)b(c)", "Boom"),
        ("Boom: detail", "at a(b(c)", "Boom em b(c"),
        ("Boom: detail", "  \n", "Boom: detail"),
        (None, None, ""),
        ("x" * 80, None, "x" * 80),
        ("x" * 81, None, "x" * 80 + "..."),
    ],
)
def test_error_signature(value, message, stack, signature):
    assert value(ex.error_signature, message, stack) == signature


def test_stack_signature(value):
    assert value(ex.stack_signature, "Boom: detail", STACK) == "Boom|at com.example.A.run(A.java:12)"
    assert value(ex.stack_signature, ":x", None) == "|"
    assert value(ex.stack_signature, None, "\n\n   at \n at z") == "|at z"


@pytest.mark.parametrize(
    "logger, short", [("com.example.App", "App"), ("App", "App"), (".App", ".App"), ("com.", "com."), ("a.b", "b"), (" ", ""), (None, "")]
)
def test_short_logger(value, logger, short):
    assert value(ex.short_logger, logger) == short


def test_text_helpers(value):
    assert value(lambda c: ex.truncated(c, 6), "abcdefg") == "abc..."
    assert value(lambda c: ex.truncated(c, 7), "abcdefg") == "abcdefg"
    assert value(lambda c: ex.truncated(c, 7), None) == ""
    assert value(lambda c: ex.thousands(c.cast("bigint")), "1234567") == "1.234.567"
    assert value(ex.escape_csv, 'a,"b"') == '"a,""b"""'
    assert value(ex.escape_csv, None) == ""
    assert value(ex.escape_html, "<a & b>") == "&lt;a &amp; b&gt;"
    assert value(ex.escape_markdown, "a|b\nc") == "a\\|b<br>c"
    assert value(lambda c: ex.highlight(c, ["a", " ", "z"], "<", ">"), "abca") == "<a>bc<a>"
    assert value(lambda m, s: ex.full_message(m, s), "m", "at x") == "m\nat x"
    assert value(lambda m, s: ex.full_message(m, s), "m", " ") == "m"
    assert value(ex.has_stack_trace, "  ") is False
    assert value(ex.has_stack_trace, "at a.b.C") is True


@pytest.mark.parametrize(
    "seconds, label",
    [(0, "0 min"), (59, "0 min"), (60, "1 min"), (3600, "1 horas"), (3660, "1 horas, 1 min"), (86400, "1 dias, 0 horas"), (180061, "2 dias, 2 horas")],
)
def test_duration_label(value, seconds, label):
    assert value(lambda c: ex.duration_label(c.cast("bigint")), str(seconds)) == label


@pytest.mark.parametrize(
    "line, level", [("a fatal ERROR", "FATAL"), ("SEVERE x", "ERROR"), ("warning", "WARN"), ("info debug", "INFO"), ("tracer", "TRACE"), ("plain", None)]
)
def test_level_in_line(value, line, level):
    assert value(ex.level_in_line, line) == level
