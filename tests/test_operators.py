import random
from datetime import datetime, timedelta

import pytest

from loglake.operators import anomalies, context, filters, flows, stacks, stats

T0 = datetime(2025, 3, 3, 9, 0)  # a Monday


def at(**delta):
    return T0 + timedelta(**delta)


def lines(df):
    return [r.line_number for r in df.orderBy("line_number").collect()]


# --- filters ---------------------------------------------------------------------

NOW = datetime(2032, 8, 19, 18, 0)


@pytest.fixture
def mill(entries):
    return entries(
        dict(ts=NOW - timedelta(days=3), level="TRACE", thread="pump-a", message="valve 3 opened", logger="org.orchard.Press"),
        dict(ts=NOW - timedelta(hours=20), level="WARN", thread="pump-b", message="juice LEVEL low", logger="org.orchard.Tank"),
        dict(ts=NOW - timedelta(hours=6), level="ERROR", thread="gear", message=None, logger=None, stack_trace="at org.orchard.Belt.stop"),
        dict(ts=NOW - timedelta(minutes=40), level="FATAL", thread=None, message="belt torn", logger="org.orchard.Belt"),
        dict(ts=None, level="INFO", thread="pump-a", message="level restored", logger="org.orchard.Tank"),
        dict(ts=NOW - timedelta(minutes=5), level="INFO", thread="pump-b", message="tank 7 full", logger="org.orchard.Tank.Probe"),
    )


@pytest.mark.parametrize(
    "conditions, kept",
    [
        (dict(), [1, 2, 3, 4, 5, 6]),
        (dict(today=True), [3, 4, 6]),
        (dict(yesterday=True), [2]),
        (dict(last=30), [6]),
        (dict(last="45m"), [4, 6]),
        (dict(last="1d"), [2, 3, 4, 6]),
        (dict(until="2032-08-18"), [1]),
        (dict(since="2032-08-18 20:00", until="2032-08-19 12:00:00"), [2, 3]),
        (dict(level="trace, severe"), [1, 3]),
        (dict(level=["FATAL"]), [4]),
        (dict(min_level="ERROR"), [3, 4]),
        (dict(min_level="WARN", thread="pump"), [2]),
        (dict(text="level"), [2, 5]),
        (dict(exclude="BELT"), [1, 2, 5, 6]),
        (dict(regex=r"\b[37] (full|opened)$"), [1, 6]),
        (dict(logger="orchard.tank"), [2, 5, 6]),
        (dict(thread="PUMP-A"), [1, 5]),
        (dict(text="tank", last="2h"), [6]),
    ],
)
def test_filters(mill, conditions, kept):
    assert lines(filters.filter_logs(mill, now=NOW, **conditions)) == kept


def test_filter_arguments_are_checked(mill):
    for bad in (dict(level="shouting"), dict(until="at noon"), dict(last="2d6h")):
        with pytest.raises(ValueError):
            filters.filter_logs(mill, now=NOW, **bad)


def test_filter_report(mill):
    assert tuple(filters.filter_report(mill, min_level="FATAL", now=NOW).first()) == (1, 6, 16)
    assert tuple(filters.filter_report(mill.where("false")).first()) == (0, 0, 0)


def test_time_filter_reaches_the_scan(spark, mill, tmp_path):
    mill.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    kept = filters.filter_logs(stored, since="2032-08-19", min_level="WARN", now=NOW).select("message")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(severity,3)" in plan and "GreaterThanOrEqual(ts," in plan
    assert "raw" not in plan.split("ReadSchema")[1]


def test_no_limit_gives_all(entries):
    df = entries(*[dict(level="ERROR", message="x" * n, thread=f"t{n}", logger=f"l{n}") for n in range(1, 31)])
    for found in (
        stats.top_errors(df, None), stats.count_by_logger(df, limit=None), stats.count_by_thread(df, None),
        anomalies.first_errors(df, None), context.error_context(df, "x", None), context.root_cause_entries(df, None),
        anomalies.findings(df, limit=None),
    ):
        assert found.count() == 30
    assert stats.count_by_thread(df).count() == 20 and anomalies.findings(df).count() == 5


def test_page(entries):
    df = entries(dict(stack_trace="a\nb\nc\nd\n", logger="com.example.Service"), dict(message="second"))
    first, second = filters.page(df).collect()
    assert (first.logger, first.stack_head, first.stack_lines_left) == ("Service", "a\nb\nc", 1)
    assert (second.stack_head, second.stack_lines_left) == (None, 0)
    assert [r.line_number for r in filters.page(df, limit=5, offset=1).collect()] == [2]


# --- stats ------------------------------------------------------------------------


def test_summary_and_levels(entries):
    df = entries(dict(ts=at(), level="ERROR"), dict(ts=at(seconds=90.9)), dict(), dict(level="TRACE"))
    assert tuple(stats.summary(df).first()) == (4, at(), at(seconds=90.9), 90)
    assert [tuple(r) for r in stats.level_distribution(df).collect()] == [
        ("TRACE", 0, 1, 25), ("INFO", 2, 2, 50), ("ERROR", 4, 1, 25),
    ]
    assert tuple(stats.summary(df.where("false")).first()) == (0, None, None, 0)


def test_timeline_fills_gaps(entries):
    df = entries(*[dict(ts=at(minutes=m)) for m in (20, 21, 100, 101, 185)], dict())
    rows = [((r.bucket - T0).seconds // 60, r.n, r.is_peak) for r in stats.timeline(df, "45m").collect()]
    assert rows == [(0, 2, True), (45, 0, False), (90, 2, True), (135, 0, False), (180, 1, False)]
    assert stats.timeline(df, "45m", "ERROR").collect() == []
    half = [(r.bucket - T0).seconds for r in stats.timeline(df, "30s").where("n > 0").collect()]
    assert half == [1200, 1260, 6000, 6060, 11100]


def test_heatmap(entries):
    df = entries(*[dict(ts=at(minutes=m), level="ERROR") for m in (0, 10, 20, 60)], dict(ts=at(), level="WARN"))
    cells = {(r.dow, r.hour): (r.n, r.intensity) for r in stats.heatmap(df).collect()}
    assert len(cells) == 168 and cells[0, 9] == (3, 4) and cells[0, 10] == (1, 2) and cells[6, 23] == (0, 0)
    assert tuple(stats.heatmap_peak(df).first()) == (0, 9, 3)
    assert stats.heatmap_peak(df, "FATAL").collect() == []


def test_heatmap_peak_goes_to_the_first_to_reach_it(entries):
    df = entries(*[dict(ts=at(minutes=m), level="ERROR") for m in (0, 60, 61, 10080)])
    assert tuple(stats.heatmap_peak(df).first()) == (0, 10, 2)


def test_top_errors(entries):
    rows = [dict(level="ERROR", message="database timeout"), dict(level="FATAL", message="database timeout"), dict(level="ERROR", message="payment failed"), dict(message="fine")]
    assert [tuple(r) for r in stats.top_errors(entries(*rows), 0).collect()] == [("database timeout", 2), ("payment failed", 1)]


def test_counts_by_name(entries):
    df = entries(dict(logger="b"), dict(logger="a", level="ERROR"), dict(logger=None, thread=None))
    assert [tuple(r) for r in stats.count_by_logger(df).collect()] == [("a", 1), ("b", 1)]
    assert [tuple(r) for r in stats.count_by_logger(df, "WARN+").collect()] == [("a", 1)]
    assert [tuple(r) for r in stats.count_by_thread(df).collect()] == [("main", 2)]


# --- anomalies ---------------------------------------------------------------------


def test_patterns_and_first_errors(entries):
    df = entries(*[dict(level="ERROR", message=m) for m in ("timeout 1", "timeout 2", "cache", "timeout 3")], dict(message="timeout 4"))
    assert [tuple(r) for r in anomalies.patterns(df).collect()] == [("timeout <N>", 3)]
    assert [(r.line_number, r.message) for r in anomalies.first_errors(df).collect()] == [(1, "timeout 1"), (3, "cache")]
    assert [r.pattern for r in anomalies.unique_errors(df).collect()] == ["cache"]


def test_spikes(entries):
    burst = [dict(ts=at(seconds=s), level="ERROR") for s in range(20)]
    calm = [dict(ts=at(minutes=5 * i), level="ERROR") for i in range(1, 6)]
    assert [tuple(r) for r in anomalies.error_spikes(entries(*burst, *calm)).collect()] == [(at(), 20, 4)]
    assert anomalies.error_spikes(entries(*burst)).collect() == []


def test_recurring(entries):
    steady = [dict(ts=at(minutes=10 * i, seconds=i % 3), level="WARN", message=f"tick {i}") for i in range(8)]
    random = [dict(ts=at(minutes=m), level="WARN", message="odd") for m in (0, 1, 50, 51, 300)]
    close = [dict(ts=at(seconds=s), level="WARN", message="close") for s in range(6)]
    (row,) = anomalies.recurring_patterns(entries(*steady, *random, *close)).collect()
    # 69 minutes and a second over seven intervals, each rounded down to whole minutes.
    assert (row.pattern, row.n, row["mean"]) == ("tick <N>", 8, 9)


def test_gaps(entries):
    dense = [dict(ts=at(minutes=m)) for m in range(100)]
    late = [dict(ts=at(minutes=120 + m)) for m in range(100)]
    assert [tuple(r) for r in anomalies.log_gaps(entries(*late, *dense)).collect()] == [(at(minutes=99), 21)]
    assert anomalies.log_gaps(entries(dict(ts=at()))).collect() == []


def test_findings_defaults(entries):
    errors = [dict(ts=at(minutes=m), level="ERROR", message=f"kind {'abcdef'[m]}") for m in (0, 1, 2, 3, 4, 4)]
    errors[5]["message"] = "kind f"
    found = anomalies.findings(entries(*errors, dict(ts=at(minutes=90)))).collect()
    assert [r.detector for r in found] == ["unique_error"] * 5
    assert anomalies.findings(entries(dict())).collect() == []


# --- flows --------------------------------------------------------------------------


def _request(thread, start, last="INFO"):
    steps = ["mill.Hopper", "mill.press.Screw", "mill.Hopper", "mill.tank.Gauge", "mill.tank.Gauge"]
    return [
        dict(ts=at(seconds=start + i * 0.5), thread=thread, logger=f"com.example.{s}", level=last if i == 3 else "INFO")
        for i, s in enumerate(steps)
    ]


def test_flow_clusters(entries):
    df = entries(*_request("t-1", 0), *_request("t-2", 1, "ERROR"), *_request("t-1", 60)[:1])
    top, other = flows.flow_clusters(df, "2s").collect()
    assert (top.signature, top.sessions, top.total_entries, top.error_sessions) == (
        "Hopper -> Screw -> Hopper -> Gauge", 2, 10, 1,
    )
    assert [tuple(t) for t in top.top_threads] == [("t-1", 1), ("t-2", 1)]
    assert (top.example_start, top.example_end) == (at(), at(seconds=2))
    assert (other.signature, other.sessions) == ("Hopper", 1)
    assert flows.flow_clusters(df, "2s", rarest_first=True, limit=1).first().sessions == 1
    assert flows.flow_clusters(df, "2s", min_sessions=2).count() == 1


def _brute_sessions(rows, window):
    """Sessions by a plain loop over the sorted entries."""
    open_runs, done = {}, []
    for thread, ts, line, name, bad in sorted(rows, key=lambda r: (r[1], r[2])):
        run = open_runs.get(thread)
        if run is None or (ts - run["end"]) // timedelta(milliseconds=1) > window:
            run = open_runs[thread] = dict(thread=thread, start=ts, n=0, names=[], bad=False)
            done.append(run)
        run["end"] = ts
        run["n"] += 1
        run["bad"] |= bad
        if not run["names"] or run["names"][-1] != name:
            run["names"].append(name)
    return sorted(
        (r["thread"] or "", r["start"], r["end"], r["n"], " -> ".join(r["names"][:6]) + (" -> ..." if len(r["names"]) > 6 else ""), r["bad"])
        for r in done
    )


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_flow_sessions_when_one_thread_holds_most(spark, entries, partitions):
    import random

    rnd = random.Random(partitions)
    rows, t = [], T0
    for line in range(1, 1501):
        t += timedelta(microseconds=rnd.choice([0, 0, 1000, 500_000, 2_000_000, 2_000_999, 2_001_000] if rnd.random() < 0.2 else [0, 7, 1500]))
        thread = rnd.choice(["hot", "hot", "hot", "hot", None, "a", "b"])
        rows.append((thread, t, line, rnd.choice("ABC"), rnd.random() < 0.01))
    df = entries(
        *[dict(thread=th, ts=ts, line_number=n, logger=f"x.{name}", level="ERROR" if bad else "INFO") for th, ts, n, name, bad in rows],
        dict(ts=None),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = flows.flow_sessions(df.repartition(5), "2s").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    found = sorted((r.thread or "", r.start_ts, r.end_ts, r.n_entries, r.signature, r.has_error) for r in got)
    assert found == _brute_sessions(rows, 2000)


def test_flow_name_falls_back_to_level(entries):
    df = entries(dict(ts=at(), logger=None, level="WARN"), dict(ts=at(seconds=1), logger=" "))
    assert flows.flow_sessions(df).first().signature == "WARN -> INFO"


def test_probable_call(entries):
    rows = [dict(ts=at(seconds=i - 10), line_number=i, logger=f"x.L{i}") for i in range(8, 15)]
    df = entries(*rows, dict(ts=at(seconds=1), line_number=50, thread="other"))
    got = flows.probable_call(df, 11, "1s").collect()
    assert [(r.line_number, r.is_anchor) for r in got] == [(10, False), (11, True), (12, False)]
    call = flows.probable_call_summary(df, 11, "1s").first()
    assert (call.thread, call.n_entries, call.signature, call.anchor_line) == ("main", 3, "L10 -> L11 -> L12", 11)
    assert flows.probable_call(df, 999).collect() == []
    assert flows.probable_call_summary(df, 999).collect() == []


def test_probable_call_without_thread_takes_any(entries):
    df = entries(dict(ts=at(), thread=None), dict(ts=at(seconds=1), thread="a"), dict(ts=at(seconds=9), thread=None))
    assert [r.line_number for r in flows.probable_call(df, 1).collect()] == [1, 2]
    assert flows.probable_call_summary(df, 1).first().n_entries == 2


# --- context and stacks ---------------------------------------------------------------


def test_correlate(entries):
    df = entries(*[dict(ts=at(minutes=m), message="Boom here" if m in (20, 90) else f"m{m}") for m in range(0, 100, 10)], dict(message="boom, no time"))
    got = context.correlate(df, "BOOM", "10m").collect()
    assert [(r.line_number, r.is_event, r.matches) for r in got] == [(2, False, 2), (3, True, 2), (4, False, 2)]
    assert len(context.correlate(df, "boom", 20).collect()) == 5
    assert len(context.correlate(df, "boom", "90m", limit=4).collect()) == 4
    assert context.correlate(df, "absent").collect() == []


def test_digest_and_selections(entries):
    df = entries(
        dict(level="ERROR", message="Fail", ts=at(), stack_trace="at x"), dict(level="FATAL", message=None),
        dict(level="WARN", message="careful"), dict(level="ERROR", message="Fail"),
    )
    found = {(r.section, r.ord): (r.text, r.n) for r in context.digest(df).collect()}
    assert len(found) == 9
    assert found["recent", 1] == ("2025-03-03 09:00:00 ERROR com.example.App - Fail\nat x", None)
    assert [found["top_errors", i] for i in (1, 2)] == [("Fail", 2), ("", 1)]
    assert [found["totals", i] for i in (1, 2, 3)] == [("entries", 4), ("errors", 3), ("warnings", 1)]
    assert [r.line_number for r in context.error_context(df, "Fail").collect()] == [1, 4]
    assert context.error_context(df, "fail").collect() == []
    assert [r.text for r in context.root_cause_entries(df, 2).collect()][1] == "FATAL com.example.App - null"
    assert context.root_cause_entries(df.where("severity < 3")).collect() == []


def test_stacks(entries):
    df = entries(
        dict(message="E: 1", stack_trace="at A\nat B", ts=at()), dict(message="E: 2", stack_trace="at A\nat C", ts=at(hours=1)),
        dict(message="F", stack_trace="at A\n" * 7), dict(stack_trace=" "),
    )
    groups = [tuple(r) for r in stacks.group_stacks(df).collect()]
    assert groups[0] == ("E|at A", 2, at(), at(hours=1), "E: 1", "at A\nat B")
    assert groups[1][:2] == ("F|at A", 1)
    listed = stacks.list_stacks(df).collect()
    assert [(r.idx, r.stack_lines_left) for r in listed] == [(1, 0), (2, 0), (3, 2)]
    assert stacks.stack_at(df, 2).first().message == "E: 2"
    assert stacks.stack_at(df, 5).collect() == []
    with pytest.raises(ValueError):
        stacks.stack_at(df, 0)


def test_stored_entries_are_pruned_by_day(spark, mill, tmp_path):
    from loglake.sources import load_entries, save_entries

    path = save_entries(mill, str(tmp_path / "stored"))
    assert load_entries(spark, path).count() == 6
    kept = load_entries(spark, path, "2032-08-18 20:00", "2032-08-19 12:00")
    assert lines(kept) == [2, 3]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_template_rollups_add_up(spark, entries, tmp_path):
    from loglake.operators import templates

    rng = random.Random(4)
    rows = [
        {
            "ts": None if i % 11 == 0 else datetime(2025, 1, 1) + timedelta(minutes=i * 7 % 90, seconds=i),
            "level": rng.choice(["INFO", "WARN", "ERROR", "FATAL"]), "message": f"order {i} of {rng.choice(['cart', 'shop', 'depot'])}{'!' * (i % 5)}",
        }
        for i in range(400)
    ] + [{"level": "ERROR", "message": None}, {"level": "ERROR", "message": "only one"}]
    df = entries(*rows)
    whole = templates.template_rollup(df)
    path = str(tmp_path / "templates")
    for part in range(3):
        templates.add_templates(templates.template_rollup(df.where(f"line_number % 3 = {part}")), path)
    stored = templates.load_templates(spark, path)
    assert sorted(map(str, stored.collect())) == sorted(map(str, whole.select(stored.columns).collect()))
    same = lambda a, b: [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]
    assert same(templates.patterns_of_rollup(stored, None), anomalies.patterns(df, None))
    assert same(templates.first_errors_of_rollup(stored, None), anomalies.first_errors(df, None))
    assert same(templates.unique_errors_of_rollup(stored, None), anomalies.unique_errors(df, None))
    minutes = templates.minutes_of_rollup(stored)
    assert same(anomalies.recurring_of_minutes(minutes, 3.0, None), anomalies.recurring_patterns(df, 3.0, None))
    empty = templates.template_rollup(df.limit(0))
    assert templates.patterns_of_rollup(empty, 5).count() == templates.merged(empty, empty).count() == 0


def test_plans_are_made_without_a_job(spark, entries):
    df = entries({"ts": datetime(2025, 1, 1), "message": "boom"}, {"ts": datetime(2025, 1, 1, 0, 1), "message": "next"}, {"message": "boom later"})
    ids = lambda: set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = ids()
    found = [context.correlate(df, "BOOM", "2m"), context.correlate(df, "absent"), flows.probable_call(df, 1, "10s"), flows.probable_call(df, 9), flows.probable_call_summary(df, 1, "5m"), flows.probable_call_summary(df, 3)]
    assert ids() == before
    assert [f.count() for f in found] == [2, 0, 1, 0, 1, 0]
    assert [(r.is_event, r.matches) for r in found[0].collect()] == [(True, 1), (False, 1)]


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("after", [False, True])
def test_rows_beside(spark, width, after):
    from loglake.operators.calendar import beside

    keys = random.Random(width).sample(range(-500, 3000), 300)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "at long, v string")
    totals = {"n": ("count", "v"), "most": ("max", "at"), "least": ("min", "at"), "all": ("sum", "at")}
    rows = beside(df, "at", width, after, totals, other="v", key="at").collect()
    assert {(r.n, r.most, r.least, r["all"]) for r in rows} == {(300, max(keys), min(keys), sum(keys))}
    assert {(r.n, r["all"]) for r in beside(df, "at", width, totals=totals).collect()} == {(300, sum(keys))}
    got = {r["at"]: (r.other, r.key) for r in rows}
    keys.sort()
    pairs = zip(keys, keys[1:] + [None]) if after else zip(keys, [None] + keys[:-1])
    assert got == {k: (None if o is None else f"v{o}", o) for k, o in pairs}
