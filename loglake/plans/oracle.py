"""The registered queries again as SQL over the given tables, for checking results.

Written the direct way (row-by-row windows, no roll-ups), so that it does not share the
shortcuts of the operators.
"""

from __future__ import annotations

from loglake.plans.report import SECTIONS
from loglake.sources.events import EVENT_LOGGERS

_LOGGER_CASES = " ".join(f"WHEN '{kind}' THEN '{cls}'" for kind, cls in EVENT_LOGGERS.items())

LOGS = f"""
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type = 'error' AS e FROM events
), base AS (
  SELECT 'events' AS source_file, event_id + 1 AS line_number, ts,
    CASE WHEN e AND user_id % 10 = 0 THEN 'FATAL' WHEN e THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARN'
         WHEN event_type = 'signup' THEN 'DEBUG' WHEN event_type = 'view' AND k % 10 = 0 THEN 'TRACE' ELSE 'INFO' END AS level,
    CASE event_type {_LOGGER_CASES} END AS logger,
    'exec-' || (user_id % 16) AS thread,
    CASE WHEN e AND value > 150 THEN 'Unclassified failure ' || translate(md5(CAST(event_id AS VARCHAR)), '0123456789', 'ghijklmnop')
         WHEN e AND k % 4 = 0 THEN 'NullPointerException: order ' || event_id || ' is null'
         WHEN e AND k % 4 = 1 THEN 'Connection timeout after ' || k || ' ms'
         WHEN e AND k % 4 = 2 THEN 'IllegalStateException: tx ' || event_id || ' already committed'
         WHEN e THEN 'Failed to process payment for order #' || event_id
         WHEN event_type = 'purchase' THEN 'Payment gateway slow (' || k || 'ms)'
         ELSE event_type || ' by user_' || user_id || ' k=' || k END AS message,
    CASE WHEN e AND value <= 150 AND k % 4 = 0 THEN 'java.lang.NullPointerException: null' || chr(10) || chr(9) ||
           'at com.example.OrderService.load(OrderService.java:' || (k % 20) || ')' || chr(10) || chr(9) || 'at com.example.Web.call(Web.java:7)'
         WHEN e AND value <= 150 AND k % 4 = 2 THEN 'java.lang.IllegalStateException: tx' || chr(10) || chr(9) ||
           'at com.example.Tx.commit(Tx.java:' || (k % 10) || ')' END AS stack_trace
  FROM ev
), logs AS (
  SELECT *, CAST(list_position(['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'], level) - 1 AS INTEGER) AS severity,
    string_split(logger, '.')[-1] AS short,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' [' || thread || '] ' || level || ' ' || logger || ' - ' || message AS raw,
    trim(regexp_replace(regexp_replace(regexp_replace(message,
      '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '<UUID>', 'g'),
      '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}', '<TIMESTAMP>', 'g'), '\\d+', '<N>', 'g')) AS norm,
    CASE WHEN severity >= 4 THEN 500 WHEN severity = 3 THEN 404 ELSE 200 END AS status,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS second_text,
    regexp_extract(stack_trace, '(?m)^\\s*(at .*)$', 1) AS frame,
    CASE WHEN stack_trace IS NULL THEN CASE WHEN length(message) > 80 THEN left(message, 80) || '...' ELSE message END
         ELSE split_part(message, ':', 1) || ' em ' || regexp_extract(frame, '\\(([^)]*)\\)', 1) END AS signature
  FROM base
)
"""


def _q(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([LOGS, *ctes])} {body}"


def _minutes(a: str, b: str) -> str:
    """Whole minutes from a to b."""
    return f"((epoch_us({b}) - epoch_us({a})) // 60000000)"


# --- statements used by more than one query -----------------------------------------------

_LEVELS = "SELECT level, severity, count(*) AS n, count(*) * 100 // (SELECT count(*) FROM logs) AS pct FROM logs GROUP BY level, severity"


def _timeline(minutes: int, where: str = "true") -> str:
    return f"""
    SELECT g.b AS bucket, coalesce(c.n, 0) AS n, coalesce(c.n = max(c.n) OVER (), false) AS is_peak
    FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), max(ts), INTERVAL {minutes} MINUTE)) AS b FROM logs WHERE {where}) g
    LEFT JOIN (
      SELECT s.start + to_minutes((date_diff('minute', s.start, date_trunc('minute', ts)) // {minutes}) * {minutes}) AS b, count(*) AS n
      FROM logs, (SELECT date_trunc('hour', min(ts)) AS start FROM logs WHERE {where}) s WHERE {where} GROUP BY 1
    ) c ON c.b = g.b"""


_HEAT = """
    SELECT CAST(d AS INTEGER) AS dow, CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS n,
      CAST(CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN n / peak < 0.25 THEN 1 WHEN n / peak < 0.5 THEN 2
           WHEN n / peak < 0.75 THEN 3 ELSE 4 END AS INTEGER) AS intensity
    FROM (SELECT d, h FROM range(7) a(d), range(24) b(h)) g
    LEFT JOIN (SELECT isodow(ts) - 1 AS d, hour(ts) AS h, count(*) AS n FROM logs WHERE severity >= 4 GROUP BY ALL) c USING (d, h)
    CROSS JOIN (SELECT CAST(max(n) AS DOUBLE) AS peak FROM (SELECT count(*) AS n FROM logs WHERE severity >= 4 GROUP BY isodow(ts), hour(ts)))"""

# Running count per cell in time order; the peak is the first row that shows the maximum.
_PEAK = """
    SELECT dow, hour, n FROM (
      SELECT CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hour, ts, line_number,
        count(*) OVER (PARTITION BY isodow(ts), hour(ts) ORDER BY ts, line_number ROWS UNBOUNDED PRECEDING) AS n
      FROM logs WHERE severity >= 4)
    ORDER BY n DESC, ts, line_number LIMIT 1"""

_TOP_ERRORS = "SELECT signature, count(*) AS n FROM logs WHERE severity >= 4 GROUP BY signature ORDER BY n DESC, signature LIMIT 10"


def _spikes(minutes: int) -> str:
    return f"""
    SELECT ts, n, baseline FROM (
      SELECT b AS ts, n, CAST(sum(n) OVER () AS BIGINT) // count(*) OVER () AS baseline,
        sum(n) OVER () AS errors, count(*) OVER () AS buckets
      FROM (SELECT date_trunc('hour', ts) + to_minutes((minute(ts) // {minutes}) * {minutes}) AS b, count(*) AS n
            FROM logs WHERE severity >= 4 GROUP BY 1))
    WHERE errors >= 10 AND buckets >= 3 AND n > 3 * baseline AND n > 5"""


def _unique(limit: str = "") -> str:
    return f"""
    SELECT min(source_file) AS source_file, min(line_number) AS line_number, min(ts) AS ts, norm AS pattern
    FROM logs WHERE severity >= 4 GROUP BY norm HAVING count(*) = 1 ORDER BY line_number {limit}"""


def _recurring(factor: float, limit: str = "") -> str:
    return f"""
    SELECT ts, pattern, n, mean, deviation FROM (
      SELECT min(t0) AS ts, norm AS pattern, count(*) + 1 AS n, any_value(m) AS mean,
        CAST(floor(sqrt(CAST(sum((i - m) * (i - m)) AS BIGINT) // count(*))) AS BIGINT) AS deviation
      FROM (
        SELECT norm, i, t0, CAST(sum(i) OVER (PARTITION BY norm) AS BIGINT) // count(*) OVER (PARTITION BY norm) AS m
        FROM (SELECT norm, min(ts) OVER (PARTITION BY norm) AS t0,
                {_minutes("lag(ts) OVER w", "ts")} AS i
              FROM logs WHERE severity >= 3 WINDOW w AS (PARTITION BY norm ORDER BY ts)) WHERE i IS NOT NULL)
      GROUP BY norm)
    WHERE n >= 5 AND mean > 0 AND deviation < mean * {factor} ORDER BY ts, pattern {limit}"""


def _gaps(factor: float, limit: str = "") -> str:
    return f"""
    SELECT before AS ts, gap_minutes FROM (
      SELECT lag(ts) OVER (ORDER BY ts, line_number) AS before, {_minutes("lag(ts) OVER (ORDER BY ts, line_number)", "ts")} AS gap_minutes,
        {_minutes("min(ts) OVER ()", "max(ts) OVER ()")} AS span, count(*) OVER () AS c FROM logs)
    WHERE span > 0 AND gap_minutes > 5 AND gap_minutes > {factor} / (CAST(c AS DOUBLE) / span) ORDER BY ts {limit}"""


def _findings(spike_minutes: int, recurring: float, gap: float) -> str:
    return f"""
    SELECT 1 AS ord, 'spike' AS detector, 'CRITICO' AS severity, ts, CAST(NULL AS VARCHAR) AS pattern, CAST(n AS BIGINT) AS n,
      CAST(baseline AS DOUBLE) AS baseline FROM ({_spikes(spike_minutes)})
    UNION ALL SELECT 2, 'unique_error', 'CRITICO', ts, pattern, 1, NULL FROM ({_unique("LIMIT 5")})
    UNION ALL SELECT 3, 'recurring', 'ALERTA', ts, pattern, n, CAST(mean AS DOUBLE) FROM ({_recurring(recurring, "LIMIT 5")})
    UNION ALL SELECT 4, 'gap', 'ALERTA', ts, NULL, gap_minutes, NULL FROM ({_gaps(gap, "LIMIT 5")})"""


def _sessions(seconds: int) -> str:
    """CTEs ``sess`` (one row per session) over gaps in whole milliseconds."""
    return f"""
    step AS (
      SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000 > {seconds * 1000} THEN 1 ELSE 0 END AS brk
      FROM logs WINDOW w AS (PARTITION BY thread ORDER BY ts, line_number)
    ), runs AS (
      SELECT *, sum(brk) OVER (PARTITION BY thread ORDER BY ts, line_number ROWS UNBOUNDED PRECEDING) AS sid FROM step
    ), named AS (
      SELECT *, CASE WHEN brk = 1 OR short <> lag(short) OVER (PARTITION BY thread, sid ORDER BY ts, line_number) THEN 1 ELSE 0 END AS chg FROM runs
    ), ranked AS (
      SELECT *, sum(chg) OVER (PARTITION BY thread, sid ORDER BY ts, line_number ROWS UNBOUNDED PRECEDING) AS rk FROM named
    ), sess AS (
      SELECT thread, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_entries,
        string_agg(short, ' -> ' ORDER BY ts, line_number) FILTER (chg = 1 AND rk <= 6)
          || CASE WHEN max(rk) > 6 THEN ' -> ...' ELSE '' END AS signature,
        bool_or(severity >= 4) AS has_error
      FROM ranked GROUP BY thread, sid
    )"""


_DOTS = "replace(format('{:,}', CAST(%s AS BIGINT)), ',', '.')"
_MINUTE_TEXT = "strftime(%s, '%%Y-%%m-%%d %%H:%%M')"

_CLUSTERS = f"""
    SELECT c.signature, c.sessions, c.total_entries, c.error_sessions, t.threads,
      {_MINUTE_TEXT % "c.ex.s"} || ' -> ' || {_MINUTE_TEXT % "c.ex.e"} AS example
    FROM (
      SELECT signature, count(*) AS sessions, CAST(sum(n_entries) AS BIGINT) AS total_entries, count(*) FILTER (has_error) AS error_sessions,
        min(struct_pack(s := start_ts, t := thread, e := end_ts)) AS ex
      FROM sess GROUP BY signature HAVING count(*) >= 2
    ) c JOIN (
      SELECT signature, string_agg(thread || ' (' || {_DOTS % "n"} || ')', ', ' ORDER BY n DESC, thread) AS threads FROM (
        SELECT signature, thread, count(*) AS n, row_number() OVER (PARTITION BY signature ORDER BY count(*) DESC, thread) AS r
        FROM sess GROUP BY signature, thread) WHERE r <= 3 GROUP BY signature
    ) t USING (signature)
    ORDER BY c.sessions DESC, c.total_entries DESC, c.signature LIMIT 25"""


def _stack_head(n: int) -> str:
    return f"array_to_string(string_split(stack_trace, chr(10))[1:{n}], chr(10))"


def _stack_left(n: int) -> str:
    return f"CAST(greatest(coalesce(len(string_split(stack_trace, chr(10))), 0) - {n}, 0) AS BIGINT)"


_ENTRY_TEXT = "second_text || ' ' || level || ' ' || logger || ' - ' || message || coalesce(chr(10) || stack_trace, '')"
_WITH_STACK = "raw || coalesce(chr(10) || stack_trace, '')"
_REQUEST = "'GET /orders/' || line_number || ' HTTP/1.1'"
_WEB_TIME = "strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' -0300'"
_WEB_LINE = f"thread || ' - - [' || {_WEB_TIME} || '] \"' || {_REQUEST} || '\" ' || status || ' ' || length(message)"
_NGINX_LINE = f"{_WEB_LINE} || ' \"-\" \"agent/' || level || '\"'"
_LOG4J_LINE = "strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' ' || level || ' [' || thread || '] ' || logger || ' - ' || message"
_WEB_LEVEL = "CASE WHEN status >= 500 THEN 'ERROR' WHEN status >= 400 THEN 'WARN' ELSE 'INFO' END"
_WEB_SEVERITY = "CAST(CASE WHEN status >= 500 THEN 4 WHEN status >= 400 THEN 3 ELSE 2 END AS INTEGER)"
_MILLIS = "date_trunc('milliseconds', ts)"
_SECONDS = "date_trunc('second', ts)"
_FILTERED = "SELECT line_number, ts, level, logger, thread, message FROM logs WHERE "


def _lines(value: str, extra: str = "", where: str = "true") -> str:
    """Rows of text cut into lines, as a text file holds them."""
    return f"SELECT {extra} unnest(string_split({value}, chr(10))) AS value FROM logs WHERE {where}"


_JSON_STACK = "coalesce(',\"stack_trace\":\"' || replace(replace(stack_trace, chr(10), '\\n'), chr(9), '\\t') || '\"', '')"
_JSON_LINE = (
    "'{\"@timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '\",\"level\":\"' || level || '\",\"logger\":\"' || logger"
    " || '\",\"thread\":\"' || thread || '\",\"message\":\"' || message || '\"' || " + _JSON_STACK + " || '}'"
)


def _html(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_HTML_ROW = (
    "'<tr class=\"' || level || '\"><td>' || line_number || '</td><td>' || second_text || '</td><td>' || level || '</td><td>' || "
    + _html("logger") + " || '</td><td>' || " + _html("message")
    + " || coalesce('<div class=\"stack\">' || " + _html("stack_trace") + " || '</div>', '') || '</td></tr>'"
)


def _count_lines(prefix: str, suffix: str) -> str:
    return f"UNION ALL SELECT '{prefix}' || count(*) || '{suffix}' FROM logs"


def _text(*lines: str) -> str:
    return " ".join(f"UNION ALL SELECT '{line}'" for line in lines)


_CSV_FIELD = """CASE WHEN regexp_matches({0}, '[,"\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""

_NEXT_FIT = """
    text AS (SELECT line_number, VALUE_LINE AS value, octet_length(encode(VALUE_LINE)) + 1 AS bytes FROM logs),
    cum AS (SELECT line_number, value, bytes, sum(bytes) OVER (ORDER BY line_number) AS until FROM text),
    starts AS (
      SELECT 1 AS part, CAST(1 AS BIGINT) AS first_line, CAST(0 AS HUGEINT) AS before
      UNION ALL
      SELECT s.part + 1, n.line_number, n.before FROM starts s,
        LATERAL (SELECT line_number, until - bytes AS before FROM cum
                 WHERE until - s.before > 65536 AND line_number > s.first_line ORDER BY line_number LIMIT 1) n
    )""".replace("VALUE_LINE", _NGINX_LINE)

_PART_ROWS = "CAST(p AS BIGINT) AS part, row_number() OVER (PARTITION BY p ORDER BY line_number) AS position, value"
#: Lines of an entry as text of a multi-line format.
_ENTRY_LINES = "(1 + coalesce(len(string_split(stack_trace, chr(10))), 0))"


def _line(of_entry: str = "1") -> str:
    """The line an entry begins at, when entries before it have some lines each."""
    return f"CAST(1 + coalesce(sum({of_entry}) OVER (ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line"


def _merged(order: str, *rows: str) -> str:
    """Lines of ``(src, t, line_number, text)`` rows with their position in an order."""
    cut = "SELECT src, t, line_number, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS i"
    return f"SELECT row_number() OVER (ORDER BY {order}) AS position, value FROM ({cut} FROM ({' UNION ALL '.join(rows)}))"


def _report() -> str:
    dots = lambda c: _DOTS % c
    day = "['Seg', 'Ter', 'Qua', 'Qui', 'Sex', 'Sab', 'Dom'][dow + 1]"
    hour = "lpad(CAST(hour AS VARCHAR), 2, '0')"
    return f"""
    SELECT 'summary' AS section, 1 AS ord, 'total' AS key, {dots("count(*)")} AS value FROM logs
    UNION ALL SELECT 'summary', 2, 'start', {_MINUTE_TEXT % "min(ts)"} FROM logs
    UNION ALL SELECT 'summary', 3, 'end', {_MINUTE_TEXT % "max(ts)"} FROM logs
    UNION ALL SELECT 'summary', 4, 'duration',
      CASE WHEN s >= 86400 THEN (s // 86400) || ' dias, ' || (s // 3600 % 24) || ' horas'
           WHEN s >= 3600 AND s // 60 % 60 > 0 THEN (s // 3600) || ' horas, ' || (s // 60 % 60) || ' min'
           WHEN s >= 3600 THEN (s // 3600) || ' horas' ELSE (s // 60) || ' min' END
      FROM (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS s FROM logs)
    UNION ALL SELECT 'levels', severity, level, {dots("n")} FROM ({_LEVELS})
    UNION ALL SELECT 'top_errors', row_number() OVER (ORDER BY n DESC, signature), signature, {dots("n")} FROM ({_TOP_ERRORS})
    UNION ALL SELECT 'timeline', row_number() OVER (ORDER BY bucket), strftime(bucket, '%d/%m %H:%M'), {dots("n")} FROM ({_timeline(60)})
    UNION ALL SELECT 'anomalies', row_number() OVER (ORDER BY ord, ts, pattern NULLS FIRST), severity,
      concat_ws(' | ', detector, strftime(ts, '%Y-%m-%d %H:%M:%S'), pattern, 'n=' || n, 'baseline=' || CAST(baseline AS BIGINT))
      FROM ({_findings(60, 1.5, 5.0)})
    UNION ALL SELECT 'heatmap_peak', 1, {day} || ' ' || {hour} || ':00', {dots("n")} FROM ({_PEAK})
    UNION ALL SELECT 'heatmap', dow * 24 + hour + 1, {day} || ' ' || {hour},
      ['.', '░', '▒', '▓', '█'][intensity + 1] || CASE WHEN n > 0 THEN CAST(n AS VARCHAR) ELSE '' END FROM ({_HEAT})"""


def _report_text() -> str:
    """The report as Markdown, line by line: a heading, a table head and the rows of each section."""
    heads = ", ".join(
        f"({i}, '{name}', ['', '## {title}', '', '| {left} | {right} |', '|---|---|'])" for i, (name, title, left, right) in enumerate(SECTIONS)
    )
    cell = "replace(replace(coalesce({0}, ''), '|', '\\|'), chr(10), '<br>')"
    return f"""SELECT row_number() OVER (ORDER BY zone, ord, k) AS position, value FROM (
      SELECT -1 AS zone, 0 AS ord, 0 AS k, '# Executive Log Report' AS value
      UNION ALL SELECT zone, -1, unnest([1, 2, 3, 4, 5]), unnest(head) FROM (VALUES {heads}) h(zone, section, head)
      UNION ALL SELECT h.zone, r.ord, 0, '| ' || {cell.format("r.key")} || ' | ' || {cell.format("r.value")} || ' |'
      FROM ({_report()}) r(section, ord, key, value) JOIN (VALUES {heads}) h(zone, section, head) ON h.section = r.section)"""


def oracles() -> dict[str, str]:
    web = f"{_SECONDS} AS ts, {_WEB_LEVEL} AS level, {_WEB_SEVERITY} AS severity"
    entry = f"{_MILLIS} AS ts, level, logger, thread, message, stack_trace"
    logback = f"SELECT 1 AS src, {_MILLIS} AS t, line_number, {_WITH_STACK} AS text FROM logs"
    nginx = f"SELECT 2 AS src, {_SECONDS} AS t, line_number, {_NGINX_LINE} AS text FROM logs"
    mixed = "SELECT '{0}' AS folder, {1} AS level, count(*) AS n, {2} AS stacks, count(*) AS times FROM logs GROUP BY ALL"
    call = "(SELECT ts AS t0, thread AS th FROM logs WHERE line_number = 500) a"
    in_call = "thread = th AND abs(epoch_us(ts) - epoch_us(t0)) // 1000 <= 21600000"
    hit = "(contains(lower(message), 'already committed') OR coalesce(contains(lower(stack_trace), 'already committed'), false))"
    return {
        "summary": _q("SELECT count(*) AS total, min(ts) AS start_ts, max(ts) AS end_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS duration_s FROM logs"),
        "level_distribution": _q(_LEVELS),
        "timeline": _q(_timeline(360)),
        "timeline_errors": _q(_timeline(45, "severity >= 4")),
        "heatmap": _q(_HEAT),
        "heatmap_peak": _q(_PEAK),
        "top_errors": _q(_TOP_ERRORS),
        "by_logger": _q("SELECT logger, count(*) AS n FROM logs GROUP BY logger ORDER BY n DESC, logger LIMIT 20"),
        "by_logger_level": _q("SELECT logger, count(*) AS n FROM logs WHERE severity >= 4 GROUP BY logger ORDER BY n DESC, logger LIMIT 20"),
        "by_thread": _q("SELECT thread, count(*) AS n FROM logs GROUP BY thread ORDER BY n DESC, thread LIMIT 20"),
        "filter_level": _q(_FILTERED + "level IN ('WARN', 'ERROR')"),
        "filter_min_level": _q(_FILTERED + "severity >= 4"),
        "filter_today": _q(_FILTERED + "CAST(ts AS DATE) = DATE '2024-01-30'"),
        "filter_yesterday": _q(_FILTERED + "CAST(ts AS DATE) = DATE '2024-01-29'"),
        **{name: _q(_FILTERED + "ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12 18:30:00'") for name in ("filter_range", "filter_range_stored")},
        "filter_last": _q(_FILTERED + "ts >= TIMESTAMP '2024-01-29 00:00:00'"),
        "filter_text": _q(_FILTERED + "contains(lower(message), 'illegalstate') OR contains(lower(stack_trace), 'illegalstate')"),
        "filter_regex": _q(_FILTERED + r"regexp_matches(message, '(?i)order #?\d*7\b') OR regexp_matches(stack_trace, '(?i)order #?\d*7\b')"),
        "filter_logger": _q(_FILTERED + "contains(lower(logger), 'payment')"),
        "filter_thread": _q(_FILTERED + "contains(thread, 'exec-1')"),
        "filter_exclude": _q(_FILTERED + "severity >= 4 AND NOT contains(lower(message), 'nullpointer') AND NOT coalesce(contains(lower(stack_trace), 'nullpointer'), false)"),
        "filter_combined": _q(_FILTERED + "severity >= 3 AND ts >= TIMESTAMP '2024-01-05' AND contains(lower(message), 'timeout') AND contains(thread, 'exec-2')"),
        "filter_level_expression": _q("SELECT line_number, level FROM logs WHERE severity >= 4"),
        "filter_report": _q("SELECT kept, total, kept * 100 // total AS pct FROM (SELECT count(*) FILTER (severity >= 4 AND (contains(lower(message), 'order') OR coalesce(contains(lower(stack_trace), 'order'), false))) AS kept, count(*) AS total FROM logs)"),
        "page": _q(f"SELECT source_file, line_number, ts, level, short AS logger, message, {_stack_head(3)} AS stack_head, {_stack_left(3)} AS stack_lines_left FROM logs ORDER BY line_number LIMIT 50 OFFSET 100"),
        "patterns": _q("SELECT norm AS pattern, count(*) AS n FROM logs WHERE severity >= 4 GROUP BY norm HAVING count(*) > 1 ORDER BY n DESC, norm LIMIT 10"),
        "first_errors": _q("SELECT source_file, line_number, ts, message, norm AS pattern FROM logs WHERE severity >= 4 QUALIFY row_number() OVER (PARTITION BY norm ORDER BY line_number) = 1 ORDER BY line_number LIMIT 20"),
        "spikes": _q(_spikes(60)),
        "unique_errors": _q(_unique()),
        "recurring": _q(_recurring(1.5)),
        "gaps": _q(_gaps(5.0)),
        "findings": _q(_findings(60, 1.5, 5.0)),
        "findings_default": _q(_findings(5, 0.5, 10.0)),
        "correlate": _q(f"""SELECT source_file, line_number, ts, level, CASE WHEN length(message) > 80 THEN left(message, 77) || '...' ELSE message END AS message,
            line_number = f.l AS is_event, f.c AS matches FROM logs, (SELECT min(line_number) AS l, arg_min(ts, line_number) AS t, count(*) AS c FROM logs WHERE {hit}) f
            WHERE ts BETWEEN f.t - INTERVAL 180 MINUTE AND f.t + INTERVAL 180 MINUTE ORDER BY line_number LIMIT 50"""),
        "flow_sessions": _q("SELECT * FROM sess", _sessions(600)),
        "flow_clusters": _q(_CLUSTERS, _sessions(7200)),
        "probable_call": _q(f"SELECT source_file, line_number, ts, level, thread, short AS logger, message, line_number = 500 AS is_anchor FROM logs, {call} WHERE {in_call}"),
        "probable_call_summary": _q(f"""SELECT thread, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_entries,
            string_agg(short, ' -> ' ORDER BY ts, line_number) FILTER (chg = 1 AND rk <= 6) || CASE WHEN max(rk) > 6 THEN ' -> ...' ELSE '' END AS signature,
            bool_or(severity >= 4) AS has_error, CAST(500 AS BIGINT) AS anchor_line
            FROM (SELECT *, sum(chg) OVER (ORDER BY ts, line_number ROWS UNBOUNDED PRECEDING) AS rk FROM
                   (SELECT *, CASE WHEN short IS DISTINCT FROM lag(short) OVER (ORDER BY ts, line_number) THEN 1 ELSE 0 END AS chg FROM logs, {call} WHERE {in_call}))
            GROUP BY thread"""),
        "stack_list": _q(f"SELECT row_number() OVER (ORDER BY line_number) AS idx, source_file, line_number, ts, message, {_stack_head(5)} AS stack_head, {_stack_left(5)} AS stack_lines_left FROM logs WHERE stack_trace IS NOT NULL ORDER BY line_number LIMIT 20"),
        "stack_groups": _q(f"SELECT split_part(message, ':', 1) || '|' || frame AS signature, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(message, line_number) AS sample_message, arg_min({_stack_head(3)}, line_number) AS sample_head FROM logs WHERE stack_trace IS NOT NULL GROUP BY 1"),
        "stack_at": _q("SELECT source_file, line_number, ts, message, stack_trace FROM logs WHERE stack_trace IS NOT NULL ORDER BY line_number LIMIT 1 OFFSET 41"),
        "digest": _q(f"""SELECT 'totals' AS section, 1 AS ord, 'entries' AS text, count(*) AS n FROM logs
            UNION ALL SELECT 'totals', 2, 'errors', count(*) FROM logs WHERE severity >= 4
            UNION ALL SELECT 'totals', 3, 'warnings', count(*) FROM logs WHERE level = 'WARN'
            UNION ALL SELECT 'top_errors', row_number() OVER (ORDER BY n DESC, message), message, n FROM
              (SELECT message, count(*) AS n FROM logs WHERE severity >= 4 GROUP BY message ORDER BY n DESC, message LIMIT 5)
            UNION ALL SELECT 'recent', row_number() OVER (ORDER BY line_number), text, NULL FROM
              (SELECT line_number, {_ENTRY_TEXT} AS text FROM logs ORDER BY line_number DESC LIMIT 20)"""),
        "error_context": _q(f"SELECT source_file, line_number, {_ENTRY_TEXT} AS text FROM logs WHERE severity >= 4 AND (contains(message, 'IllegalState') OR coalesce(contains(stack_trace, 'IllegalState'), false)) ORDER BY line_number LIMIT 5"),
        "error_context_text": _q(f"SELECT source_file, line_number, {_ENTRY_TEXT} AS text FROM logs WHERE severity >= 4 AND (contains(message, 'timeout after 7') OR coalesce(contains(stack_trace, 'timeout after 7'), false)) ORDER BY line_number LIMIT 5"),
        "root_cause": _q(f"SELECT source_file, line_number, {_ENTRY_TEXT} AS text FROM logs WHERE severity >= 4 ORDER BY line_number LIMIT 20"),
        "parse_logback": _q(f"SELECT {_line(_ENTRY_LINES)}, {_MILLIS} AS ts, level, severity, logger, thread, message, stack_trace, raw FROM logs"),
        "parse_log4j": _q(f"SELECT {_line(_ENTRY_LINES)}, {_MILLIS} AS ts, level, severity, logger, thread, message, stack_trace, {_LOG4J_LINE} AS raw FROM logs"),
        "parse_json": _q(f"SELECT {_line()}, ts, level, severity, logger, thread, message, stack_trace, {_JSON_LINE} AS raw FROM logs"),
        "parse_nginx": _q(f"SELECT {_line()}, {web}, 'nginx' AS logger, thread, {_REQUEST} || ' [' || status || '] ' || length(message) || ' bytes - agent/' || level AS message, CAST(NULL AS VARCHAR) AS stack_trace, {_NGINX_LINE} AS raw FROM logs"),
        "parse_apache": _q(f"SELECT {_line()}, {web}, 'apache' AS logger, thread, {_REQUEST} || ' [' || status || '] ' || length(message) AS message, CAST(NULL AS VARCHAR) AS stack_trace, {_WEB_LINE} AS raw FROM logs"),
        "parse_apache_error": _q(f"SELECT {_line()}, CAST(NULL AS TIMESTAMP) AS ts, level, severity, 'apache-error' AS logger, CAST(NULL AS VARCHAR) AS thread, message, CAST(NULL AS VARCHAR) AS stack_trace, '[' || strftime(ts, '%a %b %d %H:%M:%S.%f %Y') || '] [' || lower(level) || '] [pid ' || line_number || '] ' || message AS raw FROM logs"),
        "parse_custom": _q(f"SELECT {_line()}, {_MILLIS} AS ts, level, severity, logger, thread, message, CAST(NULL AS VARCHAR) AS stack_trace, raw FROM logs"),
        "parse_mixed": _q(" UNION ALL ".join([
            mixed.format("logback", "level", "count(stack_trace)"), mixed.format("log4j", "level", "count(stack_trace)"),
            mixed.format("json", "level", "count(stack_trace)"), mixed.format("nginx", _WEB_LEVEL, "0"), mixed.format("apache", _WEB_LEVEL, "0")])),
        "parse_headers_only": _q(_LEVELS),
        "detect_format": _q(" UNION ALL ".join(
            f"SELECT '{f}' AS folder, '{f}' AS format, CAST({n} AS BIGINT) AS lines FROM logs" for f, n in [
                ("logback", "sum(1 + coalesce(len(string_split(stack_trace, chr(10))), 0))"), ("log4j", "sum(1 + coalesce(len(string_split(stack_trace, chr(10))), 0))"),
                ("json", "count(*)"), ("nginx", "count(*)"), ("apache", "count(*)")])),
        "load_report": _q("SELECT 'logback' AS format, CAST(sum(1 + coalesce(len(string_split(stack_trace, chr(10))), 0)) AS BIGINT) AS lines, count(*) AS entries FROM logs"),
        "split_day": _q(_lines(_WITH_STACK, "strftime(ts, '%Y-%m-%d') AS day,")),
        "split_level": _q(_lines(_WITH_STACK, "lower(level) AS level,")),
        "split_size": _q(f"SELECT {_PART_ROWS} FROM (SELECT line_number, value, (SELECT max(part) FROM starts s WHERE s.first_line <= c.line_number) AS p FROM cum c)", _NEXT_FIT, recursive=True),
        "split_size_even": _q(f"SELECT {_PART_ROWS} FROM (SELECT *, (until - bytes) // 65536 + 1 AS p FROM cum)", _NEXT_FIT, recursive=True),
        "merge_files": _q(_merged("src, line_number, i", logback, nginx)),
        "merge_sorted": _q(_merged("value", logback, nginx)),
        "merge_by_time": _q(_merged("t, src, line_number, i", logback, nginx)),
        "merge_repeated": _q(_merged("src, line_number, i", nginx.replace("2 AS src", "0 AS src"), logback, nginx)),
        "merge_folder": _q(_merged("line_number % 5, line_number, i", logback)),
        "read_folder_names": _q(f"SELECT ['.x-', '[1]-', '_x-', 'b %41-', 'day=7-'][line_number % 5 + 1] AS name, {entry} FROM logs"),
        "read_glob_deep": _q(f"SELECT {entry} FROM logs WHERE line_number % 5 <> 2"),
        "detect_long_lines": _q("SELECT ts, level, length(message) + CASE WHEN line_number % 1000 = 1 THEN 70000 ELSE 0 END AS characters FROM logs"),
        "export_rows_json": _q("""SELECT line_number AS line, regexp_replace(CASE WHEN microsecond(ts) = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END, '(\\.\\d{3})000$', '\\1') AS timestamp,
            level, logger, thread, message, stack_trace AS "stackTrace" FROM logs"""),
        "export_rows_csv": _q(f"SELECT line_number || ',' || second_text || ',' || level || ',' || {_CSV_FIELD.format('logger')} || ',' || {_CSV_FIELD.format('thread')} || ',' || {_CSV_FIELD.format('message')} AS value FROM logs {_text('linha,timestamp,nivel,logger,thread,mensagem')}"),
        "export_rows_html": _q(f"{_lines(_HTML_ROW)} {_text('<!DOCTYPE html><html><head><meta charset=\"UTF-8\"><title>Log Report - events</title>', '<style>.ERROR, .FATAL { color: #f44; } .WARN { color: #fa0; } .INFO { color: #4c4; } .DEBUG { color: #4cc; } .stack { white-space: pre; }</style></head><body>', '<table><tr><th>#</th><th>Timestamp</th><th>Nivel</th><th>Logger</th><th>Mensagem</th></tr>', '</table></body></html>')} {_count_lines('<h1>Log Report</h1><p>Fonte: events | Entradas: ', '</p>')}"),
        "export_rows_markdown": _q(f"SELECT '| ' || line_number || ' | ' || second_text || ' | ' || level || ' | ' || logger || ' | ' || replace(message, '|', '\\|') || ' |' AS value FROM logs {_text('# Log Report', '', '**Fonte:** events  ', '', '| # | Timestamp | Nivel | Logger | Mensagem |', '|---|---|---|---|---|')} {_count_lines('**Entradas:** ', '')}"),
        "export_stacks": _q(_lines("'=== ' || second_text || ' ' || level || ' ===' || chr(10) || message || chr(10) || stack_trace || chr(10)", where="stack_trace IS NOT NULL")),
        "executive_report": _q(_report()),
        "write_report": _q(_report_text()),
        "tail_filter": _q(f"SELECT value, level, replace(value, 'Exception', '«Exception»') AS shown FROM (SELECT value, CASE WHEN contains(u, 'FATAL') THEN 'FATAL' WHEN contains(u, 'ERROR') OR contains(u, 'SEVERE') THEN 'ERROR' WHEN contains(u, 'WARN') THEN 'WARN' END AS level FROM (SELECT value, upper(value) AS u FROM ({_lines(_WITH_STACK)}))) WHERE level IS NOT NULL AND contains(lower(value), 'order')"),
        "timeline_stream": _q("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS n FROM logs GROUP BY 1"),
        "flow_sessions_stream": _q("""SELECT thread, start_ts, end_ts, n_entries, has_error FROM (
            SELECT thread, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_entries, bool_or(severity >= 4) AS has_error FROM (
              SELECT *, sum(brk) OVER (PARTITION BY thread ORDER BY ts, line_number ROWS UNBOUNDED PRECEDING) AS sid FROM (
                SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY thread ORDER BY ts, line_number))) // 1000 <= 600000 THEN 0 ELSE 1 END AS brk FROM logs))
            GROUP BY thread, sid)"""),
    }
