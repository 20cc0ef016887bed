"""Queries of the general data-processing operators, each over its whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.badrows import CONNECTIONS, classify_rows
from logloom.operators.lines import MONTHS, host_key, once_per_line, read_table, usable_instant
from logloom.operators.logentries import log_entries
from logloom.operators.sessions import sessionize
from logloom.operators.treeagg import tree_count


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "connections").select("file_id", "line_no", "ip", usable_instant().alias("at_s")).where("at_s IS NOT NULL")
    return sessionize(once_per_line(rows), "ip", "at_s")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries(_with_file(spark, sf_dir, "log"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "connections").select("file_id", "line_no", host_key(F.col("hostname")).alias("host_key"), "ip").where("host_key IS NOT NULL")
    return tree_count(once_per_line(rows), "host_key", "ip", "n_lines", "n_ips")


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All delivered rows classified: copies are dropped by the queries, once only what they ask for is left."""
    return classify_rows(_with_file(spark, sf_dir, "split"), "line", CONNECTIONS, keep=("file_id", "line_no"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_rows(spark, sf_dir).where("reason IS NOT NULL").select("file_id", "line_no", "reason").distinct()


def p6_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bad lines with their first broken field."""
    return _split_rows(spark, sf_dir).where("reason IS NOT NULL").select("file_id", "line_no", "reason", "field").distinct()


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound lines as typed rows."""
    return _split_rows(spark, sf_dir).where("reason IS NULL").select("file_id", "line_no", "row.*").distinct()


def _with_file(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    files = read_table(spark, sf_dir, "log_files").where(F.col("kind") == kind).select("file_id", "opened_at")
    return read_table(spark, sf_dir, "connections").select("file_id", "line_no", "line").join(files, "file_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p6_found, p6_fields, p6_loaded)}


_MONTH_SQL = f"(map {{{', '.join(f"'{n}': {k}" for n, k in MONTHS.items())}}})[lower(month)]"
USABLE_SQL = f"""
SELECT file_id, line_no, any_value(ip) ip, any_value(hostname) hostname, any_value(at_s) at_s FROM (
  SELECT *, CASE WHEN ip <> '' AND year BETWEEN 1000 AND 9999 AND day BETWEEN 1 AND 31 AND hour BETWEEN 0 AND 23 AND minute BETWEEN 0 AND 59 AND second BETWEEN 0 AND 59
    THEN epoch(try_cast(format('{{:04d}}-{{:02d}}-{{:02d}} {{:02d}}:{{:02d}}:{{:02d}}', year, {_MONTH_SQL}::BIGINT, day, hour, minute, second) AS TIMESTAMP))::BIGINT END at_s FROM connections)
WHERE at_s IS NOT NULL GROUP BY file_id, line_no"""

_FIELD = '(?:"(?:[^"]|"")*"|[^";]*)'
_BARE = f"(CASE WHEN starts_with(f, '\"') THEN replace(substr(f, 2, length(f) - 2), '\"\"', '\"') ELSE f END)"
_BAD_SQL = rf"""
WITH l AS (SELECT file_id, line_no, regexp_replace(any_value(line), '\r$', '') line FROM connections JOIN log_files USING (file_id) WHERE kind = 'split' AND line IS NOT NULL GROUP BY file_id, line_no),
t AS (SELECT *, regexp_full_match(line, '{_FIELD}(?:;{_FIELD})*') q FROM l WHERE NOT regexp_full_match(line, '[\s\x{{FEFF}}]*')
  AND NOT regexp_full_match(lower(line), '\x{{FEFF}}?"?ip"?;"?hostname"?;"?year"?;"?month"?;"?day"?;"?hour"?;"?minute"?;"?second"?')),
v AS (SELECT *, CASE WHEN q THEN list_transform(regexp_extract_all(';' || line, ';({_FIELD})', 1), lambda f: {_BARE}) END v FROM t),
w AS (SELECT *, len(v) = 8 AND list_bool_and(list_transform(string_split(v[1], '.'), lambda o: regexp_full_match(o, '[0-9]{{1,3}}') AND coalesce(try_cast(o AS INT), 999) < 256)) AND len(string_split(v[1], '.')) = 4
    AND (v[2] = '' OR regexp_full_match(v[2], '[A-Za-z0-9_-]{{1,63}}(\.[A-Za-z0-9_-]{{1,63}})*\.?')) AND regexp_full_match(v[3], '[0-9]{{4}}') AND len(list_filter(v[5:8], lambda x: regexp_full_match(x, '[0-9]{{1,2}}'))) = 4 AND v[7]::VARCHAR <> ''
    AND {_MONTH_SQL.replace('lower(month)', 'lower(v[4])')} IS NOT NULL flat FROM v),
c AS (SELECT *, flat AND try_cast(format('{{:04d}}-{{:02d}}-{{:02d}} {{:02d}}:{{:02d}}:{{:02d}}', coalesce(try_cast(v[3] AS BIGINT), 0), coalesce({_MONTH_SQL.replace('lower(month)', 'lower(v[4])')}, 0)::BIGINT,
    coalesce(try_cast(v[5] AS BIGINT), 0), coalesce(try_cast(v[6] AS BIGINT), 99), coalesce(try_cast(v[7] AS BIGINT), 99), coalesce(try_cast(v[8] AS BIGINT), 99)) AS TIMESTAMP) IS NOT NULL AND v[3] >= '1000' AND coalesce(try_cast(v[8] AS BIGINT), 99) < 60 sound FROM w)"""

_REASON_SQL = "CASE WHEN NOT q THEN 'quoting' WHEN len(v) <> 8 THEN 'column_count' ELSE 'invalid_value' END"
_OCTET_SQL = "(?:[01]?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])"
_VALUES_SQL = {
    "ip": rf"{_OCTET_SQL}\.{_OCTET_SQL}\.{_OCTET_SQL}\.{_OCTET_SQL}", "hostname": r"(?:[A-Za-z0-9_-]{1,63}(?:\.[A-Za-z0-9_-]{1,63})*\.?)?", "year": "[0-9]{4}",
    "month": f"(?i:{'|'.join(MONTHS)})", "day": "[0-9]{1,2}", "hour": "[0-9]{1,2}", "minute": "[0-9]{1,2}", "second": "[0-9]{1,2}",
}


def _first_broken_sql() -> str:
    names, cases = list(_VALUES_SQL), ""
    for k, name in enumerate(names, 1):
        prefix = ";".join(f'(?:{_VALUES_SQL[x]}|"{_VALUES_SQL[x]}")' for x in names[:k])
        cases += f" WHEN NOT regexp_matches(line, '^(?:{prefix})(?:;|$)') THEN '{name}'"
    return f"CASE WHEN q AND len(v) <> 8 THEN NULL{cases} WHEN q THEN 'instant' END"


_LEVEL_SQL = "(map {'debug': 'DEBUG', 'trace': 'DEBUG', 'info': 'INFO', 'notice': 'INFO', 'warn': 'WARN', 'warning': 'WARN', 'error': 'ERROR', 'severe': 'ERROR', 'fatal': 'FATAL', 'crit': 'FATAL', 'panic': 'FATAL'})"
_NAMES_SQL = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"
_CLOCK = "([0-9]{2}:[0-9]{2}:[0-9]{2})"
#: The headers as one pattern each; their groups in the order of the names. ``y`` is the year of the file's opening.
_HEADER_SQL = {
    "syslog": (rf"^(?:<([0-9]{{1,3}})>)?([A-Z][a-z]{{2}}) ([ 0-9][0-9]) {_CLOCK} [^ ]+ ([^ \[\]:]+)(?:\[[0-9]+\])?: (.*)$", ["pri", "mon", "day", "clock", "name", "msg"], f"y || format('-{{:02d}}-', list_position({_NAMES_SQL}, h.mon)) || replace(h.day, ' ', '0') || ' ' || h.clock", "CASE WHEN h.pri = '' THEN '' ELSE ['FATAL', 'FATAL', 'FATAL', 'ERROR', 'WARN', 'INFO', 'INFO', 'DEBUG'][coalesce(try_cast(h.pri AS INT), 0) % 8 + 1] END"),
    "bracketed": (rf"^\[[A-Z][a-z]{{2}} ([A-Z][a-z]{{2}}) ([0-9]{{2}}) {_CLOCK} ([0-9]{{4}})\] \[([A-Za-z]+)\] \[([^\]]+)\] (.*)$", ["mon", "day", "clock", "year", "lvl", "name", "msg"], f"h.year || format('-{{:02d}}-', list_position({_NAMES_SQL}, h.mon)) || h.day || ' ' || h.clock", f"{_LEVEL_SQL}[lower(h.lvl)]"),
    "piped": (rf"^([0-9]{{2}})/([0-9]{{2}})/([0-9]{{4}}) {_CLOCK}\|([A-Za-z]+)\|([^|]+)\|(.*)$", ["day", "mon", "year", "clock", "lvl", "name", "msg"], "h.year || '-' || h.mon || '-' || h.day || ' ' || h.clock", f"{_LEVEL_SQL}[lower(h.lvl)]"),
    "epoch": (r"^([0-9]+)\.[0-9]+ ([A-Za-z]+)/([^ :]+): (.*)$", ["s", "lvl", "name", "msg"], "strftime(make_timestamp(h.s::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S')", f"{_LEVEL_SQL}[lower(h.lvl)]"),
    "initial": (rf"^([DIWEF])([0-9]{{2}})([0-9]{{2}}) {_CLOCK}\.[0-9]+ +[0-9]+ ([^ :]+):[0-9]+\] (.*)$", ["lvl", "mon", "day", "clock", "name", "msg"], "y || '-' || h.mon || '-' || h.day || ' ' || h.clock", "(map {'D': 'DEBUG', 'I': 'INFO', 'W': 'WARN', 'E': 'ERROR', 'F': 'FATAL'})[h.lvl]"),
    "dashed": (rf"^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}) {_CLOCK},[0-9]+ ([A-Za-z]+) +([^ ]+) - (.*)$", ["d", "clock", "lvl", "name", "msg"], "h.d || ' ' || h.clock", f"{_LEVEL_SQL}[lower(h.lvl)]"),
    "zoned": (rf"^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})T{_CLOCK}(?:\.[0-9]+)?(?:Z|([+-])([0-9]{{2}}):([0-9]{{2}})) ([A-Za-z]+) +\[([^\]]+)\] (.*)$", ["d", "clock", "sign", "zh", "zm", "lvl", "name", "msg"], "strftime((h.d || ' ' || h.clock)::TIMESTAMP - CASE WHEN h.sign = '' THEN INTERVAL 0 MINUTE ELSE to_minutes(coalesce(try_cast(h.sign || '1' AS BIGINT) * (try_cast(h.zh AS BIGINT) * 60 + try_cast(h.zm AS BIGINT)), 0)) END, '%Y-%m-%d %H:%M:%S')", f"{_LEVEL_SQL}[lower(h.lvl)]"),
}
_MEMBERS_SQL = {
    "json": ("starts_with(t, '{') AND json_valid(t)", "{'ts': t->>'$.ts', 'lvl': coalesce(t->>'$.lvl', ''), 'name': t->>'$.logger', 'msg': t->>'$.msg'}"),
    "pairs": ("regexp_matches(t, '^(ts|level)=[^ ]+ ')", """{'ts': regexp_extract(t, '(?:^| )ts=([^ ]+)', 1), 'lvl': regexp_extract(t, '(?:^| )level=([^ ]+)', 1), 'name': regexp_extract(t, ' component=([^ ]+)', 1), 'msg': (('"' || regexp_extract(t, ' msg="((?:[^"\\\\]|\\\\.)*)"', 1) || '"')::JSON)->>'$'}"""),
}


def _entries_sql() -> str:
    parts = [
        f"SELECT file_id, line_no, {time} entry_time, {level} level, h.name component, h.msg message FROM (SELECT *, regexp_extract(t, '{pattern}', {names}, 's') h FROM l WHERE regexp_matches(t, '{pattern}', 's'))"
        for pattern, names, time, level in _HEADER_SQL.values()
    ]
    stamp = "strftime(CASE WHEN regexp_full_match(h.ts, '[0-9]+') THEN make_timestamp((try_cast(h.ts AS BIGINT) // 1000) * 1000000) ELSE try_cast(replace(h.ts, 'Z', '') AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S')"
    parts += [f"SELECT file_id, line_no, {stamp}, CASE WHEN h.lvl = '' THEN '' ELSE {_LEVEL_SQL}[lower(h.lvl)] END, h.name, h.msg FROM (SELECT *, {members} h FROM l WHERE {where})" for where, members in _MEMBERS_SQL.values()]
    return f"""
WITH l AS (SELECT file_id, line_no, regexp_replace(any_value(line), '\r$', '') t, year(any_value(opened_at))::VARCHAR y FROM connections JOIN log_files USING (file_id) WHERE kind = 'log' AND line IS NOT NULL GROUP BY file_id, line_no),
h AS ({" UNION ALL ".join(parts)}),
g AS (SELECT l.*, h.* EXCLUDE (file_id, line_no), h.component IS NOT NULL head, max(CASE WHEN h.component IS NOT NULL THEN l.line_no END) OVER (PARTITION BY l.file_id ORDER BY l.line_no) first FROM l LEFT JOIN h ON l.file_id = h.file_id AND l.line_no = h.line_no)
SELECT file_id, first line_no, count(*)::BIGINT n_lines, max(entry_time) entry_time, max(level) level, max(component) component, string_agg(CASE WHEN head THEN message ELSE t END, chr(10) ORDER BY line_no) message
FROM g WHERE first IS NOT NULL GROUP BY file_id, first"""


_ENTRIES_SQL = _entries_sql()


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _ENTRIES_SQL,
        "p1_found": f"""
WITH u AS ({USABLE_SQL}), g AS (SELECT ip, at_s, CASE WHEN at_s - lag(at_s) OVER (PARTITION BY ip ORDER BY at_s) <= 1800 THEN 0 ELSE 1 END f FROM u),
s AS (SELECT ip, at_s, sum(f) OVER (PARTITION BY ip ORDER BY at_s RANGE UNBOUNDED PRECEDING) n FROM g)
SELECT ip, min(at_s) start_s, max(at_s) end_s, max(at_s) - min(at_s) duration_s, count(*)::BIGINT n_events FROM s GROUP BY ip, n""",
        "p3_found": """
WITH l AS (SELECT file_id, line_no, any_value(ip) ip, any_value(hostname) h FROM connections WHERE hostname IS NOT NULL GROUP BY file_id, line_no),
k AS (SELECT ip, regexp_replace(lower(CASE WHEN length(h) > 1 AND starts_with(h, '"') AND ends_with(h, '"') THEN substr(h, 2, length(h) - 2) ELSE h END), '\\.$', '') host_key FROM l)
SELECT host_key, count(*)::BIGINT n_lines, count(DISTINCT nullif(ip, ''))::BIGINT n_ips FROM k WHERE host_key <> '' GROUP BY host_key""",
        "p6_found": _BAD_SQL + "\nSELECT file_id, line_no, " + _REASON_SQL + " reason FROM c WHERE NOT coalesce(sound, false)",
        "p6_fields": _BAD_SQL + "\nSELECT file_id, line_no, " + _REASON_SQL + " reason, " + _first_broken_sql() + " field FROM c WHERE NOT coalesce(sound, false)",
        "p6_loaded": _BAD_SQL + "\nSELECT file_id, line_no, v[1] ip, v[2] hostname, v[3]::BIGINT \"year\", v[4] \"month\", v[5]::BIGINT \"day\", v[6]::BIGINT \"hour\", v[7]::BIGINT \"minute\", v[8]::BIGINT \"second\" FROM c WHERE sound",
    }
