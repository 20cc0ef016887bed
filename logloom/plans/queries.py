"""Statements of the SQL layer over the test tables' lines, each over all lines, and their SQL for DuckDB.

Columns of lines are read as they were written; numeric tables are first rendered as lines, so that every statement takes the whole way from
the definition of a table over its extraction to the result. Statements named ``file_`` read text files, which are first written to the session's
shared folder; those named ``print_`` go through the command line and give the lines it prints; those named ``follow_`` follow a file that holds
the lines already, through a stream, and give what was handed over last; those named ``embed_`` go through the embedding interface.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from logloom import cli
from logloom.operators.lines import read_table, without_cr
from logloom.plans import tree
from logloom.plans.engine import Tables, compile_query
from logloom.plans.grammar import parse
from logloom.plans.planner import is_aggregate, needs_order, plan
from logloom.sources.lines import ReadLinesIterator
from logloom.sources.shared import lines_file, spool
from logloom.streaming.follow import follow_query

CONNECTIONS = """CREATE TABLE connections(
    line = 'connection from ([0-9.]+) \\\\((.+)?\\\\) at ([a-zA-Z]+) ([a-zA-Z]+) ([0-9]+) ([0-9]+):([0-9]+):([0-9]+) ([0-9]+)',
    line[1] => ip TEXT, line[2] => hostname TEXT, line[9] => year INT, line[4] => month TEXT,
    line[5] => day INT, line[6] => hour INT, line[7] => minute INT, line[8] => second INT);"""
CONNECTIONS_DEFAULT = CONNECTIONS.replace("hostname TEXT", "hostname TEXT DEFAULT 'unknown'")
CONNECTIONS_TIMED = CONNECTIONS[: CONNECTIONS.index("line[9]")] + "line[9], line[4], line[5], line[6], line[7], line[8] => timestamp TIMESTAMP);"
CONNECTIONS_ARRAY = CONNECTIONS_TIMED.replace("TIMESTAMP", "TEXT[]")
CONNECTIONS_SPLIT = """CREATE TABLE connections(
    line = split ';',
    line[1] => ip TEXT, line[2] => hostname TEXT, line[3] => year INT NOT NULL, line[4] => month TEXT,
    line[5] => day INT, line[6] => hour INT, line[7] => minute INT, line[8] => second INT);"""
SSH = r"CREATE TABLE ssh(line = 'rhost=([a-zA-Z0-9_\\.\\-]+)\\s+user=(\\w+)', line[1] => hostname TEXT, line[2] => username TEXT);"
CLIENTS = """CREATE TABLE clients({ .timestamp } => timestamp INT, { .metadata.device_id } => device_id INT CONVERT,
    { .metadata.mac_address } => mac_address TEXT, { .events } => events TEXT[]);"""
DUMMY = r"""CREATE TABLE dummy1(line = 'hostname: (.*), min: (\\d+)', line[1] => hostname TEXT, line[2] => min INT);
CREATE TABLE dummy2(line = 'hostname: (.*), max: (\\d+)', line[1] => hostname TEXT, line[2] => max INT);"""
LINEITEM = """CREATE TABLE lineitem(line = split ';', line[1] => orderkey INT NOT NULL, line[2] => linenumber INT, line[3] => quantity REAL,
    line[4] => discount REAL, line[5] => flag TEXT, line[6] => status TEXT TRIM);"""
EVENTS = r"""CREATE TABLE events(p = '^(\\d+) (\\d+)-(\\d+)-(\\d+)T(\\d+):(\\d+):(\\d+) user=(\\d+) (\\w+)( big)?(?: k=(\\d*))?$',
    p[1] => id INT, p[2], p[3], p[4], p[5], p[6], p[7] => at TIMESTAMP, p[8] => user_id INT, p[9] => kind TEXT, p[10] => big BOOLEAN, p[11] => k INT, p[11] => ktext TEXT);"""
PROPS = "CREATE TABLE props({ .k } => k INT);"
ORDERS = """CREATE TABLE orders(o = split ';', o[1] => orderkey INT NOT NULL, o[2] => custkey INT, o[3] => status TEXT);
CREATE TABLE customer(c = split ';', c[1] => custkey INT NOT NULL, c[2] => segment TEXT);"""
EMBEDDINGS = "CREATE TABLE embeddings({ .id } => id INT, { .v } => v REAL[], { .v[0] } => first REAL);"
NESTED = "CREATE TABLE embeddings({ .id } => id INT, { .m } => m REAL[][], { .m[1][0] } => third REAL);"
MOMENTS = r"""CREATE TABLE moments('^(\\d+)' => id INT, u = ' u (\\d+) (\\d+) (\\d+) (\\d+) (\\d+) (\\d+) (\\d+)', m = ' m (\\d+) (\\d+) (\\d+) (\\d+)$',
    u[1], u[2], u[3], u[4], u[5], u[6], u[7] => at TIMESTAMP MICROSECONDS, u[1], u[2], u[3], m[1], m[2], m[3], m[4] => coarse TIMESTAMP, u[1], u[2], u[3] => date INT[]);"""


def _of_kind(kind: str):
    def lines(spark: SparkSession, d: str) -> DataFrame:
        files = read_table(spark, d, "log_files").where(F.col("kind") == kind).select("file_id")
        return read_table(spark, d, "connections").select("file_id", "line", "conn_id").join(files, "file_id").select(without_cr(F.col("line")).alias("value"), F.struct("conn_id").alias("_order"))

    return lines


def _column(table: str, key: str):
    def lines(spark: SparkSession, d: str) -> DataFrame:
        return read_table(spark, d, table).select(without_cr(F.col("line")).alias("value"), F.struct(key).alias("_order"))

    return lines


def _rendered(table: str, expression: str, key: str):
    def lines(spark: SparkSession, d: str) -> DataFrame:
        return read_table(spark, d, table).select(F.expr(expression).alias("value"), F.expr(f"struct({key})").alias("_order"))

    return lines


_LINES = {
    "log": _of_kind("log"),
    "split": _of_kind("split"),
    "ssh": _column("ssh", "ssh_id"),
    "clients": _column("clients", "row_id"),
    "dummy1": _column("dummy1", "line"),
    "dummy2": _column("dummy2", "line"),
    "lineitem": _rendered("lineitem", "concat_ws(';', l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, concat(' ', l_linestatus, ' '))", "l_orderkey, l_linenumber, l_returnflag"),
    "events": _rendered("events", "concat(event_id, ' ', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), ' user=', user_id, ' ', event_type, if(value > 50, ' big', ''), if(event_id % 3 = 0, '', concat(' k=', if(event_id % 3 = 1, '', cast(get_json_object(props, '$.k') as string)))))", "event_id"),
    "moments": _rendered("events", "concat(event_id, ' u ', date_format(ts, 'yyyy MM dd HH mm ss SSSSSS'), ' m ', date_format(ts, 'HH mm ss SSS'))", "event_id"),
    "nested": _rendered("embeddings", "to_json(named_struct('id', vec_id, 'm', array(transform(slice(embedding, 1, 2), x -> cast(x as double)), transform(slice(embedding, 3, 2), x -> cast(x as double)))))", "vec_id"),
    "props": _rendered("events", "props", "event_id"),
    "orders": _rendered("orders", "concat_ws(';', o_orderkey, if(o_orderkey % 7 = 0, '', cast(o_custkey as string)), o_orderstatus)", "o_orderkey"),
    "customer": _rendered("customer", "concat_ws(';', c_custkey, c_mktsegment)", "c_custkey"),
    "embeddings": _rendered("embeddings", "to_json(named_struct('id', vec_id, 'v', transform(embedding, x -> cast(x as double))))", "vec_id"),
}

_SPLIT_SQL = "FROM connections JOIN log_files USING (file_id) WHERE kind = 'split' AND \"year\" IS NOT NULL"
_LOG_SQL = "FROM connections JOIN log_files USING (file_id) WHERE kind = 'log' AND ip IS NOT NULL"
_TIME_SQL = "make_timestamp(\"year\", list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(left(\"month\", 3))), \"day\", \"hour\", \"minute\", \"second\"::DOUBLE)"
_K = "CASE WHEN event_id % 3 = 2 THEN try_cast(props->>'k' AS BIGINT) END"

#: name -> (definitions, lines, statement, SQL)
STATEMENTS: dict[str, tuple[str, str, str, str]] = {
    "log_project": (CONNECTIONS, "log", "SELECT ip, hostname FROM connections WHERE hostname IS NOT NULL", f"SELECT ip, hostname {_LOG_SQL} AND hostname IS NOT NULL"),
    "log_all_columns": (CONNECTIONS, "log", "SELECT * FROM connections", f'SELECT ip, hostname, "year", "month", "day", "hour", "minute", "second" {_LOG_SQL}'),
    "log_filter": (CONNECTIONS, "log", "SELECT ip, hostname, year, month, day, hour, minute, second FROM connections WHERE day >= 5", f'SELECT ip, hostname, "year", "month", "day", "hour", "minute", "second" {_LOG_SQL} AND "day" >= 5'),
    "log_aggregate": (CONNECTIONS, "log", "SELECT hour, COUNT(*) AS n, MAX(minute) AS last FROM connections WHERE day >= 5 GROUP BY hour", f'SELECT "hour", count(*) n, max("minute") "last" {_LOG_SQL} AND "day" >= 5 GROUP BY "hour"'),
    "log_having": (CONNECTIONS, "log", "SELECT hostname, COUNT() AS n FROM connections HAVING COUNT() > 22 AND hostname IS NOT NULL GROUP BY hostname", f"SELECT hostname, count(*) n {_LOG_SQL} AND hostname IS NOT NULL GROUP BY hostname HAVING count(*) > 22"),
    "log_count_column": (CONNECTIONS, "log", "SELECT day, COUNT(hostname) AS n FROM connections GROUP BY day", f'SELECT "day", count(hostname) n {_LOG_SQL} GROUP BY "day" HAVING count(hostname) > 0'),
    "log_count_distinct": (CONNECTIONS, "log", "SELECT day, COUNT(DISTINCT ip) AS n FROM connections GROUP BY day", f'SELECT "day", count(DISTINCT ip) n {_LOG_SQL} GROUP BY "day"'),
    "log_distinct": (CONNECTIONS, "log", "SELECT DISTINCT hostname FROM connections", f"SELECT DISTINCT hostname {_LOG_SQL}"),
    "log_default": (CONNECTIONS_DEFAULT, "log", "SELECT hostname, COUNT(*) AS n FROM connections GROUP BY hostname", "SELECT coalesce(hostname, 'unknown') hostname, count(*) n FROM connections JOIN log_files USING (file_id) WHERE kind = 'log' GROUP BY ALL"),
    "log_hosts_by_pattern": (CONNECTIONS, "log", "SELECT ip, hostname FROM connections WHERE regexp_matches(hostname, '\\\\.example$')", f"SELECT ip, hostname {_LOG_SQL} AND regexp_matches(hostname, '\\.example$')"),
    "log_timestamp": (CONNECTIONS_TIMED, "log", "SELECT date_trunc('hour', timestamp) AS hour, COUNT(*) AS n, MIN(timestamp) AS first, MAX(timestamp) AS last FROM connections GROUP BY date_trunc('hour', timestamp)", f"SELECT date_trunc('hour', t) \"hour\", count(*) n, min(t) \"first\", max(t) \"last\" FROM (SELECT {_TIME_SQL} t {_LOG_SQL}) GROUP BY 1"),
    "log_array": (CONNECTIONS_ARRAY, "log", "SELECT ip, timestamp[2] AS month, array_length(timestamp) AS n FROM connections WHERE timestamp[3] = '2'", f'SELECT ip, "month", 6::BIGINT n {_LOG_SQL} AND "day" = 2'),
    "log_unique_hours": (CONNECTIONS, "log", "SELECT hostname, array_unique(array_agg(hour)) AS hours FROM connections GROUP BY hostname", f'SELECT hostname, list_sort(list(DISTINCT "hour")) "hours" {_LOG_SQL} GROUP BY hostname'),
    "log_input": (CONNECTIONS, "log", "SELECT input FROM connections WHERE hour = 3", f"SELECT regexp_replace(line, '\\r$', '') \"input\" {_LOG_SQL} AND \"hour\" = 3"),
    "log_limit_groups": (CONNECTIONS, "log", "SELECT ip, COUNT(*) AS n FROM connections GROUP BY ip LIMIT 7", f"SELECT ip, count(*) n {_LOG_SQL} GROUP BY ip ORDER BY ip LIMIT 7"),
    "split_rows": (CONNECTIONS_SPLIT, "split", "SELECT * FROM connections", f'SELECT ip, hostname, "year", "month", "day", "hour", "minute", "second" {_SPLIT_SQL}'),
    "split_group": (CONNECTIONS_SPLIT, "split", "SELECT month, hour, COUNT(*) AS n, SUM(second) AS s, AVG(second) AS mean FROM connections GROUP BY month, hour", f'SELECT "month", "hour", count(*) n, sum("second")::BIGINT s, (sum("second") // count("second"))::BIGINT mean {_SPLIT_SQL} GROUP BY ALL'),
    "ssh_rows": (SSH, "ssh", "SELECT hostname, username FROM ssh", "SELECT hostname, username FROM ssh WHERE hostname IS NOT NULL"),
    "ssh_users": (SSH, "ssh", "SELECT hostname, COUNT(DISTINCT username) AS users, COUNT(*) AS n FROM ssh GROUP BY hostname HAVING COUNT(*) > 3", "SELECT hostname, count(DISTINCT username) users, count(*) n FROM ssh WHERE hostname IS NOT NULL GROUP BY hostname HAVING count(*) > 3"),
    "json_rows": (CLIENTS, "clients", "SELECT timestamp, device_id, mac_address, events FROM clients", "SELECT \"timestamp\", device_id, mac_address, events FROM clients WHERE \"timestamp\" IS NOT NULL OR device_id IS NOT NULL OR mac_address IS NOT NULL OR events IS NOT NULL"),
    "json_items": (CLIENTS, "clients", "SELECT device_id, events[1] AS first, array_length(events) AS n FROM clients WHERE device_id IS NOT NULL", "SELECT device_id, events[1] \"first\", len(events) n FROM clients WHERE device_id IS NOT NULL"),
    "json_filter": (PROPS, "props", "SELECT COUNT(*) AS n, MIN(k) AS low, MAX(k) AS high FROM props WHERE k > 50", "SELECT count(*) n, min(k) low, max(k) high FROM (SELECT try_cast(props->>'k' AS BIGINT) k FROM events) WHERE k > 50 HAVING count(*) > 0"),
    "json_reals": (EMBEDDINGS, "embeddings", "SELECT id, v, array_length(v) AS n, first FROM embeddings", "SELECT vec_id id, embedding::DOUBLE[] v, len(embedding) n, embedding[1]::DOUBLE \"first\" FROM embeddings"),
    "json_nested": (NESTED, "nested", "SELECT id, m[1] AS pair, m[2][1] AS x, third, array_length(m) AS n FROM embeddings", "SELECT vec_id id, embedding[1:2]::DOUBLE[] pair, embedding[3]::DOUBLE x, embedding[3]::DOUBLE third, 2::BIGINT n FROM embeddings"),
    "join_inner": (DUMMY, "dummy1", "SELECT dummy1.hostname, min, dummy2.max FROM dummy1 INNER JOIN dummy2::'dummy2' ON dummy1.hostname = dummy2.hostname", 'SELECT a.hostname "dummy1.hostname", a."min", b."max" "dummy2.max" FROM dummy1 a JOIN dummy2 b ON a.hostname IS NOT DISTINCT FROM b.hostname'),
    "join_outer": (DUMMY, "dummy1", "SELECT * FROM dummy1 OUTER JOIN dummy2::'dummy2' ON dummy2.hostname = dummy1.hostname", 'SELECT a.hostname, a."min", b.hostname "dummy2.hostname", b."max" FROM dummy1 a LEFT JOIN dummy2 b ON a.hostname IS NOT DISTINCT FROM b.hostname'),
    "join_count": (DUMMY, "dummy1", "SELECT hostname, COUNT(*) AS n FROM dummy1 OUTER JOIN dummy2::'dummy2' ON dummy1.hostname = dummy2.hostname GROUP BY hostname", "SELECT a.hostname, count(*) n FROM dummy1 a JOIN dummy2 b ON a.hostname IS NOT DISTINCT FROM b.hostname GROUP BY a.hostname"),
    "join_orders": (ORDERS, "orders", "SELECT segment, status, COUNT(*) AS n FROM orders INNER JOIN customer::'customer' ON orders.custkey = customer.custkey GROUP BY segment, status", "SELECT c_mktsegment segment, o_orderstatus status, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0 GROUP BY ALL"),
    "item_sums": (LINEITEM, "lineitem", "SELECT flag, status, SUM(quantity) AS sum_qty, AVG(quantity) AS avg_qty, COUNT(*) AS n, AVG(linenumber) AS avg_line FROM lineitem GROUP BY flag, status", "SELECT l_returnflag flag, l_linestatus status, sum(l_quantity) sum_qty, sum(l_quantity) / count(*) avg_qty, count(*) n, (sum(l_linenumber) // count(*))::BIGINT avg_line FROM lineitem GROUP BY ALL"),
    "item_spread": (LINEITEM, "lineitem", "SELECT flag, (STDDEV(quantity) * 1000000.0 + 0.5)::int AS dev, (VARIANCE(linenumber) * 1000000.0 + 0.5)::int AS var FROM lineitem GROUP BY flag", "SELECT l_returnflag flag, floor(stddev_pop(l_quantity) * 1000000 + 0.5)::BIGINT dev, floor(var_pop(l_linenumber) * 1000000 + 0.5)::BIGINT \"var\" FROM lineitem GROUP BY ALL"),
    "item_percentile": (LINEITEM, "lineitem", "SELECT status, PERCENTILE(quantity, 0.5) AS mid, PERCENTILE(linenumber, 0.9) AS high, PERCENTILE(quantity, 1.0) AS top FROM lineitem GROUP BY status", "SELECT l_linestatus status, list_sort(list(l_quantity))[floor(0.5 * count(*))::BIGINT + 1] mid, list_sort(list(l_linenumber))[floor(0.9 * count(*))::BIGINT + 1]::BIGINT high, max(l_quantity) top FROM lineitem GROUP BY ALL"),
    "item_flags": (LINEITEM, "lineitem", "SELECT flag, BOOL_AND(quantity > 0.0) AS every, BOOL_OR(quantity >= 50.0) AS some, MAX(quantity) * 2.0 - MIN(quantity) AS span FROM lineitem GROUP BY flag", "SELECT l_returnflag flag, bool_and(l_quantity > 0) \"every\", bool_or(l_quantity >= 50) \"some\", max(l_quantity) * 2 - min(l_quantity) span FROM lineitem GROUP BY ALL"),
    "item_strings": (LINEITEM, "lineitem", "SELECT orderkey, STRING_AGG(flag, ',') AS flags, ARRAY_AGG(linenumber) AS numbers FROM lineitem GROUP BY orderkey", "SELECT l_orderkey orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) flags, list(l_linenumber::BIGINT ORDER BY l_linenumber) numbers FROM lineitem GROUP BY ALL"),
    "item_distinct_groups": (LINEITEM, "lineitem", "SELECT DISTINCT COUNT(*) AS n FROM lineitem GROUP BY orderkey", "SELECT DISTINCT n FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey)"),
    "item_keys": (LINEITEM, "lineitem", "SELECT flag, status FROM lineitem GROUP BY status, flag", "SELECT DISTINCT l_returnflag flag, l_linestatus status FROM lineitem"),
    "event_optional": (EVENTS, "events", "SELECT id, big, k, ktext FROM events", f"SELECT event_id id, \"value\" > 50 big, {_K} k, CASE event_id % 3 WHEN 1 THEN '' WHEN 2 THEN props->>'k' END ktext FROM events"),
    "event_times": (EVENTS, "events", "SELECT id, EXTRACT(year FROM at) AS y, EXTRACT(month FROM at) AS mo, EXTRACT(day FROM at) AS d, EXTRACT(hour FROM at) AS h, EXTRACT(minute FROM at) AS mi, EXTRACT(second FROM at) AS s, EXTRACT(epoch FROM at) AS e FROM events", "SELECT event_id id, year(t) y, month(t) mo, day(t) d, hour(t) h, minute(t) mi, second(t) s, epoch(t)::DOUBLE e FROM (SELECT event_id, date_trunc('second', ts) t FROM events)"),
    "event_intervals": (EVENTS, "events", "SELECT user_id, (MAX(at) - MIN(at))::int AS span, (MAX(at) - MIN(at))::real AS span_real FROM events GROUP BY user_id", "SELECT user_id, epoch(max(t))::BIGINT - epoch(min(t))::BIGINT span, (epoch(max(t)) - epoch(min(t)))::DOUBLE span_real FROM (SELECT user_id, date_trunc('second', ts) t FROM events) GROUP BY user_id"),
    "event_shift": (EVENTS, "events", "SELECT id, at - '1:30:00'::interval AS before, '0:0:90'::interval + at AS after, at > '2024-01-15 12:00:00' AS late FROM events", "SELECT event_id id, t - INTERVAL 90 MINUTE \"before\", t + INTERVAL 90 SECOND \"after\", t > TIMESTAMP '2024-01-15 12:00:00' late FROM (SELECT event_id, date_trunc('second', ts) t FROM events)"),
    "event_nulls": (EVENTS, "events", "SELECT id, k = NULL AS eq, k != 5 AS ne, NOT (k = 5) AS no, k IS NULL AS empty, k IS NOT 5 AS other, k IN (5, NULL) AS listed, k NOT IN (5, 6) AS unlisted, k + 1 AS more FROM events", f"SELECT event_id id, false eq, coalesce(k <> 5, false) ne, NOT coalesce(k = 5, false) \"no\", k IS NULL \"empty\", k IS DISTINCT FROM 5 other, (k = 5 OR k IS NULL) listed, coalesce(k NOT IN (5, 6), true) unlisted, k + 1 more FROM (SELECT event_id, {_K} k FROM events)"),
    "event_case": (EVENTS, "events", "SELECT kind, SUM(CASE WHEN k > 50 THEN 1 WHEN k IS NULL THEN 100 ELSE 0 END) AS score FROM events WHERE kind IN ('click', 'view') OR big AND user_id > 10 GROUP BY kind", f"SELECT event_type kind, sum(CASE WHEN k > 50 THEN 1 WHEN k IS NULL THEN 100 ELSE 0 END)::BIGINT score FROM (SELECT *, {_K} k FROM events) WHERE (event_type IN ('click', 'view') OR \"value\" > 50) AND user_id > 10 GROUP BY event_type"),
    "event_math": (EVENTS, "events", "SELECT id, -user_id / 7 AS q, abs(-user_id) AS a, pow(k, 2) AS sq, sqrt(k::real) AS root, id::real / 7.0 AS part, pow(k::real, 2.0) AS square, greatest(k, user_id) AS hi, least(k, user_id) AS lo, id::real / 0.0 > 0.0 AND id > 0 AS inf FROM events", f"SELECT event_id id, (-(user_id // 7))::BIGINT q, user_id a, (k * k)::BIGINT sq, sqrt(k::DOUBLE) root, event_id::DOUBLE / 7.0 part, (k * k)::DOUBLE square, CASE WHEN k IS NOT NULL THEN greatest(k, user_id) END hi, CASE WHEN k IS NOT NULL THEN least(k, user_id) END lo, event_id > 0 inf FROM (SELECT *, {_K} k FROM events)"),
    "event_text": (EVENTS, "events", "SELECT id, upper(kind) AS up, lower(upper(kind)) AS low, length(kind) AS len, id::text AS digits, k::text AS ktext, kind::text AS same, (id::real)::text AS two, big::text AS flag, at::text AS stamp, ARRAY[kind, NULL]::text AS pair FROM events", f"SELECT event_id id, upper(event_type) up, lower(event_type) low, length(event_type) len, event_id::VARCHAR digits, coalesce(k::VARCHAR, 'NULL') ktext, event_type same, event_id::VARCHAR || '.00' two, (\"value\" > 50)::VARCHAR flag, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.000') stamp, '{{''' || event_type || ''', NULL}}' pair FROM (SELECT *, {_K} k FROM events)"),
    "event_arrays": (EVENTS, "events", "SELECT id, array_cat(ARRAY[id, k], ARRAY[user_id]) AS joined, array_append(ARRAY[kind], 'x') AS tail, array_prepend('x', ARRAY[kind]) AS head, array_unique(ARRAY[k, user_id, NULL, k]) AS u FROM events", f"SELECT event_id id, [event_id, k, user_id] joined, [event_type, 'x'] tail, ['x', event_type] head, list_sort(CASE WHEN k IS NULL OR k = user_id THEN [NULL, user_id] ELSE [NULL, k, user_id] END, 'ASC', 'NULLS FIRST') u FROM (SELECT *, {_K} k FROM events)"),
    "moment_parts": (MOMENTS, "moments", "SELECT id, at, coarse, date FROM moments", "SELECT event_id id, ts \"at\", date_trunc('millisecond', ts) coarse, [year(ts), month(ts), day(ts)] \"date\" FROM events"),
    "moment_units": (
        MOMENTS, "moments",
        "SELECT id, date_trunc('year', at) AS y, date_trunc('month', at) AS mo, date_trunc('day', at) AS d, date_trunc('minute', at) AS mi, date_trunc('second', at) AS s, date_trunc('milliseconds', at) AS ms, date_trunc('microseconds', at) AS us FROM moments",
        "SELECT event_id id, date_trunc('year', ts)::TIMESTAMP y, date_trunc('month', ts)::TIMESTAMP mo, date_trunc('day', ts)::TIMESTAMP d, date_trunc('minute', ts) mi, date_trunc('second', ts) s, date_trunc('millisecond', ts) ms, ts us FROM events",
    ),
    "moment_spans": (
        MOMENTS, "moments",
        "SELECT id, ((date_trunc('second', at) - date_trunc('day', at)) + '0:1:30'::interval - '1:0:0'::interval)::int AS span, at - '0:0:5'::interval AS before FROM moments",
        "SELECT event_id id, (epoch(date_trunc('second', ts)) - epoch(date_trunc('day', ts)) + 90 - 3600)::BIGINT span, ts - INTERVAL 5 SECOND \"before\" FROM events",
    ),
    "item_limit": (LINEITEM, "lineitem", "SELECT 'x' AS c FROM lineitem LIMIT 5", "SELECT 'x' c FROM lineitem LIMIT 5"),
    "event_made_time": (EVENTS, "events", "SELECT id, make_timestamp(2024, 2, 29, EXTRACT(hour FROM at), 5, 6, 7) AS made, make_timestamp(2023, 2, 29, 0, 0, 0, 0) AS none, now() > make_timestamp(2020, 1, 1, 0, 0, 0, 0) AS past FROM events", "SELECT event_id id, make_timestamp(2024, 2, 29, hour(ts), 5, 6.000007) made, NULL::TIMESTAMP \"none\", true past FROM events"),
}


#: name -> (definitions, lines of the files, in this order, statement, in which {0} is the first file, SQL); without {0} all files are given beside it.
FILE_STATEMENTS: dict[str, tuple[str, tuple[str, ...], str, str]] = {
    "file_rows": (CONNECTIONS, ("split", "log"), "SELECT ip, hostname, day FROM connections WHERE hour >= 12", f'SELECT ip, hostname, "day" {_LOG_SQL} AND "hour" >= 12'),
    "file_inline": (CONNECTIONS, ("log",), "SELECT hour, COUNT(*) AS n, MAX(minute) AS last FROM connections::'{0}' GROUP BY hour", f'SELECT "hour", count(*) n, max("minute") "last" {_LOG_SQL} GROUP BY "hour"'),
    "file_split": (CONNECTIONS_SPLIT, ("split",), "SELECT * FROM connections::'{0}'", f'SELECT ip, hostname, "year", "month", "day", "hour", "minute", "second" {_SPLIT_SQL}'),
    "file_json": (CLIENTS, ("clients",), "SELECT device_id, COUNT(*) AS n, MAX(timestamp) AS last FROM clients::'{0}' GROUP BY device_id", 'SELECT device_id, count(*) n, max("timestamp") "last" FROM clients WHERE "timestamp" IS NOT NULL OR device_id IS NOT NULL OR mac_address IS NOT NULL OR events IS NOT NULL GROUP BY device_id'),
    "file_join": (ORDERS, ("orders", "customer"), "SELECT segment, COUNT(*) AS n FROM orders::'{0}' INNER JOIN customer::'{1}' ON orders.custkey = customer.custkey GROUP BY segment", "SELECT c_mktsegment segment, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0 GROUP BY ALL"),
    "file_outer": (DUMMY, ("dummy1", "dummy2"), "SELECT * FROM dummy1::'{0}' OUTER JOIN dummy2::'{1}' ON dummy2.hostname = dummy1.hostname WHERE min > 2", 'SELECT a.hostname, a."min", b.hostname "dummy2.hostname", b."max" FROM dummy1 a LEFT JOIN dummy2 b ON a.hostname IS NOT DISTINCT FROM b.hostname WHERE a."min" > 2'),
    "file_order": (SSH, ("ssh",), "SELECT hostname, STRING_AGG(username, ',') AS users FROM ssh::'{0}' GROUP BY hostname", "SELECT hostname, string_agg(username, ',' ORDER BY ssh_id) users FROM ssh WHERE hostname IS NOT NULL GROUP BY hostname"),
    "file_first_seen": (SSH, ("ssh",), "SELECT DISTINCT username FROM ssh::'{0}' LIMIT 5", "SELECT username FROM ssh WHERE hostname IS NOT NULL GROUP BY username ORDER BY min(ssh_id) LIMIT 5"),
}
_PRINTED = "SELECT hour, COUNT(*) AS n, MAX(ip) AS top FROM connections::'{0}' GROUP BY hour"
_PRINTED_SQL = f'FROM (SELECT "hour", count(*) n, max(ip) top {_LOG_SQL} GROUP BY "hour")'
#: name -> (the format in which the command line prints the result, statement, SQL)
PRINT_STATEMENTS: dict[str, tuple[str, str, str]] = {
    "print_text": ("text", _PRINTED, f"""SELECT format('hour: {{}}, n: {{}}, top: ''{{}}''', "hour", n, top) line {_PRINTED_SQL}"""),
    "print_json": ("json", _PRINTED, f"""SELECT '{{"hour":' || "hour" || ',"n":' || n || ',"top":"' || top || '"}}' line {_PRINTED_SQL}"""),
    "print_csv": ("csv", _PRINTED, f"""SELECT 'hour;n;top' line UNION ALL SELECT format('{{}};{{}};''{{}}''', "hour", n, top) {_PRINTED_SQL}"""),
}


#: name -> (statement over ssh, SQL)
FOLLOW_STATEMENTS: dict[str, tuple[str, str]] = {
    "follow_rows": ("SELECT hostname, username FROM ssh WHERE length(username) > 4", "SELECT hostname, username FROM ssh WHERE length(username) > 4 AND hostname IS NOT NULL"),
    "follow_groups": ("SELECT hostname, COUNT(*) AS n, COUNT(DISTINCT username) AS users, MAX(username) AS last, PERCENTILE(username, 0.5) AS mid, STRING_AGG(username, ' ') AS list FROM ssh GROUP BY hostname HAVING COUNT(*) > 1",
        "SELECT hostname, count(*) n, count(DISTINCT username) users, max(username) \"last\", list_sort(list(username))[floor(0.5 * count(*))::BIGINT + 1] mid, string_agg(username, ' ' ORDER BY ssh_id) \"list\" FROM ssh WHERE hostname IS NOT NULL GROUP BY hostname HAVING count(*) > 1"),
    "follow_distinct": ("SELECT DISTINCT username FROM ssh", "SELECT DISTINCT username FROM ssh WHERE hostname IS NOT NULL"),
    "follow_distinct_groups": ("SELECT DISTINCT COUNT(*) AS n FROM ssh GROUP BY username", "SELECT DISTINCT n FROM (SELECT count(*) n FROM ssh WHERE hostname IS NOT NULL GROUP BY username)"),
    "follow_limit": ("SELECT 'x' AS c FROM ssh LIMIT 7", "SELECT 'x' c FROM ssh WHERE hostname IS NOT NULL LIMIT 7"),
}
EMBED_SQL = {
    "embed_iterator": "SELECT username, count(*) n FROM ssh WHERE hostname IS NOT NULL GROUP BY username",
    "embed_callback": "SELECT hostname, username FROM ssh WHERE hostname IS NOT NULL",
    "embed_describe": "SELECT * FROM (VALUES ('orderkey', 'int', false, NULL::VARCHAR), ('custkey', 'int', true, NULL), ('status', 'text', true, NULL)) t(\"Column\", \"Type\", \"Nullable\", \"Default\")",
    "embed_statistics": "SELECT count(*)::BIGINT n, count(hostname)::BIGINT n_rows FROM ssh WHERE line IS NOT NULL",
}


def _ssh_lines(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    return (r["value"] for r in _LINES["ssh"](spark, sf_dir).orderBy("_order").select("value").where("value IS NOT NULL").toLocalIterator())


def _ssh(spark: SparkSession) -> Tables:
    tables = Tables(spark)
    tables.add_table(SSH)
    return tables


def _follow_query(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query, handed = compile_query(statement), []
        path = spool(spark, _ssh_lines(spark, sf_dir))
        stream = follow_query(_ssh(spark), query, path, lambda names, types, rows: handed.append(rows), head=True)
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
        rows = [r for part in (handed[-1:] if is_aggregate(query) else handed) for r in part]
        result = _ssh(spark).plan([], query)
        return spark.createDataFrame([tuple(r) for r in rows], StructType([StructField(n, t.spark) for n, t in zip(result.names, result.types)]))

    return run


def embed_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ssh(spark).sql("SELECT username, COUNT(*) AS n FROM ssh GROUP BY username", _ssh_lines(spark, sf_dir))


def embed_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    handed: list[dict] = []
    _ssh(spark).execute_query_callback(ReadLinesIterator(lines_file(_LINES["ssh"](spark, sf_dir))), "SELECT hostname, username FROM ssh", handed.extend)
    return spark.createDataFrame([(r["hostname"], r["username"]) for r in handed], "hostname string, username string")


def embed_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    tables.add_table(ORDERS)
    return tables.describe("orders")


def embed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows, statistics = _ssh(spark).run_with_statistics([lines_file(_LINES["ssh"](spark, sf_dir))], "SELECT hostname FROM ssh")
    n_rows = sum(1 for _ in rows)
    return spark.createDataFrame([(statistics.lines, n_rows)], "n bigint, n_rows bigint")


def _text_files(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> list[str]:
    return [lines_file(_LINES[n](spark, sf_dir), "_order") for n in names]


def _file_query(definitions: str, files: tuple[str, ...], statement: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths, tables = _text_files(spark, sf_dir, files), Tables(spark)
        tables.add_table(definitions)
        return tables.sql(statement.format(*paths), None if "{0}" in statement else ReadLinesIterator(*paths))

    return run


def _print_query(form: str, statement: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables, printed = Tables(spark), []
        tables.add_table(CONNECTIONS)
        cli.run(tables, statement.format(*_text_files(spark, sf_dir, ("log",))), cli.arguments().parse_args(["--format", form]), printed.append)
        return spark.createDataFrame([(x,) for x in printed], "line string")

    return run


def _query(definitions: str, lines: str, statement: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = parse(definitions)
        tables = {t.name: t for t in ((parsed,) if isinstance(parsed, tree.TableDef) else parsed)}
        select = parse(statement)
        ordered = needs_order(select)

        def read(name: str) -> DataFrame:
            d = _LINES[name](spark, sf_dir)
            return d if ordered else d.drop("_order")

        return plan(select, tables, read(lines), read).df

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **{name: _query(*s[:3]) for name, s in STATEMENTS.items()},
        **{name: _file_query(*s[:3]) for name, s in FILE_STATEMENTS.items()},
        **{name: _print_query(*s[:2]) for name, s in PRINT_STATEMENTS.items()},
        **{name: _follow_query(s[0]) for name, s in FOLLOW_STATEMENTS.items()},
        **{f.__name__: f for f in (embed_iterator, embed_callback, embed_describe, embed_statistics)},
    }


def oracle_sql() -> dict[str, str]:
    return {**{name: s[3] for name, s in (STATEMENTS | FILE_STATEMENTS).items()}, **{name: s[2] for name, s in PRINT_STATEMENTS.items()}, **{name: s[1] for name, s in FOLLOW_STATEMENTS.items()}, **EMBED_SQL}
