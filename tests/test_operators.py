"""The general operators on small inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
from collections import defaultdict
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logloom.operators.badrows import CONNECTIONS, Field, RowSchema, classify_rows
from logloom.operators.lines import host_key, instant_seconds, once_per_line
from logloom.operators.logentries import Chars, HeaderMachine, grammar, log_entries, read_header, scan_object, scan_pairs
from logloom.operators.sessions import sessionize
from logloom.operators.tasks import task_count, tree_levels
from logloom.operators.treeagg import tree_count
from logloom.queries import queries as general_queries


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Lines


def test_instants(spark):
    cases = [
        ((2005, "May", 6, 14, 2, 3), datetime(2005, 5, 6, 14, 2, 3)),
        ((2004, "FEB", 29, 0, 0, 0), datetime(2004, 2, 29)),
        ((2005, "Feb", 29, 0, 0, 0), None),
        ((1900, "feb", 29, 0, 0, 0), None),
        ((2000, "feb", 29, 23, 59, 59), datetime(2000, 2, 29, 23, 59, 59)),
        ((2005, "Sept", 30, 1, 1, 1), datetime(2005, 9, 30, 1, 1, 1)),
        ((2005, '"May"', 6, 1, 1, 1), None),
        ((2005, "May", 6, 24, 0, 0), None),
        ((2005, "May", 6, 23, 60, 0), None),
        ((2005, "May", 6, 23, 0, 60), None),
        ((5, "May", 6, 23, 0, 0), None),
        ((2005, None, 6, 23, 0, 0), None),
        ((2005, "May", 2**62, 23, 0, 0), None),
        ((1969, "Dec", 31, 23, 59, 59), datetime(1969, 12, 31, 23, 59, 59)),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, y bigint, m string, d bigint, h bigint, mi bigint, s bigint")
    got = [r[0] for r in df.select("i", instant_seconds(*map(F.col, ("y", "m", "d", "h", "mi", "s"))).alias("t")).orderBy("i").select("t").collect()]
    assert got == [None if w is None else int(w.replace(tzinfo=timezone.utc).timestamp()) for _, w in cases]


def test_host_keys(spark):
    cases = {'"A.b"': "a.b", "A.B.": "a.b", "a..": "a.", '"': '"', '""': None, ".": None, "": None, None: None, '"x': '"x', " X ": " x ", '"a."': "a"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r[0]: r[1] for r in df.select("h", host_key(F.col("h"))).collect()} == cases


# Sessions


def sessions_by_hand(data, gap):
    by, out = defaultdict(list), []
    for u, t in data:
        if u is not None and t is not None:
            by[u].append(t)
    for u, ts in by.items():
        ts.sort()
        start = n = 0
        for i, t in enumerate(ts):
            if i and t - ts[i - 1] > gap:
                out.append((u, start, ts[i - 1], ts[i - 1] - start, n))
                n = 0
            start, n = (t if n == 0 else start), n + 1
        out.append((u, start, ts[-1], ts[-1] - start, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [100, 21600])
def test_sessions_match_brute_force(spark, bucket):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", "", None, "hot", "hot", "hot"]), rng.choice([None, *(rng.randint(-5000, 60000) for _ in range(20))])) for _ in range(1500)]
    df = spark.createDataFrame([(u, t, "x", 1) for u, t in data], "who string, at bigint, _t string, start_s int")
    assert rows(sessionize(df, "who", "at", 300, bucket)) == sessions_by_hand(data, 300)


def test_session_borders_and_empty(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1800), ("a", 3601), ("a", 3601)], "u string, t bigint")
    assert rows(sessionize(df, "u", "t")) == [("a", 0, 1800, 1800, 2), ("a", 3601, 3601, 0, 2)]
    assert rows(sessionize(df.limit(0), "u", "t")) == []
    with pytest.raises(ValueError):
        sessionize(df, "u", "t", -1)


# Tree counts


def test_tree_levels():
    assert tree_levels(256, 16) == [256, 16, 1]
    assert tree_levels(1, 2) == [1]
    assert tree_levels(5, 2) == [5, 3, 2, 1]
    with pytest.raises(ValueError):
        tree_levels(4, 1)


def test_task_count(spark):
    assert task_count(spark.range(0, 100, 1, 13)) == 13
    assert task_count(spark.range(100).repartition(5000)) == 5000
    assert task_count(spark.range(100).groupBy("id").count()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tree_count_takes_as_many_rounds_as_its_tasks_need(spark):
    df = spark.createDataFrame([("a", "x")], "k string, v string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks, exchanges in (("4", 2), ("16", 2), ("17", 3), ("5000", 5)):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            plan = tree_count(df, "k", "v")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == exchanges, tasks
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_tree_count_matches_brute_force(spark, fan_in):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 20 + ["a", "b", "", None]), rng.choice(["", None, *(str(rng.randint(0, 200)) for _ in range(9))])) for _ in range(3000)]
    want = defaultdict(lambda: [0, set()])
    for k, v in data:
        if k is not None:
            want[k][0] += 1
            if v:
                want[k][1].add(v)
    df = spark.createDataFrame([(*d, 1, "z") for d in data], "k string, v string, _n int, _k string")
    assert rows(tree_count(df, "k", "v", fan_in=fan_in)) == sorted(((k, n, len(s)) for k, (n, s) in want.items()), key=repr)
    assert rows(tree_count(df.limit(0), "k", "v", fan_in=fan_in)) == []


# Sessions, entries, counts and bad rows as queries


def test_queries_dont_depend_on_the_zone(spark, tmp_path):
    d, rng, lines = str(tmp_path), random.Random(8), []
    for n in range(600):
        row = (rng.randint(1, 4), n, rng.choice(["May  9 23:38:41 h p[1]: a", "more", "1115052084.511 crit/m: b", "1.2.3.4;h;2005;Jan;1;0;0;0", "1.2.3.4;h;2005;Feb;30;0;0;0"]), rng.choice(["hot", "", None, f"10.0.0.{n}"]), rng.choice(["Host.A", None]), 2005, rng.choice(["Jan", "may", "Nope"]), rng.choice([1, 31]), rng.choice([0, 23]), 59, rng.choice([0, 59]))
        lines += [row] * rng.choice([1, 1, 3])
    spark.createDataFrame(lines, "file_id bigint, line_no bigint, line string, ip string, hostname string, year bigint, month string, day bigint, hour bigint, minute bigint, second bigint").write.parquet(f"{d}/connections.parquet")
    for kind in ("timestamp_ntz", "timestamp"):
        files = spark.createDataFrame([(i, ["log", "split"][i % 2], datetime(2005, 1, 1)) for i in range(1, 5)], "file_id bigint, kind string, opened_at timestamp_ntz")
        files.withColumn("opened_at", F.col("opened_at").cast(kind)).write.mode("overwrite").parquet(f"{d}/log_files.parquet")
        zone, results = spark.conf.get("spark.sql.session.timeZone"), []
        try:
            for z in ("UTC", "America/Los_Angeles", "Pacific/Kiritimati"):
                spark.conf.set("spark.sql.session.timeZone", z)
                results.append({name: rows(q(spark, d)) for name, q in general_queries().items()})
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        assert results[0] == results[1] == results[2] and all(results[0].values())
        assert {r[3][:4] for r in results[0]["p2_found"]} == {"2005"}


# Bad rows

LINES = {
    "10.0.0.1;a.b;2005;May;1;2;3;4": None,
    "10.0.0.1;a.b.;2005;sept;1;2;3;4\r": None,
    '"10.0.0.1";"a.b";"2005";"MAY";"1";"02";"3";"4"': None,
    "10.0.0.1;;2005;May;1;2;3;4": None,
    '10.0.0.1;"";2005;May;1;2;3;4': None,
    '10.0.0.1;"a;b";2005;May;1;2;3;4': ("invalid_value", "hostname"),
    '10.0.0.1;"a""b";2005;May;1;2;3;4': ("invalid_value", "hostname"),
    '10.0.0.1;"a.b;2005;May;1;2;3;4': ("quoting", "hostname"),
    '10.0.0.1;a"b;2005;May;1;2;3;4': ("quoting", "hostname"),
    '10.0.0.1;"a"b;2005;May;1;2;3;4': ("quoting", "hostname"),
    '10.0.0.1;a;2005;May;1;2;3;"': ("quoting", "second"),
    "10.0.0.1;a;2005;May;1;2;3": ("column_count", None),
    "10.0.0.1;a;2005;May;1;2;3;4;": ("column_count", None),
    '"10.0.0.1;a;2005': ("quoting", "ip"),
    "10.0.0.256;a;2005;May;1;2;3;4": ("invalid_value", "ip"),
    ";a;2005;May;1;2;3;4": ("invalid_value", "ip"),
    "10.0.0.1 ;a;2005;May;1;2;3;4": ("invalid_value", "ip"),
    "10.0.0.1;a..b;2005;May;1;2;3;4": ("invalid_value", "hostname"),
    "10.0.0.1;é;2005;May;1;2;3;4": ("invalid_value", "hostname"),
    f"10.0.0.1;{'a' * 64};2005;May;1;2;3;4": ("invalid_value", "hostname"),
    f"10.0.0.1;{'a' * 63}.{'b' * 63};2005;May;1;2;3;4": None,
    "10.0.0.1;a;05;May;1;2;3;4": ("invalid_value", "year"),
    "10.0.0.1;a;2005;Mai;1;2;3;4": ("invalid_value", "month"),
    "10.0.0.1;a;2005;May;+1;2;3;4": ("invalid_value", "day"),
    "10.0.0.1;a;2005;May;1;2;3;٤": ("invalid_value", "second"),
    "10.0.0.1;a;2005;Feb;29;2;3;4": ("invalid_value", "instant"),
    "10.0.0.1;a;2004;Feb;29;2;3;4": None,
    "10.0.0.1;a;2005;May;1;24;3;4": ("invalid_value", "instant"),
    "10.0.0.1;a;2005;May;0;2;3;4": ("invalid_value", "instant"),
    '10.0.0.1;a;2005;May;1;2;3;4;"x': ("quoting", None),
    '10.0.0.1;a;2005;May;1;2;3;4;"x"': ("column_count", None),
    '10.0.0.1;"a;b";2005;May;1;2;3': ("column_count", None),
    '10.0.0.256;a;2005;May;1;2;3;"4': ("quoting", "ip"),
    "10.0.0.256;a;2005": ("column_count", None),
    '10.0.0.1;"a";2005;May;1;2;3;': ("invalid_value", "second"),
    '10.0.0.1;"a""b";2005;"M;y";1;2;3;4': ("invalid_value", "hostname"),
    "10.0.0.1": ("column_count", None),
    "ip;hostname;year;month;day;hour;minute;second": "none",
    "\ufeffip;hostname;year;month;day;hour;minute;second\r": "none",
    "": "none",
    " \t": "none",
    "\r": "none",
    "x" * 100_000: ("column_count", None),
    '"' + 'a""' * 50_000: ("quoting", "ip"),
    ";" * 50_000: ("column_count", None),
}


def test_bad_rows(spark):
    df = spark.createDataFrame([(i, line, "r", 1) for i, line in enumerate(LINES)] + [(99, None, "r", 1)], "id int, line string, reason string, _keep int")
    got = {r["id"]: r for r in classify_rows(df, "line", CONNECTIONS, keep=("id",)).collect()}
    for i, (line, want) in enumerate(LINES.items()):
        if want == "none":
            assert i not in got, line[:40]
        else:
            assert ((got[i]["reason"], got[i]["field"]) if got[i]["reason"] else None) == want, line[:60]
            assert (got[i]["row"] is None) == (want is not None)
    assert 99 not in got
    assert got[0]["row"].asDict() == {"ip": "10.0.0.1", "hostname": "a.b", "year": 2005, "month": "May", "day": 1, "hour": 2, "minute": 3, "second": 4}
    assert got[2]["row"]["month"] == "MAY"
    assert classify_rows(df.limit(0), "line", CONNECTIONS, keep=("id",)).collect() == []


def test_the_reason_comes_from_the_prefixes(spark):
    df = spark.createDataFrame([("10.0.0.1;a",)], "line string")
    plan = classify_rows(df, "line", CONNECTIONS).where("reason IS NOT NULL").select("reason")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=;|") >= len(CONNECTIONS.fields)


def test_bad_rows_of_another_schema(spark):
    schema = RowSchema((Field("k", "[a-z]+"), Field("n", "-?[0-9]+", "int")), delimiter="|")
    df = spark.createDataFrame([("a|1",), ('"b"|-2',), ("a|x",), ("a",), ("A|1",)], "line string")
    got = [(r["reason"], r["field"], r["row"] and tuple(r["row"])) for r in classify_rows(df, "line", schema).collect()]
    assert got == [(None, None, ("a", 1)), (None, None, ("b", -2)), ("invalid_value", "n", None), ("column_count", None, None), ("invalid_value", "k", None)]


# Log entries

HEADERS = {
    "May  9 16:38:41 ferry ftpd[13493]: hello": ("-05-09 16:38:41", "", "ftpd", "hello"),
    "<86>May  2 16:59:53 lodge su(pam_unix)[26938]: x: y": ("-05-02 16:59:53", "INFO", "su(pam_unix)", "x: y"),
    "<83>May 12 16:59:53 lodge logrotate: ": ("-05-12 16:59:53", "ERROR", "logrotate", ""),
    "<80>May 12 16:59:53 lodge logrotate:": ("-05-12 16:59:53", "FATAL", "logrotate", ""),
    "<999>May 12 16:59:53 lodge logrotate: x": None,
    "Foo 12 16:59:53 lodge logrotate: x": None,
    "May 12 16:59:53 lodge no colon": None,
    "May 32 16:59:53 lodge a: x": None,
    "[Mon May 02 17:06:40 2005] [notice] [quota] [a] b": ("2005-05-02 17:06:40", "INFO", "quota", "[a] b"),
    "[Mon May 02 17:06:40 2005] [loud] [quota] b": None,
    "02/05/2005 16:50:59|SEVERE|ftpd|a|b": ("2005-05-02 16:50:59", "ERROR", "ftpd", "a|b"),
    "31/02/2005 16:50:59|SEVERE|ftpd|a|b": None,
    "1115052084.511 crit/mirror: a: b": ("2005-05-02 16:41:24", "FATAL", "mirror", "a: b"),
    "E0502 16:42:00.611447 25762 tls_probe.cpp:1730] [x] y": ("-05-02 16:42:00", "ERROR", "tls_probe.cpp", "[x] y"),
    "2005-05-02 16:38:48,265 Warning ftp.session - a - b": ("2005-05-02 16:38:48", "WARN", "ftp.session", "a - b"),
    "2005-05-02 03:12:00 was the last good spool": None,
    "2005-05-03T03:00:27+09:30 notice [ftpd] c": ("2005-05-02 17:30:27", "INFO", "ftpd", "c"),
    "2005-05-02T13:04:26-05:00 trace [a.B] c": ("2005-05-02 18:04:26", "DEBUG", "a.B", "c"),
    "2005-05-02T20:11:58.827Z INFO  [ftpd] d": ("2005-05-02 20:11:58", "INFO", "ftpd", "d"),
    'level=panic ts=2005-05-02T16:45:05Z component=ftpd msg="a \\"b\\" \\\\c" code=7': ("2005-05-02 16:45:05", "FATAL", "ftpd", 'a "b" \\c'),
    "ts=2005-05-02T16:45:05Z component=x msg=short": ("2005-05-02 16:45:05", "", "x", "short"),
    'ts=2005-05-02T16:45:05Z component=x msg="open': None,
    "key=lease value=0": None,
    '{"lvl":"WARN","msg":"ü \\u00fc \\"q\\"","logger":"q","ts":1115056260101}': ("2005-05-02 17:51:00", "WARN", "q", 'ü ü "q"'),
    '{"ts": "2005-05-02T16:54:39Z", "lvl": "info", "logger": "a", "msg": "m", "n": {"a": ["}"]}}': ("2005-05-02 16:54:39", "INFO", "a", "m"),
    '{"ts":"2005-05-02T16:54:39Z","lvl":"info","logger":"a"': None,
    "{": None,
    '  "a": 1,': None,
    "": None,
    "\tat x.y(Z.java:1)": None,
    "x" * 100_000: None,
    "{" * 10_000: None,
}


@pytest.mark.parametrize("line", HEADERS, ids=lambda s: s[:30])
def test_headers(line):
    assert read_header(line) == HEADERS[line]


def test_scanners():
    assert scan_object('{"a":"b\\n","c":[1,{"d":"]"}],"e":null,"f":{}}') == {"a": "b\n", "c": ('[1,{"d":"]"}]',), "e": ("null",), "f": ("{}",)}
    assert scan_object("{}") == {}
    for bad in ("{} x", '{"a"}', '{"a":}', '{"a":1,}', "[1]", '{"a":"b}', '{"a":1 2}'):
        assert scan_object(bad) is None, bad
    assert scan_pairs('a=1  b="c d" e=') == {"a": "1", "b": "c d", "e": ""}
    assert scan_pairs("a=1 b") is None


def test_machine_is_deterministic_and_reused():
    m = HeaderMachine()
    line = "May  9 16:38:41 ferry ftpd[13493]: hello"
    first = m.run(line)
    states = len(m._states)
    assert m.run(line) == first and len(m._states) == states and line[first[2] :] == "hello"


def test_no_length_makes_a_difference():
    long = "n" * 300
    assert read_header(f"{long}=1 ts=2005-05-02T16:45:05Z component=x msg=short") == ("2005-05-02 16:45:05", "", "x", "short")
    assert read_header("111505208451.5 crit/a: b") == (f"{datetime.fromtimestamp(111505208451, timezone.utc):%Y-%m-%d %H:%M:%S}", "FATAL", "a", "b")
    assert read_header("9" * 6000 + ".5 crit/a: b") is None and read_header("9" * 20 + ".5 crit/a: b") is None


def test_grammars_are_a_parameter(spark):
    own = {"starred": [grammar("** ", [(Chars("0123456789"), "1", "day"), "9:1"], ".", [(Chars("0123456789"), "1", "month"), "9:1"], " ", [(Chars("0123456789"), "1", "clock"), "9:1", ":", "9:2", ":", "9:2"], " <", (Chars(">", False), "+", "name"), (">", "1", "name_end"), " ")]}
    lines = ["** 09.05 16:38:41 <a b> hello", "May  9 16:38:41 ferry ftpd[13493]: more", "** 31.02 16:38:41 <a b> hello"]
    df = spark.createDataFrame([(1, i, s, datetime(2005, 1, 1)) for i, s in enumerate(lines)], "file_id int, line_no int, line string, opened_at timestamp")
    assert rows(log_entries(df, grammars=own)) == [(1, 0, 3, "2005-05-09 16:38:41", "", "a b", "\n".join(["hello", *lines[1:]]))]


def test_attached_lines_match_brute_force_over_batches(spark):
    rng, head = random.Random(4), "May  9 16:38:41 h p[1]: "
    data = [(f, n, head + str(n) if rng.random() < rng.choice([0.02, 0.5]) else str(n)) for f in range(4) for n in rng.sample(range(1, 900), rng.choice([1, 40, 500]))]
    want = []
    for f, n, line in sorted(data):
        if line.startswith(head):
            want.append([f, n, 1, line[len(head) :]])
        elif want and want[-1][0] == f:
            want[-1][2] += 1
            want[-1][3] += "\n" + line
    copies = [(*d, datetime(2005, 5, 9)) for d in data for _ in range(rng.choice([1, 1, 3]))]
    rng.shuffle(copies)
    df = spark.createDataFrame(copies, "file_id bigint, line_no bigint, line string, opened_at timestamp").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for records in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            assert [[r["file_id"], r["line_no"], r["n_lines"], r["message"]] for r in log_entries(df, block_lines=50, blocks_together=3).orderBy("file_id", "line_no").collect()] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


@pytest.mark.parametrize("block,together", [(2, 2), (3, 1024), (8192, 1)])
def test_entries(spark, block, together):
    head = "May  9 16:38:41 h p[1]: "
    lines = ["lost", head + "a", "more", "", "more\r", head + "b", *[f"m{i}" for i in range(9)], "<31>" + head + "c", "x"]
    data = [(1, i + 1, s) for i, s in enumerate(lines)] + [(1, 2, lines[1]), (1, 9, lines[8])] + [(2, 1, "nothing"), (2, 2, "at all"), (None, 1, head), (1, None, head), (1, 99, None)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame([(*d, datetime(2005, 5, 9) if d[0] == 1 else None, 5) for d in data], "file_id bigint, line_no bigint, line string, opened_at timestamp, block int")
    at = "2005-05-09 16:38:41"
    want = [
        (1, 2, 4, at, "", "p", "a\nmore\n\nmore"),
        (1, 6, 10, at, "", "p", "b\n" + "\n".join(f"m{i}" for i in range(9))),
        (1, 16, 2, at, "DEBUG", "p", "c\nx"),
    ]
    assert rows(log_entries(df, block_lines=block, blocks_together=together)) == sorted(want, key=repr)
    assert log_entries(df.limit(0)).collect() == []


def test_once_per_line(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "a"), (None, None, "x"), (None, None, "x")], "file_id int, line_no int, v string")
    assert once_per_line(df).count() == 3
