"""The SQL layer: reading statements, extraction, expressions, aggregates, joins, output, embedding, following."""

import json
import math
import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom import cli
from logloom.functions.convert import display
from logloom.plans import tree
from logloom.plans.engine import Tables, compile_query
from logloom.plans.errors import BindError, LoomError, PatternError, RunError, StatementError
from logloom.plans.grammar import completion_words, parse
from logloom.plans.lexer import tokens
from logloom.plans.types import INT, INTERVAL, NULL, REAL, TEXT, TIMESTAMP, array_of
from logloom.sources.lines import FollowFileIterator, ReadLinesIterator, python_lines
from logloom.sources.patterns import compile_pattern
from logloom.sources.sinks import Printer
from logloom.sources.tail import TailReader
from logloom.streaming.follow import follow_query

FTP = r"""CREATE TABLE connections(
    line = 'from ([0-9.]+) \\((.+)?\\) at ([a-z]+) ([a-z]+) ([0-9]+)', -- a comment
    line[1] => ip TEXT, line[2] => hostname TEXT, line[3] => a TEXT, line[4] => b TEXT, line[5] => n INT);"""
FTP_LINES = ["from 1.2.3.4 (h1) at x y 5", "junk", "from 1.2.3.5 () at x z 7", "from 1.2.3.4 (h1) at y y 6", "from 9.9.9.9 (h2) at x y 99999999999999999999"]


@pytest.fixture
def tables(spark):
    t = Tables(spark)
    t.add_table(FTP)
    return t


def values(tables, lines, query):
    return [tuple(r.values()) for r in tables.execute_query(lines, query)]


def one(spark, expression, definition="p = '(.*)', p[1] => s TEXT", line="x"):
    t = Tables(spark)
    t.add_table(f"CREATE TABLE t({definition});")
    return t.sql(f"SELECT {expression} AS v FROM t", [line]).collect()[0][0]


# Reading


def test_tokens():
    got = [(t.kind, t.value) for t in tokens("SELECT x1, 'a\\'b' -- no\n>=-4 1.5::int _pattern0")]
    assert got == [("keyword", "select"), ("word", "x1"), ("symbol", ","), ("string", "a'b"), ("symbol", ">="), ("symbol", "-"), ("int", 4), ("real", 1.5), ("symbol", "::"), ("word", "int"), ("word", "_pattern0"), ("end", None)]


@pytest.mark.parametrize(
    "text",
    ["SELECT", "SELECT x", "SELECT x FROM t WHERE", "SELECT x FROM t WHERE a WHERE b", "SELECT x FROM t LIMIT y", "CREATE TABLE t(a = 'x')", "CREATE TABLE t({ } => a INT);", "SELECT 'x FROM t", "SELECT x ^ 2 FROM t",
     "SELECT CASE WHEN a THEN b END FROM t", "CREATE TABLE t('x' => a FOO);", "CREATE TABLE t('x' => a INT TRIM);", "CREATE TABLE t('x' => a INT DEFAULT 'y');", "SELECT x FROM t GROUP x", "SELECT # FROM t", "DROP", "SELECT x FROM t; SELECT y FROM t", "SELECT 99999999999999999999 FROM t"],
)
def test_broken_statements(text):
    with pytest.raises(StatementError):
        parse(text)


def test_errors_say_where():
    with pytest.raises(StatementError, match="line 2, column 6"):
        parse("SELECT x\nFROM 5")


def test_binding_of_operators():
    where = lambda e: parse(f"SELECT x FROM t WHERE {e}").where
    n, lit = tree.Name, lambda v: tree.Literal(v, INT)
    b = tree.Binary
    assert where("a OR b AND c") == b("and", b("or", n("a"), n("b")), n("c"))
    assert where("NOT a = 5") == b("=", tree.Unary("not", n("a")), lit(5))
    assert where("a = 1 + 2 * 3") == b("=", n("a"), b("+", lit(1), b("*", lit(2), lit(3))))
    assert where("a < b = c") == b("=", b("<", n("a"), n("b")), n("c"))
    assert where("x = a[1]") == b("=", n("x"), tree.Item(n("a"), lit(1)))
    assert where("t.c::int > -4") == b(">", tree.Cast(n("c", "t"), INT), tree.Unary("-", lit(4)))
    assert where("a IN (1)") == tree.Within(n("a"), (lit(1),), False)
    assert where("a NOT IN (1, 2) AND b IS NOT NULL") == b("and", tree.Within(n("a"), (lit(1), lit(2)), True), b("is not", n("b"), tree.Literal(None, NULL)))
    assert where("EXTRACT(hour FROM a)") == tree.Call("timestamp_extract_hour", (n("a"),))


def test_clauses_in_any_order():
    a = parse("SELECT x, COUNT(*) AS n FROM t LIMIT 3 HAVING COUNT(*) > 1 GROUP BY x WHERE y;")
    b = parse("select x, count(*) as n from t where y group by x having count(*) > 1 limit 3")
    assert a == b and a.limit == 3 and compile_query("SELECT x FROM t::'f.log'").path == "f.log"


def test_several_tables_and_modifiers():
    a, b = parse("CREATE TABLE a(p = SPLIT ';', p[1] => x TEXT TRIM NOT NULL DEFAULT 'q'); CREATE TABLE b('(x)' => y BOOLEAN, {.a[0].b} => z REAL[][] );")
    assert a.patterns[0].split and a.columns[0] == tree.ColumnDef("x", TEXT, (tree.Reference("p", 1),), (), True, True, default="q")
    assert b.columns[0].references == (tree.Reference("_pattern0", 1),) and b.columns[1].path == ("a", 0, "b") and b.columns[1].type == array_of(array_of(REAL))


def test_completion_words():
    assert {"SELECT", "COUNT", "DATE_TRUNC"} <= set(completion_words())


# Patterns


def test_groups_of_patterns():
    p = compile_pattern(r"(a)(b)?((c|d*)|(e))(?:(f)x)*(?P<n>[]x(])\(\d{2,}(g?)")
    assert [(g.always, g.empty) for g in p.groups] == [(True, False), (False, False), (True, True), (False, True), (False, False), (False, False), (True, False), (True, True)]
    assert "(?P" not in p.java
    for bad in (r"(?=x)", r"(x)\1", r"(?<!x)", r"(x", r"x)", "[a", "[a--b]", "(?U)x", "x\\"):
        with pytest.raises(PatternError):
            compile_pattern(bad)


def test_group_absent_or_empty(spark):
    cases = [("a(b)?", "xxa", None), ("a(b)?", "xxab", "b"), ("a(b*)", "xxa", ""), ("a(b*)?", "xxa", ""), ("a(?:-(b*))?", "xxa", None), ("a(?:-(b*))?", "xxa-", ""), ("a(?:-(b*))?", "xxa a-", None), ("(x*)|(y*)", "y", "")]
    for pattern, line, want in cases:
        t = Tables(spark)
        t.add_table(f"CREATE TABLE t(p = '{pattern}', p[1] => v TEXT, p[0] => w TEXT);")
        assert t.execute_query([line], "SELECT v FROM t") == [{"v": want}], (pattern, line)


# Extraction


def extract(spark, definition, *lines):
    t = Tables(spark)
    t.add_table(f"CREATE TABLE t({definition});")
    return values(t, list(lines), "SELECT * FROM t")


def test_lines_without_value_make_no_row(tables):
    assert values(tables, FTP_LINES, "SELECT * FROM connections") == [("1.2.3.4", "h1", "x", "y", 5), ("1.2.3.5", None, "x", "z", 7), ("1.2.3.4", "h1", "y", "y", 6), ("9.9.9.9", "h2", "x", "y", None)]
    assert values(tables, ["from 1.2.3.4 (a\x01b) at x y 5"], "SELECT ip, hostname, n FROM connections") == [("1.2.3.4", "a\x01b", 5)]
    assert values(tables, [], "SELECT * FROM connections") == []


def test_default_keeps_every_line_but_not_for_bad_values(spark):
    got = extract(spark, "p = '^x(\\\\w+)', p[1] => n INT DEFAULT 9, q = 'y(z)?', q[1] => t TEXT DEFAULT 'd'", "x5", "xab", "none", "yz", "y")
    assert got == [(5, "d"), (None, "d"), (9, "d"), (9, "z"), (9, "d")]


def test_booleans_tell_whether_a_group_is_there(spark):
    assert extract(spark, "p = 'A: ([0-9]+)?', p[1] => x BOOLEAN", "A: 1", "A: ", "B") == [(True,), (False,)]


def test_numbers_are_read_strictly(spark):
    got = extract(spark, "p = split ';', p[1] => i INT, p[2] => r REAL", "5;1.5", " 5;5d", "+7;-.5e2", "x;inf", "9999999999999999999;1.")
    assert got == [(5, 1.5), (7, -50.0), (None, math.inf), (None, 1.0)]


def test_split_not_null_and_trim(spark):
    assert extract(spark, "p = split ';', p[1] => a TEXT TRIM, p[2] => b INT NOT NULL, p[9] => c TEXT", "name;b", "  x ;4;", "y", ";5") == [("x", 4, None), ("", 5, None)]


def test_arrays_and_timestamps(spark):
    assert extract(spark, "p = '(\\\\d+)-(\\\\w+)', p[1], p[2] => a INT[]", "1-2", "1-x", "y") == [([1, 2],), ([1, None],)]
    assert extract(spark, "p = '^(\\\\w+) (\\\\w+) (\\\\w+)(?: (\\\\w+))?$', p[1], p[2], p[3], p[4] => t TIMESTAMP DEFAULT NULL, p[1] => y TEXT", "2005 Sept 9", "2005 2 30 4", "2005 foo 3 4", "2005 9 3 4", "2005 9 x 4") == [
        (None, "2005"), (None, "2005"), (None, "2005"), (datetime(2005, 9, 3, 4), "2005"), (None, "2005")]
    ms = "p = '(\\\\d+) (\\\\d+) (\\\\d+) (\\\\d+) (\\\\d+) (\\\\d+) (\\\\d+)', p[1], p[2], p[3], p[4], p[5], p[6], p[7] => t TIMESTAMP"
    assert extract(spark, ms, "2005 1 2 3 4 5 678") == [(datetime(2005, 1, 2, 3, 4, 5, 678000),)]
    assert extract(spark, ms + " MICROSECONDS", "2005 1 2 3 4 5 678") == [(datetime(2005, 1, 2, 3, 4, 5, 678),)]


def test_json_is_typed_strictly(spark):
    definition = "{.a} => i INT, {.b} => r REAL, {.c} => s TEXT, {.d} => f BOOLEAN, {.e} => l INT[], {.f.g[1]} => deep TEXT, {.h} => conv INT CONVERT, {.i} => def TEXT DEFAULT 'd'"
    good = '{"a":4,"b":4,"c":"x","d":true,"e":[1,"2",null],"f":{"g":["p","q"]},"h":"17","i":"j"}'
    bad = '{"a":4.5,"b":"4","c":4,"d":"true","e":{"x":1},"f":{"g":["p"]},"h":17,"i":3}'
    missing = (None,) * 7 + ("d",)
    assert extract(spark, definition, good, bad, "no json", '{"a": 4711.0}') == [(4, 4.0, "x", True, [1, None, None], "q", 17, "j"), missing, missing]


def test_bad_definitions(spark):
    t = Tables(spark)
    for bad in ("CREATE TABLE t(p[1] => x TEXT);", "CREATE TABLE t(p = '(', p[1] => x TEXT);", "CREATE TABLE t('(x)' => a TEXT, '(y)' => a TEXT);", "SELECT x FROM t"):
        with pytest.raises(LoomError):
            t.add_table(bad)


# Expressions


@pytest.mark.parametrize(
    "expression,want",
    [
        ("NULL = NULL", False), ("NOT (1 = NULL)", True), ("NULL IN (NULL, 1)", True), ("NULL NOT IN (1, 2)", True), ("1 IS NOT NULL", True), ("NULL IS NULL", True), ("1 = 1.0", True), ("2 > 1.5", True),
        ("5 AND true", False), ("NULL OR true", True), ("NOT NULL", None), ("7 / 2", 3), ("(-7) / 2", -3), ("7.0 / 2", 3.5), ("1.0 / 0.0", math.inf), ("-1.0 / 0.0", -math.inf), ("1 + NULL", None), ("2 * 3 - 1", 5), ("-(3)", -3),
        ("CASE WHEN NULL THEN 1 WHEN 2 > 1 THEN 2 ELSE 3 END", 2), ("CASE WHEN false THEN 1 ELSE 2.5 END", 2.5), ("ARRAY[1, 2, NULL][2]", 2), ("ARRAY[1][2]", None), ("ARRAY[1][0]", None), ("ARRAY[1][-1]", None),
        ("greatest(1, 2)", 2), ("greatest(1, NULL)", None), ("least(1.5, 2)", 1.5), ("abs(-3)", 3), ("abs(-3.5)", 3.5), ("sqrt(4.0)", 2.0), ("sqrt(9)", 3.0), ("pow(2, 10)", 1024), ("pow(3, 39)", 3**39), ("pow(-1, 999)", -1), ("pow(2, 0)", 1), ("pow(0, 0)", 1), ("pow(0, 5)", 0), ("pow(2.0, 0.5)", math.sqrt(2)),
        ("length('añ😀')", 3), ("length(NULL)", None), ("upper('aß')", "ASS"), ("lower('ÀB')", "àb"), ("regexp_matches('abc', 'b.')", True), ("regexp_matches(NULL, 'b')", False), ("regexp_matches('abc', s)", False),
        ("array_unique(ARRAY[3, 1, NULL, 3])", [None, 1, 3]), ("array_length(ARRAY[1, NULL])", 2), ("array_length(ARRAY[1]) + 1", 2), ("array_cat(ARRAY[1], ARRAY[2])", [1, 2]), ("array_append(ARRAY[1], 2)", [1, 2]), ("array_prepend(0, ARRAY[1])", [0, 1]), ("create_array(1, 2.5)", [1.0, 2.5]),
        ("make_timestamp(2005, 2, 3, 4, 5, 6, 7)", datetime(2005, 2, 3, 4, 5, 6, 7)), ("make_timestamp(2005, 2, 30, 0, 0, 0, 0)", None), ("make_timestamp(2005, 2, 3, 4, 5, 6, 7, 8)", datetime(2005, 2, 3, 4, 5, 6, 7)),
        ("EXTRACT(epoch FROM '1970-01-01 00:00:09'::timestamp)", 9.0), ("EXTRACT(second FROM make_timestamp(2005, 1, 1, 0, 0, 7, 5))", 7),
        ("date_trunc('milliseconds', make_timestamp(2005, 2, 3, 4, 5, 6, 7890))", datetime(2005, 2, 3, 4, 5, 6, 7000)), ("date_trunc('month', make_timestamp(2005, 2, 3, 4, 5, 6, 7))", datetime(2005, 2, 1)),
        ("make_timestamp(2005, 1, 2, 0, 0, 0, 0) - make_timestamp(2005, 1, 1, 0, 0, 1, 0)", timedelta(seconds=86399)), ("make_timestamp(2005, 1, 2, 0, 0, 0, 0) - '0:0:1'::interval", datetime(2005, 1, 1, 23, 59, 59)), ("'1:0:0'::interval + '0:-30:5'::interval", timedelta(seconds=1805)),
        ("make_timestamp(2005, 1, 2, 0, 0, 0, 0) > '2005-01-01 00:00:00'", True), ("'25:00:01'::interval::text", "25:00:01.000"), ("'-1:0:1'::interval::int", -3599), ("'0:0:-5'::interval::int", -5), ("'0:1:30'::interval::real", 90.0),
        ("1.234::text", "1.23"), ("NULL::text", "NULL"), ("'a'::text", "a"), ("ARRAY['a', NULL]::text", "{'a', NULL}"), ("true::text", "true"), ("make_timestamp(2005, 1, 2, 3, 4, 5, 6000)::text", "2005-01-02 03:04:05.006"), ("'17'::int + 1", 18), ("'1e3'::real", 1000.0), ("'true'::boolean", True), ("2.9::int", 2), ("2::real", 2.0), ("NULL::int", None),
        ("now() > make_timestamp(2020, 1, 1, 0, 0, 0, 0)", True), ("p0.x", None),
    ],
    ids=str,
)
def test_expressions(spark, expression, want):
    if expression == "p0.x":
        with pytest.raises(BindError):
            one(spark, expression)
        return
    got = one(spark, expression)
    assert got == want and type(got) is type(want)


@pytest.mark.parametrize("expression", ["1 = 'a'", "1 + 'a'", "-'a'", "NOT 1", "'a'[1]", "sqrt('a')", "foo(1)", "length(1)", "ARRAY[1, 'a']", "ARRAY[NULL]", "date_trunc('eon', now())", "now() * 2", "now() + now()", "1::timestamp", "MAX(COUNT(*))", "make_timestamp(1)", "*, 1", "zzz", "COUNT(DISTINCT *)", "upper(DISTINCT 'a')", "CASE WHEN true THEN 1 ELSE 'a' END"])
def test_expressions_that_dont_fit(spark, expression):
    with pytest.raises(LoomError):
        one(spark, expression)


@pytest.mark.parametrize("expression", ["'x'::int", "'2005-1-1'::timestamp", "s::boolean", "1 / 0", "pow(2, 64)", "pow(2, -1)"])
def test_values_that_dont_fit_fail_the_query(spark, expression):
    with pytest.raises(Exception):
        one(spark, expression)


# Aggregates


def test_aggregates(spark):
    t = Tables(spark)
    t.add_table("CREATE TABLE t(p = split ';', p[1] => g TEXT, p[2] => i INT, p[3] => r REAL, p[4] => s TEXT);")
    lines = ["b;1;1.5;x", "b;2;;y", "b;4;2.5;", "a;;;", "a;;;z"]
    q = "SELECT g, COUNT(*), COUNT(i), MIN(i), MAX(s), SUM(i), AVG(i), AVG(r), STDDEV(i), VARIANCE(r), PERCENTILE(i, 0.5), PERCENTILE(i, 1.0), BOOL_AND(i > 1), BOOL_OR(i > 1), ARRAY_AGG(i), STRING_AGG(s, '|') FROM t GROUP BY g"
    got = values(t, lines, q)
    assert got[0] == ("a", 2, 0, None, "z", None, None, None, None, None, None, None, False, False, [None, None], "|z")
    assert got[1][:8] == ("b", 3, 3, 1, "y", 7, 2, 2.0) and got[1][8] == pytest.approx(math.sqrt(14 / 9)) and got[1][9:] == (0.25, 2, 4, False, True, [1, 2, 4], "x|y|")
    assert list(t.execute_query(lines, q)[0])[:4] == ["g", "count1", "count2", "min3"]
    assert values(t, lines, "SELECT g, COUNT(i) AS n FROM t GROUP BY g") == [("b", 3)]
    assert values(t, lines, "SELECT g FROM t GROUP BY g") == [("a",), ("b",)]
    assert values(t, lines, "SELECT MAX(i) * 2 + MIN(i), SQRT(MAX(i)) FROM t") == [(9, 2.0)]
    assert values(t, lines, "SELECT t.g, SUM(i) AS s FROM t GROUP BY g HAVING MAX(i) IS NULL OR g = 'b' LIMIT 1") == [("a", None)]
    assert values(t, lines, "SELECT upper(g), COUNT(*) AS n FROM t GROUP BY upper(g)") == [("A", 2), ("B", 3)]
    assert values(t, lines, "SELECT DISTINCT COUNT(*) > 0 AS n FROM t GROUP BY g") == [(True,)]
    assert values(t, lines, "SELECT COUNT(*) AS n FROM t WHERE i > 100") == []
    assert values(t, lines, "SELECT i, COUNT(*) FROM t GROUP BY i")[0] == (None, 2)
    for bad in ("SELECT i, COUNT(*) FROM t GROUP BY g", "SELECT SUM(s) FROM t", "SELECT PERCENTILE(i, i) FROM t", "SELECT g FROM t HAVING g = 'a'", "SELECT STRING_AGG(s) FROM t", "SELECT COUNT(i + 1) FROM t", "SELECT STRING_AGG(i, ',') FROM t"):
        with pytest.raises(LoomError):
            t.sql(bad, lines)


def test_percentiles_match_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", ""]), rng.choice([None, rng.randint(-9, 9)]), rng.choice(["x", "yy", "z"])) for _ in range(400)]
    t = Tables(spark)
    t.add_table("CREATE TABLE t(p = split ';', p[1] => g TEXT, p[2] => i INT, p[3] => s TEXT);")
    lines = [f"{g};{'' if i is None else i};{s}" for g, i, s in data]

    def pick(values, share):
        values = sorted(v for v in values if v is not None)
        return values[min(int(share * len(values)), len(values) - 1)] if values else None

    q = "PERCENTILE(i, 0.0) AS a, PERCENTILE(i, 0.25) AS b, PERCENTILE(s, 0.5) AS c, PERCENTILE(i * i, 0.9) AS d, PERCENTILE(i, 1.0) AS e, COUNT(*) AS n FROM t WHERE g != 'b' OR i > 100"
    want = []
    for g in ["", "a"]:
        of = [d for d in data if d[0] == g]
        i, s = [d[1] for d in of], [d[2] for d in of]
        want.append((g, pick(i, 0), pick(i, 0.25), pick(s, 0.5), pick([x and x * x if x else x for x in i], 0.9), pick(i, 1), len(of)))
    assert values(t, lines, f"SELECT g, {q} GROUP BY g HAVING PERCENTILE(i, 0.5) > -100") == want
    i, s = ([d[k] for d in data if d[0] != "b"] for k in (1, 2))
    assert values(t, lines, f"SELECT {q}") == [(pick(i, 0), pick(i, 0.25), pick(s, 0.5), pick([x * x if x else x for x in i], 0.9), pick(i, 1), len(i))]
    assert values(t, ["a;;x"], "SELECT g, PERCENTILE(i, 0.5) AS p FROM t GROUP BY g") == [("a", None)]
    assert values(t, ["a;;x"], "SELECT PERCENTILE(i, 0.5) AS p, COUNT(*) AS n FROM t") == [(None, 1)]
    assert values(t, [], "SELECT PERCENTILE(i, 0.5) AS p FROM t") == []
    assert "collect_list" not in plan_of(t.sql(f"SELECT {q}", lines))


def test_order_of_lines_across_files_and_tasks(spark, tmp_path):
    paths = []
    for k in (2, 1):
        p = tmp_path / f"f{k} +ü.log"
        p.write_text("".join(f"{k};{i}\n" for i in range(2000)))
        paths.append(str(p))
    t = Tables(spark)
    t.add_table("CREATE TABLE t(p = split ';', p[1] => f INT, p[2] => i INT);")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = t.execute_query(ReadLinesIterator(*paths), "SELECT ARRAY_AGG(f * 10000 + i) AS a FROM t")[0]["a"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [k * 10000 + i for k in (2, 1) for i in range(2000)]


def test_distinct_and_limit(tables):
    assert values(tables, FTP_LINES, "SELECT DISTINCT a, b FROM connections") == [("x", "y"), ("x", "z"), ("y", "y")]
    assert values(tables, FTP_LINES, "SELECT DISTINCT b FROM connections LIMIT 1") == [("y",)]
    assert len(values(tables, FTP_LINES, "SELECT ip FROM connections LIMIT 2")) == 2
    assert values(tables, FTP_LINES, "SELECT ip FROM connections LIMIT 0") == []


# Joins


def test_joins(spark, tmp_path):
    t = Tables(spark)
    t.add_table("CREATE TABLE a(p = '^(\\\\w*)-(\\\\d+)', p[1] => k TEXT, p[2] => v INT); CREATE TABLE b(p = '^(?:(\\\\w+)|~)=(\\\\d+)', p[1] => k TEXT, p[2] => w INT);")
    (tmp_path / "b.txt").write_text("x=1\nx=2\n~=9\nzz=3\n\n")
    left = ["x-1", "y-2", "x-3"]
    on = f"JOIN b::'{tmp_path}/b.txt' ON b.k = a.k"
    assert sorted(values(t, left, f"SELECT v, w FROM a INNER {on}")) == [(1, 1), (1, 2), (3, 1), (3, 2)]
    assert sorted(values(t, left, f"SELECT * FROM a OUTER {on}"), key=str) == sorted([("x", 1, "x", 1), ("x", 1, "x", 2), ("x", 3, "x", 1), ("x", 3, "x", 2), ("y", 2, None, None)], key=str)
    assert t.sql(f"SELECT * FROM a OUTER {on}", left).columns == ["k", "v", "b.k", "w"]
    assert values(t, left, f"SELECT a.k, COUNT(*) AS n, SUM(w) FROM a OUTER {on} GROUP BY a.k") == [("x", 4, 6)]
    assert values(t, left, f"SELECT k, b.k, input FROM a INNER {on} WHERE w = 1 AND v = 1") == [("x", "x", "x-1")]
    t.add_table("CREATE TABLE n(p = '^(\\\\w+)?/(\\\\d+)', p[1] => k TEXT, p[2] => v INT);")
    assert values(t, ["/5", "x/6"], f"SELECT v, w FROM n INNER JOIN b::'{tmp_path}/b.txt' ON n.k = b.k WHERE v = 5") == [(5, 9)]
    for bad in (f"SELECT v FROM a INNER JOIN b::'{tmp_path}/b.txt' ON a.k = b.w", f"SELECT v FROM a INNER JOIN b::'{tmp_path}/b.txt' ON a.k = c.k", f"SELECT v FROM a INNER JOIN c::'{tmp_path}/b.txt' ON a.k = c.k", f"SELECT v FROM a INNER JOIN b::'{tmp_path}/b.txt' ON a.k = a.k"):
        with pytest.raises(LoomError):
            t.sql(bad, left)


# Plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_jvm_and_are_pruned(tables, spark, tmp_path):
    (tmp_path / "x.log").write_text("\n".join(FTP_LINES))
    few = plan_of(tables.sql("SELECT ip FROM connections WHERE n > 5", ReadLinesIterator(str(tmp_path / "x.log"))))
    assert "Python" not in few and few.count("Exchange") == 0
    grouped = plan_of(tables.sql("SELECT ip, COUNT(*), MAX(n) FROM connections GROUP BY ip", ReadLinesIterator(str(tmp_path / "x.log"))))
    assert "Python" not in grouped and "partial_count" in grouped
    t = Tables(spark)
    t.add_table("CREATE TABLE t(p = '(a)(b)', p[1] => x TEXT, p[2] => y TEXT);")
    assert "(a)(b), 2" not in plan_of(t.sql("SELECT x FROM t", ["ab"]))


# Output


def test_printers():
    out = []
    names, types = ["a", "b", "c", "d"], [INT, TEXT, REAL, array_of(REAL)]
    data = [(1, "x", 1.5, [1.0, None]), (None, None, math.inf, None)]
    Printer("text", out.append).rows(names, types, data, single=False)
    Printer("json", out.append).rows(names, types, data)
    Printer("csv", out.append).rows(names, types, data)
    Printer("text", out.append).rows(["input"], [TEXT], [("line",)])
    assert out == [
        "a: 1, b: 'x', c: 1.50, d: {1.00, NULL}", "a: NULL, b: NULL, c: inf, d: NULL", "",
        '{"a":1,"b":"x","c":1.5,"d":[1.0,null]}', '{"a":null,"b":null,"c":null,"d":null}',
        "a;b;c;d", "1;'x';1.50;{1.00, NULL}", "NULL;NULL;inf;NULL", "'line'",
    ]
    assert display(datetime(2005, 1, 2, 3, 4, 5, 6789), TIMESTAMP) == "2005-01-02 03:04:05.006" and display(timedelta(hours=30, milliseconds=5), INTERVAL) == "30:00:00.005"
    with pytest.raises(RunError):
        Printer("xml")


# Embedding


def test_embedding(tables, tmp_path):
    path = tmp_path / "x.log"
    path.write_text("\r\n".join(FTP_LINES) + "\r\n")
    assert tables.table_names() == ["connections"] and tables.get_table("no") is None
    assert tables.get_table("connections").columns() == {"ip": "text", "hostname": "text", "a": "text", "b": "text", "n": "int"}
    assert tables.tables()[0].name() == "connections"
    query = compile_query("SELECT hostname, COUNT() AS count FROM connections WHERE hostname IS NOT NULL GROUP BY hostname")
    assert tables.execute_compiled_query(ReadLinesIterator(str(path)), query) == [{"hostname": "h1", "count": 2}, {"hostname": "h2", "count": 1}]
    assert tables.execute_query(None, f"SELECT n FROM connections::'{path}' WHERE n = 7") == [{"n": 7}]
    assert tables.describe("connections").collect()[0] == ("ip", "text", True, None)
    assert tables.preview("connections", str(path), 3).count() == 2
    seen = []
    tables.execute_query_callback(FTP_LINES, "SELECT ip FROM connections", lambda rows: seen.append(rows) or len(seen) < 2, batch=1)
    assert len(seen) == 2
    groups = []
    tables.execute_compiled_query_callback(iter(FTP_LINES), query, groups.append)
    assert groups == [[{"hostname": "h1", "count": 2}, {"hostname": "h2", "count": 1}]]
    _, rows, statistics = tables.run_with_statistics([str(path)], query)
    assert len(list(rows)) == 2 and statistics.lines == 5 and statistics.megabytes > 0 and "5 lines" in str(statistics)
    with pytest.raises(RunError):
        tables.sql("SELECT ip FROM connections", FollowFileIterator("x"))
    with pytest.raises(RunError):
        tables.sql("SELECT ip FROM connections")
    with pytest.raises(BindError):
        tables.sql("SELECT ip FROM nowhere", [])


def test_command_line(tmp_path, spark, capsys, monkeypatch):
    (tmp_path / "d.txt").write_text(FTP)
    (tmp_path / "x.log").write_text("\n".join(FTP_LINES))
    base = ["-d", str(tmp_path / "d.txt"), str(tmp_path / "x.log")]
    assert cli.main([*base, "-c", "SELECT ip, n FROM connections WHERE n = 5"]) == 0
    assert capsys.readouterr().out == "ip: '1.2.3.4', n: 5\n"
    assert cli.main([*base, "--format", "json", "--show-run-stats", "-c", "SELECT COUNT(*) AS n FROM connections"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert json.loads(out[0]) == {"n": 4} and re.match(r"read 5 lines \(.* MB\) in .* s", out[1])
    assert cli.main([*base, "-c", "SELECT nope FROM connections"]) == 1
    answers = iter(["\\d", "\\d connections", "SELECT n", "FROM connections LIMIT 1;", "oops;", "exit"])
    monkeypatch.setattr("builtins.input", lambda _: next(answers))
    assert cli.main(base) == 0
    shown = capsys.readouterr()
    assert "connections" in shown.out and "hostname" in shown.out and "n: 5" in shown.out and "expected SELECT" in shown.err


def test_table_editor(tmp_path, spark, capsys, monkeypatch):
    (tmp_path / "x.log").write_text("a;1\nb;2\n")
    answers = iter(["", "CREATE TABLE t(p = split ';',", "p[1] => k TEXT, p[2] => n INT);", "CREATE TABLE u(p = '(', p[1] => k TEXT);", "what", f"save {tmp_path}/d.txt", "exit"])
    monkeypatch.setattr("builtins.input", lambda _: next(answers))
    assert cli.main(["--edit-table", str(tmp_path / "x.log")]) == 0
    shown = capsys.readouterr()
    assert "a;1" in shown.out and re.search(r"\|a;1 *\|a *\|1 *\|", shown.out) and "expected CREATE TABLE" in shown.err
    assert (tmp_path / "d.txt").read_text() == "CREATE TABLE t(p = split ';',\np[1] => k TEXT, p[2] => n INT);\n"


# Following


def wait_for(what, seconds=60):
    end = time.time() + seconds
    while not what() and time.time() < end:
        time.sleep(0.2)
    assert what()


def test_a_file_that_begins_anew_is_read_anew(tmp_path):
    path = tmp_path / "t.log"
    path.write_text("one\ntwo\nthr")
    reader = TailReader(str(path), True)
    rows, offset = reader.read(reader.initialOffset())
    assert [r[0] for r in rows] == ["one", "two"] and offset["at"] == 8
    path.write_text("one\ntwo\nthree\n")
    rows, later = reader.read(offset)
    assert [r[0] for r in rows] == ["three"] and [r[0] for r in reader.readBetweenOffsets(offset, later)] == ["three"]
    path.write_text("another file, and longer\nthan before\n")
    rows, anew = reader.read(later)
    assert [r[0] for r in rows] == ["another file, and longer", "than before"] == [r[0] for r in reader.readBetweenOffsets(later, anew)]
    path.write_text("x\n")
    rows, short = reader.read(anew)
    assert [r[0] for r in rows] == ["x"] == [r[0] for r in reader.readBetweenOffsets(anew, short)]
    assert list(reader.read(short)[0]) == []
    tail = TailReader(str(path), False)
    assert list(tail.read(tail.initialOffset())[0]) == [] and list(TailReader(str(tmp_path / "no"), True).read({"at": 0, "seen": 0})[0]) == []


def test_follow_rows_and_limit(tables, tmp_path):
    path, got = tmp_path / "f.log", []
    path.write_text(FTP_LINES[0] + "\n" + FTP_LINES[2][:9])
    q = follow_query(tables, compile_query("SELECT ip, n FROM connections LIMIT 3"), str(path), lambda names, types, rows: got.extend(map(tuple, rows)), head=True)
    try:
        wait_for(lambda: got == [("1.2.3.4", 5)])
        with open(path, "a") as f:
            f.write(FTP_LINES[2][9:] + "\r\n" + FTP_LINES[1] + "\n" + FTP_LINES[3] + "\n" + FTP_LINES[0] + "\n")
        wait_for(lambda: len(got) >= 3)
        q.awaitTermination(60)
        assert got == [("1.2.3.4", 5), ("1.2.3.5", 7), ("1.2.3.4", 6)] and not q.isActive
    finally:
        q.stop()


def test_follow_groups_until_told_to_stop(tables, tmp_path):
    path, got = tmp_path / "g.log", []
    path.write_text(FTP_LINES[0] + "\n")
    query = "SELECT ip, COUNT(*) AS n, COUNT(DISTINCT a) AS d, ARRAY_AGG(n) AS l FROM connections GROUP BY ip HAVING COUNT(*) > 0"

    def on_rows(names, types, rows):
        got.append([tuple(r) for r in rows])
        return len(got[-1]) < 2

    q = follow_query(tables, compile_query(query), str(path), on_rows, head=True)
    try:
        wait_for(lambda: got and got[-1] == [("1.2.3.4", 1, 1, [5])])
        with open(path, "a") as f:
            f.write("\n".join(FTP_LINES[1:]) + "\n")
        q.awaitTermination(60)
        assert got[-1] == [("1.2.3.4", 2, 2, [5, 6]), ("1.2.3.5", 1, 1, [7]), ("9.9.9.9", 1, 1, [None])]
    finally:
        q.stop()


def test_follow_distinct_groups(tables, tmp_path):
    path, got = tmp_path / "d.log", []
    path.write_text("\n".join(FTP_LINES) + "\n")
    q = follow_query(tables, compile_query("SELECT DISTINCT COUNT(*) AS n FROM connections GROUP BY ip"), str(path), lambda names, types, rows: got.append([tuple(r) for r in rows]) or False, head=True)
    try:
        q.awaitTermination(60)
        assert got == [[(2,), (1,)]]
    finally:
        q.stop()


def test_iterables_go_through_a_file(spark, tables):
    lines = python_lines(spark, (x for x in ["a\r\n", "b\n", "", "ü", "last"]), True)
    assert [r["value"] for r in lines.orderBy("_order").collect()] == ["a", "b", "", "ü", "last"]
    assert sorted(values(tables, iter(FTP_LINES), "SELECT n FROM connections WHERE n > 5")) == [(6,), (7,)]
    assert python_lines(spark, iter([])).collect() == []


def test_followed_files_cant_be_joined(tables, tmp_path):
    (tmp_path / "f.log").write_text("")
    with pytest.raises(RunError):
        follow_query(tables, compile_query("SELECT ip FROM connections INNER JOIN connections::'x' ON connections.ip = connections.ip"), str(tmp_path / "f.log"), print)
