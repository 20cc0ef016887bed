"""Statements to DataFrames.

Only what Spark's optimizer can't know is decided here: names and types, which columns of a table are needed, the null-safe join, hidden
aggregates for HAVING, and the order of results. Everything else is left to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.aggregates import AGGREGATES, ORDERED, build, percentile_share
from logloom.functions.scalars import Typed
from logloom.plans import tree
from logloom.plans.binder import Scope, bind, truth
from logloom.plans.errors import BindError, RunError
from logloom.plans.types import INT, TEXT, SqlType
from logloom.sources.extract import INPUT, Extractor
from logloom.sources.lines import ORDER


@dataclass
class Plan:
    """A result: its rows and the SQL types of their columns."""

    df: DataFrame
    types: list[SqlType]
    aggregate: bool
    limit: int | None = None  # for streams, which are stopped from outside
    distinct: bool = False  # for streams of groups, whose copies are dropped outside

    @property
    def names(self) -> list[str]:
        return self.df.columns


def walk(node: tree.Node):
    yield node
    for c in node.children():
        yield from walk(c)


def aggregates_in(node: tree.Node) -> list[tree.Call]:
    return [n for n in walk(node) if isinstance(n, tree.Call) and n.name in AGGREGATES]


def is_aggregate(s: tree.Select) -> bool:
    return s.group_by is not None or any(aggregates_in(p.expression) for p in s.projections)


def needs_order(s: tree.Select) -> bool:
    if s.distinct and not is_aggregate(s):
        return True
    nodes = [*(p.expression for p in s.projections), *([s.having] if s.having else [])]
    return any(a.name in ORDERED for n in nodes for a in aggregates_in(n))


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def plan(s: tree.Select, tables: dict[str, tree.TableDef], lines: DataFrame, joined: Callable[[str], DataFrame] | None = None, streaming: bool = False) -> Plan:
    """The plan of a statement over ``lines`` (value, and ORDER if needed); ``joined`` reads the lines of the joined file."""
    base, names, stars = _source(s, tables, lines, joined, streaming)
    scope = Scope(names)
    if s.where is not None:
        base = base.where(truth(bind(s.where, scope)))
    projections = []
    for i, p in enumerate(s.projections):
        if isinstance(p.expression, tree.Star):
            if len(s.projections) > 1:
                raise BindError("* must be the only projection")
            projections = [(n, e) for n, e in stars]
        else:
            projections.append((p.name or _default_name(p.expression, i), p.expression))
    if is_aggregate(s):
        return _aggregate(s, base, scope, projections, streaming)
    if s.having is not None:
        raise BindError("HAVING needs GROUP BY or an aggregate")
    values = [(n, bind(e, scope)) for n, e in projections]
    if s.distinct and not streaming and ORDER in base.columns:
        out = _first_seen(base.select(*[_output(v).alias(f"_p{i}") for i, (_, v) in enumerate(values)], ORDER), len(values))
        out = out.select(*[F.col(f"_p{i}").alias(n) for i, (n, _) in enumerate(values)])
    else:
        out = base.select(*[_output(v).alias(n) for n, v in values])
        if s.distinct:
            out = out.dropDuplicates()
    if s.limit is not None and not streaming:
        out = out.limit(s.limit)
    return Plan(out, [v.type for _, v in values], False, s.limit)


def _first_seen(rows: DataFrame, width: int) -> DataFrame:
    """Each of the rows (_p0, ...) once, in the order of its first line.

    The first line is found within each block of a file before blocks are compared: a number can be kept in a hash table, the whole order of
    lines can't, and would have all rows sorted.
    """
    names = [f"_p{i}" for i in range(width)]
    *outer, last = rows.schema[ORDER].dataType.fields
    if last.dataType.typeName() != "long":
        return rows.groupBy(*names).agg(F.min(ORDER).alias("_first")).orderBy("_first")
    block = [f"_o{j}" for j in range(len(outer))]
    found = rows.select(*names, *[F.col(ORDER)[f.name].alias(o) for f, o in zip(outer, block)], F.col(ORDER)[last.name].alias("_line_no")).groupBy(*names, *block).agg(F.min("_line_no").alias("_first"))
    if block:
        found = found.groupBy(*names).agg(F.min(F.struct(*block, "_first")).alias("_first"))
    return found.orderBy("_first")


def _output(v: Typed):
    return v.column.cast("string") if v.type.name == "null" else v.column


def _default_name(e: tree.Node, i: int) -> str:
    if isinstance(e, tree.Name):
        return str(e)
    inner = aggregates_in(e)
    return f"{inner[0].name}{i}" if inner else f"p{i}"


def _source(s: tree.Select, tables: dict[str, tree.TableDef], lines: DataFrame, joined, streaming: bool):
    """The rows that WHERE sees, what names stand for, and what * stands for."""
    table = _table(tables, s.table)
    used = {n for part in (*(p.expression for p in s.projections), *(s.group_by or ()), s.where, s.having) if part is not None for n in walk(part)}
    star = tree.Star() in {p.expression for p in s.projections}
    wanted = {n.name for n in used if isinstance(n, tree.Name)} | ({s.join.left.name, s.join.right.name} if s.join else set())

    def side(t: tree.TableDef, rows: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, Typed]]:
        needed = {c.name for c in t.columns if star or c.name in wanted}
        d = Extractor(t).rows(rows, needed)
        kept = [c for c in t.columns if c.name in needed]
        d = d.select(*[c for c in d.columns if c in (ORDER, "_line")], *[F.col(_quoted(c.name)).alias(f"{prefix}{i}") for i, c in enumerate(kept)])
        return d, {c.name: Typed(F.col(f"{prefix}{i}"), c.type) for i, c in enumerate(kept)}

    left, mine = side(table, lines, "a")
    names = {INPUT: Typed(F.col("_line"), TEXT)}
    if s.join is None:
        names = {**mine, **{f"{table.name}.{n}": v for n, v in mine.items()}, **names, f"{table.name}.{INPUT}": names[INPUT]}
        return left, names, [(c.name, tree.Name(c.name, table.name)) for c in table.columns]
    if streaming:
        raise RunError("a followed file can't be joined")
    if joined is None:
        raise RunError("there is no way to read the joined file")
    j = s.join
    other = _table(tables, j.table)
    right, theirs = side(other, joined(j.path), "b")
    right = right.drop("_line", ORDER)
    sides = {}
    for n in (j.left, j.right):
        if n.table == table.name and table.name not in sides:
            sides[table.name] = mine.get(n.name)
        elif n.table == other.name:
            sides[other.name] = theirs.get(n.name)
        else:
            raise BindError(f"{n} in ON belongs to neither table")
    a, b = sides.get(table.name), sides.get(other.name)
    if len(sides) < 2 or a is None or b is None:
        raise BindError("ON must compare a column of each table")
    if a.type != b.type:
        raise BindError(f"ON compares {a.type} with {b.type}")
    # NULL keys meet. An aggregate over an outer join sees only the rows that found a partner. Which side is broadcast, if any, is left to
    # Spark, which knows the files' sizes.
    how = "left" if j.outer and not is_aggregate(s) else "inner"
    d = left.join(right, a.column.eqNullSafe(b.column), how)
    names = {**theirs, **mine, **{f"{other.name}.{n}": v for n, v in theirs.items()}, **{f"{table.name}.{n}": v for n, v in mine.items()}, **names}
    taken = {c.name for c in table.columns}
    stars = [(c.name, tree.Name(c.name, table.name)) for c in table.columns]
    stars += [(f"{other.name}.{c.name}" if c.name in taken else c.name, tree.Name(c.name, other.name)) for c in other.columns]
    return d, names, stars


def _table(tables: dict[str, tree.TableDef], name: str) -> tree.TableDef:
    if name not in tables:
        raise BindError(f"there is no table {name}")
    return tables[name]


def _aggregate(s: tree.Select, base: DataFrame, scope: Scope, projections: list[tuple[str, tree.Node]], streaming: bool) -> Plan:
    keys = [(k, bind(k, scope)) for k in s.group_by or ()]
    calls = list(dict.fromkeys(a for e in (*(e for _, e in projections), *([s.having] if s.having is not None else [])) for a in aggregates_in(e)))
    known = {k: Typed(F.col(f"_k{i}"), v.type) for i, (k, v) in enumerate(keys)}
    for k in list(known):  # a key may be written with or without its table
        if isinstance(k, tree.Name):
            same = {tree.Name(k.name), tree.Name(k.name, s.table)} if k.table in (None, s.table) else {k}
            known.update({n: known[k] for n in same})
    columns, ranked = [], {}
    for i, call in enumerate(calls):
        args = () if call.args == (tree.Star(),) else call.args
        if any(aggregates_in(a) for a in args):
            raise BindError(f"{call.name} can't stand in an aggregate")
        if call.name == "count" and args and not isinstance(args[0], tree.Name):
            raise BindError("count takes a column")
        typed = [bind(a, scope) for a in args]
        if call.name == "percentile" and not streaming:
            known[call] = Typed(F.col(f"_a{i}"), typed[0].type)
            ranked.setdefault(args[0], (typed[0], []))[1].append((f"_a{i}", percentile_share(typed)))
            continue
        if call.name == "count" and call.distinct and streaming and typed:
            made = Typed(F.array_size(F.collect_set(typed[0].column)).cast("bigint"), INT)
        else:
            made = build(call.name, typed, call.distinct, lambda: F.col(ORDER))
        columns.append(made.column.alias(f"_a{i}"))
        known[call] = Typed(F.col(f"_a{i}"), made.type)
    hidden = F.count(F.lit(1)).alias("_rows")
    d = base.groupBy(*[_output(v).alias(f"_k{i}") for i, (_, v) in enumerate(keys)]).agg(*columns, hidden)
    if not keys:
        d = d.where("_rows > 0")
    for value, picks in ranked.values():
        d = _with_percentiles(d, base, keys, value, picks)
    if len(calls) == 1 and calls[0].name == "count" and calls[0].args not in ((), (tree.Star(),)):
        d = d.where("_a0 > 0")
    after = Scope(scope.names, known, grouped=True)
    if s.having is not None:
        d = d.where(truth(bind(s.having, after)))
    values = [(n, bind(e, after)) for n, e in projections]
    order = [F.col(f"_k{i}").asc_nulls_first() for i in range(len(keys))]
    if s.distinct and not streaming:
        d = d.groupBy(*[_output(v).alias(f"_p{i}") for i, (_, v) in enumerate(values)]).agg(*[F.min(F.struct(*[f"_k{i}" for i in range(len(keys))])).alias("_first")] if keys else [F.count(F.lit(1)).alias("_first")])
        d = d.orderBy("_first").select(*[F.col(f"_p{i}").alias(n) for i, (n, _) in enumerate(values)])
    else:
        d = (d.orderBy(*order) if order else d).select(*[_output(v).alias(n) for n, v in values])
    if s.limit is not None and not streaming:
        d = d.limit(s.limit)
    return Plan(d, [v.type for _, v in values], True, s.limit, s.distinct and streaming)


def _with_percentiles(groups: DataFrame, base: DataFrame, keys: list[tuple[tree.Node, Typed]], value: Typed, picks: list[tuple[str, float]]) -> DataFrame:
    """Adds, for each (column, share), the value at the place floor(share * n) of a group's sorted values, the last one for a share of 1.

    Values are counted first; running sums over a group's distinct values find the place, so that no group is ever held in memory.
    """
    names = [f"_q{i}" for i in range(len(keys))] or ["_q"]
    of = [_output(v).alias(n) for n, (_, v) in zip(names, keys)] or [F.lit(0).alias("_q")]
    counts = base.select(*of, _output(value).alias("_x")).where("_x IS NOT NULL").groupBy(*names, "_x").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*names)
    counts = counts.withColumn("_upto", F.sum("_n").over(group.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_of", F.sum("_n").over(group))
    found = []
    for column, share in picks:
        place = F.least(F.floor(F.col("_of") * F.lit(share)), F.col("_of") - 1)
        found.append(F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place), F.col("_x"))).alias(column))
    if not keys:
        groups = groups.withColumn("_k0", F.lit(0))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(n)) for i, n in enumerate(names)]
    return groups.join(counts.groupBy(*names).agg(*found), reduce(and_, same), "left").drop(*names)
