"""Expressions with names to typed Spark expressions.

Comparisons are two-valued: with a NULL on either side they are false. IS, IS NOT and IN compare NULLs like values. AND and OR take anything
that isn't true for false; NOT and arithmetic keep NULL.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.aggregates import AGGREGATES
from logloom.functions.convert import display_text, interval_micros, must_parse
from logloom.functions.scalars import FUNCTIONS, Typed
from logloom.plans import tree
from logloom.plans.errors import BindError
from logloom.plans.types import BOOLEAN, INT, INTERVAL, NULL, REAL, TEXT, TIMESTAMP, SqlType, common_type

_COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


class Scope:
    """What names, and in aggregates whole expressions, stand for."""

    def __init__(self, names: dict[str, Typed], known: dict[tree.Node, Typed] | None = None, grouped: bool = False):
        self.names, self.known, self.grouped = names, known or {}, grouped

    def name(self, n: tree.Name) -> Typed:
        if str(n) not in self.names:
            raise BindError(f"there is no column {n}")
        if self.grouped:
            raise BindError(f"the column {n} must be a group key or stand in an aggregate")
        return self.names[str(n)]


def truth(x: Typed) -> Column:
    """True or false; NULL and what is no BOOLEAN are false."""
    return F.coalesce(x.column, F.lit(False)) if x.type == BOOLEAN else F.lit(False)


def bind(node: tree.Node, scope: Scope) -> Typed:
    if node in scope.known:
        return scope.known[node]
    if isinstance(node, tree.Literal):
        return Typed(F.lit(node.value), node.type, node.value)
    if isinstance(node, tree.Name):
        return scope.name(node)
    if isinstance(node, tree.Star):
        raise BindError("* must be the only projection")
    if isinstance(node, tree.Unary):
        return _unary(node, scope)
    if isinstance(node, tree.Binary):
        return _binary(node.op, bind(node.left, scope), bind(node.right, scope))
    if isinstance(node, tree.Within):
        x, items = bind(node.operand, scope), [bind(i, scope) for i in node.items]
        found = reduce(or_, [_same(x, i) for i in items])
        return Typed(~found if node.negated else found, BOOLEAN)
    if isinstance(node, tree.Case):
        conditions = [truth(bind(c, scope)) for c, _ in node.branches]
        values = [bind(v, scope) for _, v in node.branches]
        last = bind(node.otherwise, scope)
        kind = common_type([v.type for v in (*values, last)], "CASE")
        out = reduce(lambda acc, cv: acc.when(cv[0], cv[1].to(kind)), zip(conditions, values), F)
        return Typed(out.otherwise(last.to(kind)), kind)
    if isinstance(node, tree.Cast):
        return cast(bind(node.operand, scope), node.type)
    if isinstance(node, tree.Item):
        array, index = bind(node.operand, scope), bind(node.index, scope).to(INT)
        if not array.type.element:
            raise BindError(f"only an array has items, not {array.type}")
        return Typed(F.when(index >= 1, F.get(array.column, (F.least(index, F.lit(2**31 - 1)) - 1).cast("int"))), array.type.element)
    if isinstance(node, tree.Call):
        if node.name in AGGREGATES:
            raise BindError(f"{node.name} can't stand here")
        if node.name not in FUNCTIONS:
            raise BindError(f"there is no function {node.name}")
        if node.distinct:
            raise BindError(f"DISTINCT can't stand in {node.name}")
        return FUNCTIONS[node.name]([bind(a, scope) for a in node.args])
    raise BindError(f"can't bind {node}")


def _unary(node: tree.Unary, scope: Scope) -> Typed:
    x = bind(node.operand, scope)
    if node.op == "not":
        if x.type not in (BOOLEAN, NULL):
            raise BindError(f"NOT takes BOOLEAN, not {x.type}")
        return Typed(~x.to(BOOLEAN), BOOLEAN)
    if x.type not in (INT, REAL, NULL):
        raise BindError(f"- takes INT or REAL, not {x.type}")
    return Typed(-x.column, x.type, -x.literal if x.literal is not None else None) if x.type != NULL else x


def _sides(a: Typed, b: Typed, what: str) -> tuple[Column, Column, SqlType]:
    """Both values in the one type in which they compare; a literal text beside a TIMESTAMP is read as one."""
    for x, y in ((a, b), (b, a)):
        if x.type == TIMESTAMP and y.type == TEXT and y.literal is not None:
            return a.to(TIMESTAMP), b.to(TIMESTAMP), TIMESTAMP
    kind = common_type([a.type, b.type], what)
    return a.to(kind), b.to(kind), kind


def _same(a: Typed, b: Typed) -> Column:
    left, right, _ = _sides(a, b, "a comparison")
    return left.eqNullSafe(right)


def _binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("and", "or"):
        return Typed((and_ if op == "and" else or_)(truth(a), truth(b)), BOOLEAN)
    if op in ("is", "is not"):
        return Typed(_same(a, b) if op == "is" else ~_same(a, b), BOOLEAN)
    if op in _COMPARE:
        left, right, _ = _sides(a, b, f"the comparison {op}")
        return Typed(F.coalesce(getattr(left, _COMPARE[op])(right), F.lit(False)), BOOLEAN)
    return _arithmetic(op, a, b)


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    kinds = (a.type, b.type)
    if kinds == (NULL, NULL):
        return a
    if TIMESTAMP in kinds or INTERVAL in kinds:
        left, right = (x.column if x.type != NULL else x.to(TIMESTAMP if kinds == (TIMESTAMP, NULL) and op == "-" else INTERVAL) for x in (a, b))
        if kinds in ((TIMESTAMP, TIMESTAMP), (TIMESTAMP, NULL)) and op == "-":
            return Typed(left - right, INTERVAL)
        if op in "+-" and set(kinds) <= {INTERVAL, NULL}:
            return Typed(left + right if op == "+" else left - right, INTERVAL)
        if op in "+-" and a.type == TIMESTAMP and b.type in (INTERVAL, NULL):
            return Typed(left + right if op == "+" else left - right, TIMESTAMP)
        if op == "+" and b.type == TIMESTAMP and a.type in (INTERVAL, NULL):
            return Typed(right + left, TIMESTAMP)
        raise BindError(f"there is no {a.type} {op} {b.type}")
    kind = common_type([*kinds], f"the operator {op}")
    if kind not in (INT, REAL):
        raise BindError(f"there is no {a.type} {op} {b.type}")
    left, right = a.to(kind), b.to(kind)
    if op == "+":
        return Typed(left + right, kind)
    if op == "-":
        return Typed(left - right, kind)
    if op == "*":
        return Typed(left * right, kind)
    if kind == INT:
        return Typed(F.call_function("div", left, right), INT)
    # As for floating point numbers in general: infinite, or NaN for 0 / 0.
    special = F.when(F.isnan(left) | (left == 0), float("nan")).when((left > 0) == (right.cast("string") != "-0.0"), float("inf")).otherwise(float("-inf"))
    return Typed(F.when(left.isNull() | right.isNull(), None).when(right == 0, special).otherwise(left / F.when(right != 0, right)), REAL)


def cast(x: Typed, kind: SqlType) -> Typed:
    if x.type == kind:
        return x
    if kind == TEXT:
        return Typed(display_text(x.column, x.type), TEXT)
    if x.type == NULL:
        return Typed(x.to(kind), kind)
    if x.type == TEXT:
        return Typed(must_parse(x.column, kind), kind)
    if x.type == INTERVAL and kind == INT:
        return Typed((interval_micros(x.column) / 1000000).cast("bigint"), INT)
    if x.type == INTERVAL and kind == REAL:
        return Typed((interval_micros(x.column) / 1000).cast("bigint") / F.lit(1000.0), REAL)
    if {x.type, kind} == {INT, REAL}:
        return Typed(x.column.cast(kind.spark), kind)
    raise BindError(f"{x.type} can't be made {kind}")
