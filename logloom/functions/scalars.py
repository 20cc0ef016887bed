"""The scalar functions: each takes typed arguments and gives a typed value. NULL arguments give NULL unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.convert import must_parse
from logloom.plans.errors import BindError
from logloom.plans.types import BOOLEAN, INT, INTERVAL, NULL, REAL, TEXT, TIMESTAMP, SqlType, array_of, common_type
from logloom.sources.patterns import FLAGS, compile_pattern


@dataclass
class Typed:
    """A Spark expression with its SQL type; ``literal`` holds the value where it is one."""

    column: Column
    type: SqlType
    literal: Any = None

    def to(self, kind: SqlType) -> Column:
        if self.type == kind:
            return self.column
        if self.type == NULL or (self.type, kind) == (INT, REAL):
            return self.column.cast(kind.spark)
        if kind == TIMESTAMP and self.type == TEXT and self.literal is not None:
            return must_parse(self.column, TIMESTAMP)
        raise BindError(f"expected {kind}, found {self.type}")


FUNCTIONS: dict[str, Callable[[list[Typed]], Typed]] = {}


def _function(name: str, *counts: int):
    def register(f: Callable[[list[Typed]], Typed]):
        def checked(args: list[Typed]) -> Typed:
            if counts and len(args) not in counts:
                raise BindError(f"{name} takes {' or '.join(map(str, counts))} arguments, not {len(args)}")
            return f(args)

        FUNCTIONS[name] = checked
        return f

    return register


def _one_of(name: str, kind: SqlType, *allowed: SqlType) -> SqlType:
    if kind not in allowed and kind != NULL:
        raise BindError(f"{name} takes {', '.join(map(str, allowed))}, not {kind}")
    return kind


def _extreme(name: str, pick: Callable[..., Column]):
    @_function(name, 2)
    def extreme(args: list[Typed]) -> Typed:
        kind = _one_of(name, common_type([a.type for a in args], name), INT, REAL, TIMESTAMP, INTERVAL)
        a, b = (x.to(kind) for x in args)
        return Typed(F.when(a.isNotNull() & b.isNotNull(), pick(a, b)), kind)


_extreme("greatest", F.greatest)
_extreme("least", F.least)


@_function("abs", 1)
def _abs(args: list[Typed]) -> Typed:
    kind = _one_of("abs", args[0].type, INT, REAL, INTERVAL)
    return Typed(F.abs(args[0].column) if kind != NULL else args[0].column, kind)


@_function("sqrt", 1)
def _sqrt(args: list[Typed]) -> Typed:
    return Typed(F.sqrt(args[0].to(REAL)), REAL)


@_function("pow", 2)
def _pow(args: list[Typed]) -> Typed:
    kind = _one_of("pow", common_type([a.type for a in args], "pow"), INT, REAL)
    a, b = (x.to(REAL) for x in args)
    if kind != INT:
        return Typed(F.pow(a, b), REAL)
    # Whole powers are multiplied out exactly (in decimals of 38 digits); more than INT holds is an error.
    base, exponent = (x.column for x in args)
    times = F.when(exponent < 0, F.raise_error(F.lit("a negative exponent")).cast("bigint")).when(F.abs(base) <= 1, F.pmod(exponent, F.lit(2))).otherwise(F.least(exponent, F.lit(64)))
    product = F.aggregate(F.array_repeat(base, times.cast("int")), F.lit(1).cast("bigint"), lambda acc, x: acc * x)
    return Typed(F.when(a.isNotNull() & b.isNotNull(), F.when((base == 0) & (exponent > 0), F.lit(0).cast("bigint")).otherwise(product)), INT)


@_function("length", 1)
def _length(args: list[Typed]) -> Typed:
    return Typed(F.char_length(args[0].to(TEXT)).cast("bigint"), INT)


@_function("upper", 1)
def _upper(args: list[Typed]) -> Typed:
    return Typed(F.upper(args[0].to(TEXT)), TEXT)


@_function("lower", 1)
def _lower(args: list[Typed]) -> Typed:
    return Typed(F.lower(args[0].to(TEXT)), TEXT)


@_function("regexp_matches", 2)
def _matches(args: list[Typed]) -> Typed:
    pattern = args[1]
    if pattern.literal is not None:
        java = F.lit(FLAGS + compile_pattern(pattern.literal).java)
    else:
        java = F.concat(F.lit(FLAGS), pattern.to(TEXT))
    return Typed(F.coalesce(F.regexp_like(args[0].to(TEXT), java), F.lit(False)), BOOLEAN)


@_function("create_array")
def _create_array(args: list[Typed]) -> Typed:
    kind = common_type([a.type for a in args], "an array")
    if kind == NULL:
        raise BindError("an array needs at least one value with a type")
    return Typed(F.array(*[a.to(kind) for a in args]), array_of(kind))


def _array(name: str, arg: Typed) -> SqlType:
    if not arg.type.element:
        raise BindError(f"{name} takes an array, not {arg.type}")
    return arg.type


@_function("array_unique", 1)
def _unique(args: list[Typed]) -> Typed:
    return Typed(F.sort_array(F.array_distinct(args[0].column)), _array("array_unique", args[0]))


@_function("array_length", 1)
def _array_length(args: list[Typed]) -> Typed:
    _array("array_length", args[0])
    return Typed(F.array_size(args[0].column).cast("bigint"), INT)


@_function("array_cat", 2)
def _cat(args: list[Typed]) -> Typed:
    if _array("array_cat", args[0]) != _array("array_cat", args[1]):
        raise BindError(f"array_cat takes arrays of one type, not {args[0].type} and {args[1].type}")
    return Typed(F.concat(args[0].column, args[1].column), args[0].type)


def _grown(name: str, array: Typed, item: Typed, put: Callable[[Column, Column], Column]) -> Typed:
    kind = _array(name, array)
    return Typed(put(array.column, item.to(kind.element)), kind)


@_function("array_append", 2)
def _append(args: list[Typed]) -> Typed:
    return _grown("array_append", args[0], args[1], F.array_append)


@_function("array_prepend", 2)
def _prepend(args: list[Typed]) -> Typed:
    return _grown("array_prepend", args[1], args[0], F.array_prepend)


@_function("now", 0)
def _now(args: list[Typed]) -> Typed:
    return Typed(F.current_timestamp(), TIMESTAMP)


@_function("make_timestamp", 7, 8)
def _make_timestamp(args: list[Typed]) -> Typed:
    """Year, month, day, hour, minute, second, microsecond; NULL for a date that doesn't exist. An eighth argument is ignored."""
    y, mo, d, h, mi, s, us = (a.to(INT) for a in args[:7])
    fits = y.between(0, 9999) & mo.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59) & us.between(0, 999999)
    y, mo, d, h, mi, s, us = (F.when(fits, c).cast("int") for c in (y, mo, d, h, mi, s, us))
    return Typed(F.try_make_timestamp(y, mo, d, h, mi, (s + us / F.lit(1000000).cast("decimal(9,0)")).cast("decimal(8,6)")), TIMESTAMP)


@_function("timestamp_extract_epoch", 1)
def _epoch(args: list[Typed]) -> Typed:
    return Typed(F.unix_millis(args[0].to(TIMESTAMP)) / F.lit(1000.0), REAL)


def _extract(part: str, get: Callable[[Column], Column]):
    @_function(f"timestamp_extract_{part}", 1)
    def extract(args: list[Typed]) -> Typed:
        return Typed(get(args[0].to(TIMESTAMP)).cast("bigint"), INT)


for _part, _get in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second)):
    _extract(_part, _get)

# What timestamps can be cut to.
_UNITS = {"year": "year", "month": "month", "day": "day", "hour": "hour", "minute": "minute", "second": "second", "milliseconds": "millisecond", "microseconds": "microsecond"}


@_function("date_trunc", 2)
def _date_trunc(args: list[Typed]) -> Typed:
    unit = args[0].literal
    if unit not in _UNITS:
        raise BindError(f"date_trunc takes one of {', '.join(_UNITS)}")
    return Typed(F.date_trunc(_UNITS[unit], args[1].to(TIMESTAMP)), TIMESTAMP)
