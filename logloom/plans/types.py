"""The SQL types and how Spark represents them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from logloom.plans.errors import BindError


@dataclass(frozen=True)
class SqlType:
    name: str
    element: SqlType | None = None

    def __str__(self) -> str:
        return f"{self.element}[]" if self.element else self.name

    @property
    def spark(self) -> T.DataType:
        if self.element:
            return T.ArrayType(self.element.spark)
        return {"text": T.StringType(), "int": T.LongType(), "real": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "interval": T.DayTimeIntervalType(0, 3), "null": T.NullType()}[self.name]


TEXT, INT, REAL, BOOLEAN, TIMESTAMP, INTERVAL, NULL = (SqlType(n) for n in ("text", "int", "real", "boolean", "timestamp", "interval", "null"))
SCALARS = {t.name: t for t in (TEXT, INT, REAL, BOOLEAN, TIMESTAMP, INTERVAL)}


def array_of(t: SqlType) -> SqlType:
    return SqlType("array", t)


def common_type(types: list[SqlType], what: str) -> SqlType:
    """The one type of several values: NULLs take any, INT becomes REAL beside REAL."""
    known = {t for t in types if t != NULL}
    if not known:
        return NULL
    if len(known) == 1:
        return known.pop()
    if known == {INT, REAL}:
        return REAL
    raise BindError(f"{what} needs values of one type, not {', '.join(sorted(map(str, known)))}")
