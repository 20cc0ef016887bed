"""Text to values and values to text, as Spark expressions, and as Python for what is printed."""

from __future__ import annotations

import math
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.plans.types import BOOLEAN, INT, INTERVAL, NULL, REAL, TEXT, TIMESTAMP, SqlType

_REAL = r"(?i)\A[+-]?(?:inf(?:inity)?|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\z"


def parse_text(text: Column, kind: SqlType) -> Column:
    """The value of a text, NULL if it has none of this type."""
    if kind == TEXT:
        return text
    if kind == INT:
        return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))
    if kind == REAL:
        plain = F.regexp_replace(text, r"\A\+", "")
        return F.when(text.rlike(_REAL), plain.try_cast("double"))
    if kind == BOOLEAN:
        return F.when(text == "true", True).when(text == "false", False)
    if kind == TIMESTAMP:
        return F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    if kind == INTERVAL:
        parts = F.split(text, ":")
        number = lambda i: parts[i].try_cast("int")
        return F.when(text.rlike(r"\A[+-]?[0-9]{1,9}:[+-]?[0-9]{1,9}:[+-]?[0-9]{1,9}\z"), F.make_dt_interval(F.lit(0), number(0), number(1), number(2).cast("decimal(18,6)")))
    return F.lit(None).cast(kind.spark)


def must_parse(text: Column, kind: SqlType) -> Column:
    """As parse_text, but a text without value of this type fails the query; NULL stays NULL."""
    return F.coalesce(parse_text(text, kind), F.when(text.isNotNull(), F.raise_error(F.concat(F.lit(f"not a value of type {kind}: "), text)).cast(kind.spark)))


def interval_micros(value: Column) -> Column:
    """All microseconds of an interval."""
    part = lambda p: F.extract(F.lit(p), value).cast("decimal(38,6)")
    return ((part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")) * 1000000).cast("bigint")


def _two(n: Column) -> Column:
    return F.when(F.length(n.cast("string")) < 2, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def display_text(value: Column, kind: SqlType, quoted: bool = True) -> Column:
    """The printed form of a value; texts in single quotes, NULL as ``NULL``."""
    if kind == NULL:
        return F.lit("NULL")
    if kind == REAL:
        text = F.when(F.isnan(value), "NaN").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(F.format_string("%.2f", value))
    elif kind == TEXT:
        text = F.concat(F.lit("'"), value, F.lit("'")) if quoted else value
    elif kind == TIMESTAMP:
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSS")
    elif kind == INTERVAL:
        ms = (interval_micros(value) / 1000).cast("bigint")
        s = (ms / 1000).cast("bigint")
        rest = lambda x, n: x - (x / n).cast("bigint") * n
        text = F.concat(_two((s / 3600).cast("bigint")), F.lit(":"), _two(rest((s / 60).cast("bigint"), 60)), F.lit(":"), _two(rest(s, 60)), F.lit("."), F.lpad((ms - s * 1000).cast("string"), 3, "0"))
    elif kind.element:
        text = F.concat(F.lit("{"), F.array_join(F.transform(value, lambda x: display_text(x, kind.element)), ", "), F.lit("}"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def display(value: Any, kind: SqlType) -> str:
    """The printed form of a collected value."""
    if value is None:
        return "NULL"
    if kind == REAL:
        return "NaN" if math.isnan(value) else ("inf" if value > 0 else "-inf") if math.isinf(value) else f"{value:.2f}"
    if kind == TEXT:
        return f"'{value}'"
    if kind == BOOLEAN:
        return "true" if value else "false"
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S.") + f"{value.microsecond // 1000:03}"
    if isinstance(value, timedelta):
        ms = int(value / timedelta(milliseconds=1))
        s = int(ms / 1000)
        return f"{int(s / 3600):0>2}:{int(math.fmod(int(s / 60), 60)):0>2}:{int(math.fmod(s, 60)):0>2}.{ms - s * 1000:0>3}"
    if kind.element:
        return "{" + ", ".join(display(x, kind.element) for x in value) + "}"
    return str(value)


def json_value(value: Any, kind: SqlType) -> Any:
    """What a collected value is in JSON output; numbers that JSON doesn't have are null."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return None
    if kind in (TIMESTAMP, INTERVAL):
        return display(value, kind)
    if kind.element:
        return [json_value(x, kind.element) for x in value]
    return value
