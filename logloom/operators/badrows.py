"""Delimited rows: sound ones typed, broken ones with the reason and the first broken field.

All patterns are generated from the schema. One anchored pattern decides whether a whole row is sound; only rows that fail it go through
the patterns of growing field prefixes: the first that fails names the field, and what stands from there on gives the reason. Everything runs as Java patterns in generated code;
repetitions are possessive, so that very long rows need no backtracking and no deep stack.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.lines import MONTHS, instant_seconds, without_cr, worked_out_once

_SEPARATOR = "\x01"
QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"


@dataclass(frozen=True)
class Field:
    """A field's name, the pattern of its valid values (which match neither delimiter nor double quote) and its Spark type."""

    name: str
    pattern: str
    type: str = "string"


@dataclass(frozen=True)
class RowSchema:
    fields: tuple[Field, ...]
    delimiter: str = ";"
    # Fields (year, month, day, hour, minute, second) that must form a real instant together; none if empty.
    instant: tuple[str, ...] = ()

    @property
    def any_field(self) -> str:
        return rf'(?:{self.quoted_field}|[^"{re.escape(self.delimiter)}]*+)'

    @property
    def quoted_field(self) -> str:
        return r'"[^"]*+(?:""[^"]*+)*+"'

    @property
    def rest_well_quoted(self) -> str:
        """Matches what follows sound fields if no quotes in it are broken: nothing, or fields each after its delimiter."""
        return rf"\A(?:{re.escape(self.delimiter)}{self.any_field})*+\z"

    def _valid(self, field: Field) -> str:
        return rf'(?:"(?:{field.pattern})"|(?:{field.pattern}))'

    @property
    def whole_row(self) -> str:
        return rf"\A{re.escape(self.delimiter).join(map(self._valid, self.fields))}\z"

    def prefix(self, k: int) -> str:
        """Matches the first ``k`` fields of rows in which these are valid."""
        d = re.escape(self.delimiter)
        return rf"\A{d.join(map(self._valid, self.fields[:k]))}(?={d}|\z)"

    @property
    def captures(self) -> str:
        """As whole_row, with each field's opening quote, if any, and its bare value as groups 2i-1 and 2i."""
        return rf'\A{re.escape(self.delimiter).join(f'("?+)({f.pattern})\\{2 * i + 1}' for i, f in enumerate(self.fields))}\z'

    def header(self) -> str:
        """A header line, also after a byte-order mark, its names perhaps quoted."""
        return rf"\A\x{{FEFF}}?(?i:{re.escape(self.delimiter).join(f'(?:"{f.name}"|{f.name})' for f in self.fields)})\z"


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|0[0-9]{1,2})"
_LABEL = "[A-Za-z0-9_-]{1,63}+"

CONNECTIONS = RowSchema(
    (
        Field("ip", rf"{_OCTET}(?:\.{_OCTET}){{3}}"),
        Field("hostname", rf"(?:{_LABEL}(?:\.{_LABEL})*+\.?)?"),
        Field("year", "[0-9]{4}", "bigint"),
        Field("month", f"(?i:{'|'.join(sorted(MONTHS, key=len, reverse=True))})"),
        Field("day", "[0-9]{1,2}", "bigint"),
        Field("hour", "[0-9]{1,2}", "bigint"),
        Field("minute", "[0-9]{1,2}", "bigint"),
        Field("second", "[0-9]{1,2}", "bigint"),
    ),
    instant=("year", "month", "day", "hour", "minute", "second"),
)


def classify_rows(df: DataFrame, line: str, schema: RowSchema, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep``, then ``reason`` (NULL for a sound row), ``field`` (the first broken one) and ``row`` (the typed struct of a sound row).

    The reason is ``quoting`` for broken or unclosed quotes, else ``column_count`` for another number of fields, else ``invalid_value``.
    ``field`` is the name of the first field that breaks the row, ``instant`` where only all date and time fields together do; it is NULL
    for a broken count and where quotes are broken only after the last of the schema's fields. One trailing carriage return is no part of a row. NULL, blank and header lines are no rows and don't come out.
    Copies come out as often as they stand there. An empty input gives no rows.
    """
    # Columns are held in a struct until the end: no name of the input can clash with those made here.
    d = df.select(F.struct(*keep).alias("_keep") if keep else F.lit(None).alias("_keep"), without_cr(F.col(line)).alias("_line"))
    d = d.where(F.col("_line").isNotNull() & ~F.col("_line").rlike(r"(?U)\A[\s\x{FEFF}]*+\z") & ~F.col("_line").rlike(schema.header()))
    text, n = F.col("_line"), len(schema.fields)
    # The bare values of a row of the right shape come from one match; as many parts as fields come out only if it matches.
    single = F.when(text.rlike(schema.whole_row), F.array(*[F.regexp_extract(text, schema.captures, 2 * i) for i in range(1, n + 1)]))
    parts = F.split(F.regexp_replace(text, schema.captures, _SEPARATOR.join(f"${2 * i}" for i in range(1, n + 1))), _SEPARATOR, -1)
    d = worked_out_once(d, "_cells", F.when(F.contains(text, F.lit(_SEPARATOR)) | F.lit(n < 2), single).otherwise(parts))
    shaped = F.coalesce(F.size("_cells") == n, F.lit(False))
    cells = {f.name: F.get(F.col("_cells"), F.lit(i)) for i, f in enumerate(schema.fields)}
    typed = {f.name: (cells[f.name] if f.type == "string" else cells[f.name].try_cast(f.type)) for f in schema.fields}
    sound = shaped & (instant_seconds(*[typed[x] for x in schema.instant]).isNotNull() if schema.instant else F.lit(True))
    # Rows that aren't sound go through the prefixes: the first that fails stands at the first broken field, and what follows the sound fields
    # before it gives the reason, as those can break nothing.
    at = F.when(sound, 0).when(shaped, n + 1)
    for k in range(1, n + 1):
        at = at.when(~text.rlike(schema.prefix(k)), k)
    d = worked_out_once(d, "_at", at.otherwise(n + 1))
    rest = F.when(F.col("_at") == 1, F.concat(F.lit(schema.delimiter), text))
    for k in range(1, n + 1):
        rest = rest.when(F.col("_at") == k + 1, F.regexp_replace(text, schema.prefix(k), ""))
    d = worked_out_once(d, "_rest", rest)
    bare = F.regexp_replace("_rest", schema.quoted_field, "")
    width = F.col("_at") - 1 + F.char_length(bare) - F.char_length(F.replace(bare, F.lit(schema.delimiter), F.lit("")))
    reason = F.when(~F.col("_rest").rlike(schema.rest_well_quoted), QUOTING).when(width != n, COLUMN_COUNT).otherwise(INVALID_VALUE)
    d = worked_out_once(d, "_reason", F.when(F.col("_at") > 0, reason))
    is_sound = F.col("_reason").isNull()
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    broken = F.when(F.col("_reason") != COLUMN_COUNT, F.when(F.col("_rest") == "", "instant").otherwise(F.get(names, F.col("_at") - 1)))
    row = F.when(is_sound, F.struct(*[v.alias(x) for x, v in typed.items()]))
    return d.select(*[F.col("_keep")[k].alias(k) for k in keep], F.col("_reason").alias("reason"), broken.alias("field"), row.alias("row"))
