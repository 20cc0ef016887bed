"""Lines to typed rows, as Spark expressions over one string column.

Columns of one capture pattern come from a single match of the line: the match's groups are written side by side and split again, so that
the pattern runs once for a line however many columns there are. Only the groups of columns in use are taken.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.convert import parse_text
from logloom.operators.lines import month_number, worked_out_once
from logloom.plans.errors import BindError, PatternError
from logloom.plans.tree import ColumnDef, Reference, TableDef
from logloom.plans.types import BOOLEAN, INT, REAL, TEXT, TIMESTAMP, SqlType
from logloom.sources.patterns import FLAGS, Pattern, compile_pattern

#: Beside the columns, a row keeps its line under this name.
INPUT = "input"
_SEPARATOR = "\x01"


class Extractor:
    """What a table definition makes of a line; ``needed`` limits the columns that will be used."""

    def __init__(self, table: TableDef):
        self.table = table
        self.patterns: dict[str, Pattern] = {}
        names = [c.name for c in table.columns]
        if len(set(names)) < len(names):
            raise BindError(f"the table {table.name} has two columns of one name")
        for p in table.patterns:
            self.patterns[p.name] = compile_pattern(p.regex)
        for c in table.columns:
            for r in c.references:
                if r.pattern not in self.patterns:
                    raise PatternError(f"the column {c.name} refers to the unknown pattern {r.pattern}")
            if c.convert and c.type.element:
                raise BindError(f"CONVERT can't make an array for the column {c.name}")

    def rows(self, lines: DataFrame, needed: set[str] | None = None) -> DataFrame:
        """The table's columns and the line for each line that makes a row.

        A line without any value makes no row, nor does one whose NOT NULL column is NULL. ``lines`` has one column of strings, ``value``.
        Columns outside ``needed`` are left out, and not worked out unless they decide whether a line makes a row.
        """
        d = lines.withColumnRenamed("value", INPUT)
        line = F.col(INPUT)
        names = [c.name for c in self.table.columns if needed is None or c.name in needed]
        deciding, proof = self._deciding()
        relevant = [c for c in self.table.columns if c.name in names or c in deciding]
        d, group, matched = self._prepare(d, line, relevant, proof)
        if any(c.path for c in relevant):
            d = worked_out_once(d, "_json", F.try_parse_json(line))
        columns = {c.name: self._column(c, group, matched) for c in relevant}
        strict = [columns[c.name].isNotNull() for c in deciding if c.not_null]
        if strict:
            d = d.where(reduce(and_, strict))
        elif proof is not None:
            d = d.where(matched(proof))
        else:
            d = d.where(reduce(or_, [columns[c.name].isNotNull() for c in deciding], F.lit(False)))
        # A column named like the line is hidden by it outside ``*``: the line travels under a name of its own.
        others = [c for c in d.columns if c not in (INPUT, "_json") and not c.startswith("_m_")]
        return d.select(*others, line.alias("_line"), *[columns[n].alias(n) for n in names])

    def _deciding(self) -> tuple[list[ColumnDef], Reference | None]:
        """The columns that decide whether a line makes a row; none, and a reference, if the match of its pattern is proof enough.

        It is if all columns are of one pattern, none has a default, and one of them has a value whenever the pattern matches.
        """
        all_of = self.table.columns
        strict = [c for c in all_of if c.not_null]
        if strict:
            return strict, None
        patterns = {r.pattern for c in all_of for r in c.references}
        if len(patterns) == 1 and all(c.references and c.default is None for c in all_of):
            p = self.table.pattern(next(iter(patterns)))
            groups = self.patterns[p.name].groups
            for c in all_of:
                g = c.references[0].group
                always = g <= 1 if p.split else c.type == BOOLEAN or g == 0 or g <= len(groups) and groups[g - 1].always
                if len(c.references) == 1 and c.type in (TEXT, BOOLEAN) and always:
                    return [], c.references[0]
        return list(all_of), None

    def _prepare(self, d: DataFrame, line: Column, relevant: list[ColumnDef], proof: Reference | None):
        """The lines with what their patterns find; how to get a group's text, NULL if it took no part; whether a pattern matched."""
        used: dict[str, set[int]] = {}
        for c in relevant:
            for r in c.references:
                used.setdefault(r.pattern, set()).add(r.group)
        if proof is not None:
            used.setdefault(proof.pattern, set())
        cells: dict[tuple[str, int], Column] = {}
        matches: dict[str, Column] = {}
        for k, p in enumerate(self.table.patterns):
            if p.name not in used or self.table.pattern(p.name) is not p:
                continue
            compiled, found = self.patterns[p.name], f"_m_{k}"
            java = FLAGS + compiled.java
            if p.split:
                if used[p.name] - {0}:
                    d = worked_out_once(d, found, F.split(line, java, -1))
                for g in used[p.name]:
                    cells[p.name, g] = line if g == 0 else F.get(F.col(found), F.lit(g - 1))
                matches[p.name] = line.isNotNull()
                continue
            groups = sorted(g for g in used[p.name] if 0 < g <= len(compiled.groups))
            if groups:
                # One more part than groups comes out if the pattern matches, else the line alone.
                single = F.array(*[F.regexp_extract(line, java, g) for g in groups], F.lit(""))
                packed = F.split(F.regexp_replace(line, rf"\A(?s:.*?)(?:{java})(?s:.*)\z", "".join(f"${g}{_SEPARATOR}" for g in groups)), _SEPARATOR, -1)
                d = worked_out_once(d, found, F.when(F.contains(line, F.lit(_SEPARATOR)), F.when(line.rlike(java), single)).otherwise(packed))
                matched = F.coalesce(F.size(found) == len(groups) + 1, F.lit(False))
                texts = {g: F.when(matched, F.get(F.col(found), F.lit(i))) for i, g in enumerate(groups)}
            else:
                matched, texts = line.rlike(java), {}
            if 0 in used[p.name]:
                texts[0] = F.when(matched, F.regexp_extract(line, java, 0))
            matches[p.name] = matched
            for g in used[p.name]:
                if g not in texts:
                    cells[p.name, g] = F.lit(None).cast("string")
                elif g == 0 or compiled.groups[g - 1].always:
                    cells[p.name, g] = texts[g]
                elif not compiled.groups[g - 1].empty:
                    cells[p.name, g] = F.when(texts[g] != "", texts[g])
                else:
                    cells[p.name, g] = F.when(matched & line.rlike(compiled.takes_part(g)), texts[g])
        return d, (lambda r: cells[r.pattern, r.group]), (lambda r: matches[r.pattern])

    def _column(self, c: ColumnDef, group, matched) -> Column:
        default = F.lit(c.default).cast(c.type.spark)
        if c.path:
            value = self._json(c, default)
        elif len(c.references) == 1:
            value = self._single(c.references[0], c.type, default, group, matched)
        elif c.type.element:
            nothing = F.lit(None).cast(c.type.element.spark)
            items = [self._single(r, c.type.element, nothing, group, matched) for r in c.references]
            value = F.when(reduce(or_, [i.isNotNull() for i in items]), F.array(*items)).otherwise(default)
        elif c.type == TIMESTAMP:
            value = self._timestamp(c, default, group)
        else:
            value = default
        return F.trim(value) if c.trim else value

    def _single(self, r: Reference, kind: SqlType, default: Column, group, matched) -> Column:
        text = group(r)
        if kind == BOOLEAN:
            return F.when(matched(r), text.isNotNull()).otherwise(default)
        return F.when(text.isNotNull(), parse_text(text, kind)).otherwise(default)

    def _timestamp(self, c: ColumnDef, default: Column, group) -> Column:
        texts = [group(r) for r in c.references[:7]]
        numbers = [parse_text(t, INT) for t in texts]
        parts = dict(zip(("year", "month", "day", "hour", "minute", "second", "fraction"), numbers))
        if "month" in parts:
            parts["month"] = F.coalesce(numbers[1], month_number(texts[1]), F.when(texts[1].isNull(), 1))
        filled = {n: parts.get(n, F.lit(v)) for n, v in (("year", 0), ("month", 1), ("day", 1), ("hour", 0), ("minute", 0), ("second", 0), ("fraction", 0))}
        micros = filled["fraction"] * (1 if c.microseconds else 1000)
        fits = filled["year"].between(0, 9999) & filled["month"].between(1, 12) & filled["day"].between(1, 31) & filled["hour"].between(0, 23) & filled["minute"].between(0, 59) & filled["second"].between(0, 59) & micros.between(0, 999999)
        i = {n: F.when(fits, v).cast("int") for n, v in filled.items()}
        seconds = (i["second"] + F.when(fits, micros) / F.lit(1000000).cast("decimal(9,0)")).cast("decimal(8,6)")
        made = F.try_make_timestamp(i["year"], i["month"], i["day"], i["hour"], i["minute"], seconds)
        # A part that is no number gives NULL, a date that doesn't exist the default.
        return F.when(reduce(or_, [p.isNull() for p in parts.values()]), F.lit(None).cast("timestamp")).otherwise(F.coalesce(made, default))

    def _json(self, c: ColumnDef, default: Column) -> Column:
        path = "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in c.path)
        found = F.try_variant_get(F.col("_json"), path, "variant")
        kind = F.schema_of_variant(found)
        if c.convert:
            value = F.when(kind == "STRING", parse_text(F.try_variant_get(found, "$", "string"), c.type))
        else:
            value = _typed(found, c.type)
        return F.when(found.isNotNull(), value).otherwise(default)


def _typed(value: Column, kind: SqlType) -> Column:
    """A JSON value of exactly this type: whole numbers for INT, any for REAL, strings for TEXT; arrays item by item; else NULL."""
    is_kind = F.schema_of_variant(value)
    if kind.element:
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.when(is_kind.startswith("ARRAY"), F.transform(items, lambda x: _typed(x, kind.element)))
    if kind == INT:
        return F.when(is_kind == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    if kind == REAL:
        return F.when(is_kind.isin("BIGINT", "DOUBLE", "FLOAT") | is_kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))
    if kind == TEXT:
        return F.when(is_kind == "STRING", F.try_variant_get(value, "$", "string"))
    if kind == BOOLEAN:
        return F.when(is_kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
    return F.lit(None).cast(kind.spark)
