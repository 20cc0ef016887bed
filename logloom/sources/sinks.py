"""Result rows as text: for people, as JSON lines, or delimited."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from logloom.functions.convert import display, json_value
from logloom.plans.errors import RunError
from logloom.plans.types import SqlType

FORMATS = ("text", "json", "csv")


class Printer:
    """Prints rows through ``println``. The header of ``csv`` comes once; its values are in display form, between semicolons."""

    def __init__(self, form: str = "text", println: Callable[[str], Any] = print, delimiter: str = ";"):
        if form not in FORMATS:
            raise RunError(f"the format must be one of {', '.join(FORMATS)}")
        self.form, self.println, self.delimiter, self.first = form, println, delimiter, True

    def row(self, names: Sequence[str], types: Sequence[SqlType], values: Sequence[Any]) -> None:
        if self.form == "json":
            self.println(json.dumps({n: json_value(v, t) for n, t, v in zip(names, types, values)}, ensure_ascii=False, separators=(",", ":")))
        elif self.form == "csv":
            if self.first:
                self.println(self.delimiter.join(names))
            self.println(self.delimiter.join(display(v, t) for t, v in zip(types, values)))
        elif list(names) == ["input"]:
            self.println(display(values[0], types[0]))
        else:
            self.println(", ".join(f"{n}: {display(v, t)}" for n, t, v in zip(names, types, values)))
        self.first = False

    def rows(self, names: Sequence[str], types: Sequence[SqlType], rows: Sequence[Sequence[Any]], single: bool = True) -> None:
        """All rows of a result; an empty line follows a group of several if the result is one of many."""
        for r in rows:
            self.row(names, types, r)
        if len(rows) > 1 and not single:
            self.println("")
