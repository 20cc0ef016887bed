"""What can go wrong with a statement, from its text to its run."""

from __future__ import annotations


class LoomError(Exception):
    """Base of all errors of the SQL layer."""


class StatementError(LoomError):
    """The text can't be read; carries line and column (from 1) and shows what stands there."""

    def __init__(self, message: str, text: str = "", at: int = 0):
        self.line, self.column = text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1
        near = text[at : at + 30].split("\n")[0]
        super().__init__(f"{message} at line {self.line}, column {self.column}" + (f", near: {near}" if near else ""))


class BindError(LoomError):
    """A name, type or function that doesn't fit the tables."""


class PatternError(LoomError):
    """A table's pattern that isn't supported."""


class RunError(LoomError):
    """A statement that can't run in the way asked for."""
