"""Patterns of table definitions as Java patterns, and what can be known of their groups beforehand.

The definitions' flavour has no look-around and no back references, Unicode classes, a dot that excludes only the line feed, and named groups
as ``(?P<name>...)``. A group may be absent from a match, which is not the same as an empty group; for each group it is worked out whether
it takes part in every match and whether it can match nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from logloom.plans.errors import PatternError

#: Classes of Unicode letters and the like, and a dot that excludes only the line feed.
FLAGS = "(?dU)"


@dataclass
class Group:
    start: int  # place of its parenthesis in the Java pattern
    end: int
    always: bool  # it takes part in every match
    empty: bool  # it can match the empty string


@dataclass
class Pattern:
    java: str
    groups: list[Group]

    def takes_part(self, k: int) -> str:
        """A pattern that a value matches if and only if group ``k`` takes part in the value's first match."""
        g = self.groups[k - 1]
        marked = f"{self.java[: g.end]}(?<logloomg>){self.java[g.end :]}"
        return rf"\A(?>(?s:.*?)(?:{FLAGS}{marked}))\k<logloomg>"


class _Scanner:
    def __init__(self, source: str):
        self.s, self.i, self.out, self.groups = source, 0, [], []

    def fail(self, what: str) -> PatternError:
        return PatternError(f"{what} in the pattern {self.s!r}")

    def put(self, text: str) -> None:
        self.out.append(text)

    @property
    def length(self) -> int:
        return sum(map(len, self.out))

    def alternatives(self, always: bool) -> bool:
        """Reads to a closing parenthesis or the end; tells whether it can match nothing."""
        first, begins = len(self.groups), True
        empty, branches = False, 0
        while begins:
            nothing = self.sequence(always)
            empty |= nothing
            branches += 1
            begins = self.i < len(self.s) and self.s[self.i] == "|"
            if begins:
                self.put("|")
                self.i += 1
        if branches > 1:
            for g in self.groups[first:]:
                g.always = False
        return empty

    def sequence(self, always: bool) -> bool:
        empty = True
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            first = len(self.groups)
            nothing = self.atom(always)
            low = self.quantifier()
            if low == 0:
                for g in self.groups[first:]:
                    g.always = False
                nothing = True
            empty &= nothing
        return empty

    def quantifier(self) -> int:
        m = re.compile(r"([*+?]|\{(\d+)(?:,\d*)?\})\??").match(self.s, self.i)
        if m is None:
            return 1
        self.put(m[0])
        self.i = m.end()
        return {"*": 0, "?": 0, "+": 1}[m[1]] if m[2] is None else int(m[2])

    def atom(self, always: bool) -> bool:
        c = self.s[self.i]
        if c == "(":
            return self.group(always)
        if c == "[":
            self.char_class()
            return False
        if c == "\\":
            return self.escape()
        self.i += 1
        self.put(c)
        return c in "^$"

    def escape(self) -> bool:
        m = re.compile(r"\\(x\{[0-9A-Fa-f]+\}|[pP]\{[^}]*\}|[pP][A-Za-z]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|.)", re.S).match(self.s, self.i)
        if m is None:
            raise self.fail("a lone backslash")
        self.i = m.end()
        if m[1][0].isdigit() or m[1][0] == "k":
            raise self.fail("a back reference")
        self.put(m[0])
        return m[1] in ("b", "B", "A", "z", "Z")

    def char_class(self) -> None:
        begin, depth = self.i, 0
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\":
                self.i += 1
            elif c == "[":
                depth += 1
                if self.s[self.i + 1 : self.i + 2] == "^":
                    self.i += 1
                if self.s[self.i + 1 : self.i + 2] == "]":
                    self.i += 1
            elif c == "]":
                depth -= 1
                if not depth:
                    break
            elif self.s[self.i : self.i + 2] in ("--", "~~"):
                raise self.fail("class arithmetic")
            self.i += 1
        else:
            raise self.fail("an open class")
        self.i += 1
        text = self.s[begin : self.i]
        # A closing bracket right after the opening stands for itself.
        self.put(re.sub(r"^(\[\^?)\]", r"\1\\]", text))

    def group(self, always: bool) -> bool:
        begin = self.length
        m = re.compile(r"\((?:\?(?:P?<([A-Za-z_]\w*)>|([a-zA-Z-]*):|([a-zA-Z-]+)\)|(<?[=!])))?").match(self.s, self.i)
        if m is None or m[0] == "(" and self.s[self.i + 1 : self.i + 2] == "?" or m[4]:
            raise self.fail("look-around or an unknown group")
        flags = m[2] or m[3] or ""
        if set(flags) - set("imsx-"):
            raise self.fail(f"the flags {flags!r}")
        self.i = m.end()
        if m[3]:
            self.put(m[0])
            return True
        captures = m[0] == "(" or m[1]
        own = None
        if captures:
            own = Group(begin, 0, always, False)
            self.groups.append(own)
            self.put("(")
        else:
            self.put(m[0])
        empty = self.alternatives(always)
        if self.i >= len(self.s):
            raise self.fail("an open group")
        if own:
            own.end, own.empty = self.length, empty
        self.put(")")
        self.i += 1
        return empty


def compile_pattern(source: str) -> Pattern:
    scan = _Scanner(source)
    scan.alternatives(True)
    if scan.i < len(source):
        raise scan.fail("a closing parenthesis too many")
    return Pattern("".join(scan.out), scan.groups)
