"""Entries of mixed program logs: time, level, component and message, continuation lines attached.

A deterministic state machine runs over the characters of a line; it is built from header grammars by subset construction, a step at a time,
and notes where fields begin and end. Lines of named fields (JSON objects, ``key=value``) go on in a second machine that tokenises names, quotes
and brackets. The grammar that accepts assigns the fields. At the end of a line the machine of a file is in a lookahead state: the class of
the next line, whether the first machine accepts its beginning, decides whether the entry is at its end or the line is attached to it. The
lookahead runs over blocks of a file; what reaches over the edges of blocks (at most two rows each) is put in order over many blocks, and what
reaches over the edges of these (again two rows) over the whole file, so that no task needs to hold a file or all its blocks' edges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Level words, syslog severities, initials, months.
LEVELS = {
    "debug": "DEBUG", "trace": "DEBUG", "info": "INFO", "notice": "INFO", "warn": "WARN", "warning": "WARN", "error": "ERROR",
    "severe": "ERROR", "fatal": "FATAL", "crit": "FATAL", "panic": "FATAL",
}
SEVERITIES = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
INITIALS = {"D": "DEBUG", "T": "DEBUG", "I": "INFO", "N": "INFO", "W": "WARN", "E": "ERROR", "S": "ERROR", "F": "FATAL", "C": "FATAL", "P": "FATAL"}
MONTH_NAMES = {"Jan": "01", "Feb": "02", "Mar": "03", "Apr": "04", "May": "05", "Jun": "06", "Jul": "07", "Aug": "08", "Sep": "09", "Oct": "10", "Nov": "11", "Dec": "12"}
TIME_NAMES, LEVEL_NAMES = ("ts", "time", "timestamp", "@timestamp"), ("lvl", "level", "severity")
COMPONENT_NAMES, MESSAGE_NAMES = ("logger", "component", "name"), ("msg", "message")


class Chars:
    """A set of characters, perhaps given by those outside it."""

    def __init__(self, members: str, inside: bool = True):
        self.members, self.inside = frozenset(members), inside

    def __contains__(self, c: str) -> bool:
        return (c in self.members) is self.inside


_D, _A = Chars("0123456789"), Chars("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SP = Chars(" ")


Element = tuple[Chars, str, str]


def grammar(*parts) -> list[Element]:
    """Elements (characters, how often, mark) of a header, up to the first character of the message.

    A plain string stands for itself; ``"9:N"`` repeats digits N times; ``(characters, "1" | "?" | "*" | "+", mark)`` is an element, or a list of
    parts. A mark names the position at which its element is entered. What marks mean is the same in all grammars: ``year`` (four digits, at
    most one of the file's opening if absent), ``month`` (a name's three letters or two digits), ``day`` (two digits, the first perhaps a blank),
    ``clock`` (HH:MM:SS), ``zone`` (Z, or sign, hours and minutes), or ``epoch`` to ``epoch_end`` (seconds since 1970); ``level`` to ``level_end`` (a level
    word), ``initial`` (of one) or ``priority`` to ``priority_end`` (of syslog); ``name`` to ``name_end``, the component.
    """
    out: list[Element] = []
    for p in parts:
        if isinstance(p, list):
            out += grammar(*p)
        elif isinstance(p, str) and p[:2] == "9:":
            out += [(_D, "1", "")] * int(p[2:])
        elif isinstance(p, str):
            out += [(Chars(c), "1", "") for c in p]
        else:
            chars, times, mark = p
            chars = chars if isinstance(chars, Chars) else Chars(chars)
            out += [(chars, "1", mark), (chars, "*", "")] if times == "+" else [(chars, times, mark)]
    return out


def _digits(mark: str, n: int) -> list:
    return [(_D, "1", mark), *[(_D, "1", "")] * (n - 1)]


_CLOCK = [(_D, "1", "clock"), "9:1", ":", "9:2", ":", "9:2"]
_MONTH = [(_A, "1", "month"), (_A, "1", ""), (_A, "1", "")]
_DAY = [(Chars(" 0123456789"), "1", "day"), "9:1"]
_DATE = [*_digits("year", 4), "-", *_digits("month", 2), "-", *_digits("day", 2)]
_PROGRAM, _WORD = Chars(" []:", False), Chars(" ", False)
_PRIORITY = ["<", (_D, "1", "priority"), (_D, "?", ""), (_D, "?", ""), (">", "1", "priority_end")]
_LEVEL = (_A, "+", "level")


def _syslog(priority: bool, pid: bool) -> list[Element]:
    tail = [("[", "1", "name_end"), (_D, "+", ""), "]: "] if pid else [(":", "1", "name_end"), " "]
    return grammar(_PRIORITY if priority else [], _MONTH, " ", _DAY, " ", _CLOCK, " ", (_WORD, "+", ""), " ", (_PROGRAM, "+", "name"), tail)


#: layout -> the variants of its header.
GRAMMARS: dict[str, list[list[Element]]] = {
    "syslog": [_syslog(p, q) for p in (False, True) for q in (False, True)],
    "bracketed": [grammar("[", (_A, "1", ""), (_A, "1", ""), (_A, "1", ""), " ", _MONTH, " ", _DAY, " ", _CLOCK, " ", _digits("year", 4), "] [", _LEVEL, ("]", "1", "level_end"), " [", (Chars("]", False), "+", "name"), ("]", "1", "name_end"), " ")],
    "piped": [grammar(_digits("day", 2), "/", _digits("month", 2), "/", _digits("year", 4), " ", _CLOCK, "|", _LEVEL, ("|", "1", "level_end"), (Chars("|", False), "+", "name"), ("|", "1", "name_end"))],
    "epoch": [grammar((_D, "+", "epoch"), (".", "1", "epoch_end"), (_D, "+", ""), " ", _LEVEL, ("/", "1", "level_end"), (Chars(" :", False), "+", "name"), (":", "1", "name_end"), " ")],
    "initial": [grammar((Chars("".join(INITIALS)), "1", "initial"), _digits("month", 2), _digits("day", 2), " ", _CLOCK, ".", (_D, "+", ""), (_SP, "+", ""), (_D, "+", ""), " ", (Chars(" :", False), "+", "name"), (":", "1", "name_end"), (_D, "+", ""), "] ")],
    "dashed": [grammar(_DATE, " ", _CLOCK, f, " ", _LEVEL, (" ", "1", "level_end"), (_SP, "*", ""), (_WORD, "+", "name"), (" ", "1", "name_end"), "- ") for f in ([], [(Chars(",."), "1", ""), (_D, "+", "")])],
    "zoned": [
        grammar(_DATE, "T", _CLOCK, f, z, " ", _LEVEL, (" ", "1", "level_end"), (_SP, "*", ""), "[", (Chars("]", False), "+", "name"), ("]", "1", "name_end"), " ")
        for f in ([], [(Chars(",."), "1", ""), (_D, "+", "")])
        for z in ([("Z", "1", "zone")], [("+-", "1", "zone"), "9:2", ":", "9:2"], [("+-", "1", "zone"), "9:4"])
    ],
}


class HeaderMachine:
    """The grammars as one deterministic machine. ``run`` gives the layout, the marks and the length of a line's header, or None.

    A state is the set of (layout, variant, element) that may come next. Steps are worked out once for each state and character; all
    characters outside ASCII share one step. A line without complete header ends in a state without successors, mostly after few characters.
    """

    def __init__(self, grammars: Mapping[str, Sequence[Sequence[Element]]] = GRAMMARS):
        self._of = [(name, elements) for name, variants in grammars.items() for elements in variants]
        self._states: dict[frozenset, dict] = {}
        self._start = self._state(self._closed((v, 0) for v in range(len(self._of))))

    def _closed(self, positions) -> frozenset:
        todo, seen = list(positions), set()
        while todo:
            v, e = todo.pop()
            if (v, e) not in seen:
                seen.add((v, e))
                elements = self._of[v][1]
                if e < len(elements) and elements[e][1] in "?*":
                    todo.append((v, e + 1))
        return frozenset(seen)

    def _state(self, positions: frozenset) -> dict:
        if positions not in self._states:
            done = [v for v, e in positions if e == len(self._of[v][1])]
            self._states[positions] = {"": positions, "accepts": min(done) if done else None}
        return self._states[positions]

    def _step(self, state: dict, c: str):
        key = c if c < "\x80" else "\x80"
        if key in state:
            return state[key]
        to, marks = set(), set()
        for v, e in state[""]:
            elements = self._of[v][1]
            if e < len(elements) and key in elements[e][0]:
                to.add((v, e if elements[e][1] == "*" else e + 1))
                if elements[e][2]:
                    marks.add((v, elements[e][2]))
        state[key] = (self._state(self._closed(to)), tuple(marks)) if to else (None, ())
        return state[key]

    def run(self, line: str):
        state, trail = self._start, []
        for i, c in enumerate(line):
            step = state.get(c) or self._step(state, c)
            state = step[0]
            if state is None:
                return None
            if step[1]:
                trail.append((i, step[1]))
            if state["accepts"] is not None:
                return self._accepted(state, trail, i + 1)
        step = self._step(state, " ")  # a header whose message is empty may have lost its last blank
        if step[0] is not None and step[0]["accepts"] is not None:
            return self._accepted(step[0], trail, len(line))
        return None

    def _accepted(self, state: dict, trail: list, end: int) -> tuple[str, dict[str, int], int]:
        """The layout, the marks of the variant that accepts, and the header's length."""
        v = state["accepts"]
        return self._of[v][0], {mark: i for i, marks in trail for w, mark in marks if w == v}, end


def _quoted(line: str, at: int) -> int:
    """The position after the string that begins with the quote at ``at``, or -1."""
    i, n = at + 1, len(line)
    while i < n:
        c = line[i]
        if c == '"':
            return i + 1
        i += 2 if c == "\\" else 1
    return -1


def _decoded(text: str) -> str | None:
    if "\\" not in text:
        return text[1:-1]
    try:
        return json.loads(text, strict=False)
    except ValueError:
        return None


def scan_object(line: str) -> dict | None:
    """The top-level members of a JSON object that fills the line; values of strings decoded, of others as their text. None if it isn't one."""
    out, depth, i, n = {}, 0, 0, len(line)
    state, name, begin = "open", "", 0
    while i < n:
        c = line[i]
        if c in " \t\r\n" and state != "bare":
            i += 1
        elif state == "open":
            if c != "{":
                return None
            state, i = "name or end", i + 1
        elif state in ("name", "name or end") and c == '"':
            end = _quoted(line, i)
            if end < 0 or (name := _decoded(line[i:end])) is None:
                return None
            state, i = "colon", end
        elif state == "colon" and c == ":":
            state, i = "value", i + 1
        elif state == "value":
            if c == '"':
                end = _quoted(line, i)
                if end < 0 or (text := _decoded(line[i:end])) is None:
                    return None
                out[name], state, i = text, "comma or end", end
            elif c in "{[":
                state, begin, depth, i = "nested", i, 1, i + 1
            elif c in "}],:":
                return None
            else:
                state, begin = "bare", i
        elif state == "nested":
            if c == '"':
                i = _quoted(line, i)
                if i < 0:
                    return None
                continue
            depth += (c in "{[") - (c in "}]")
            i += 1
            if not depth:
                out[name], state = (line[begin:i],), "comma or end"
        elif state == "bare":
            if c in ",}]" or c in " \t\r\n":
                out[name], state = (line[begin:i],), "comma or end"
            else:
                i += 1
        elif state == "comma or end" and c == ",":
            state, i = "name", i + 1
        elif state in ("comma or end", "name or end") and c == "}":
            state, i = "end", i + 1
        else:
            return None
    return out if state == "end" else None


def scan_pairs(line: str) -> dict | None:
    """The fields of a line of ``name=value`` parted by blanks, values bare or quoted. None if anything else stands in it."""
    out, i, n = {}, 0, len(line)
    while i < n:
        if line[i] == " ":
            i += 1
            continue
        begin = i
        while i < n and line[i] not in '= "':
            i += 1
        if i == begin or i >= n or line[i] != "=":
            return None
        name, i = line[begin:i], i + 1
        if i < n and line[i] == '"':
            end = _quoted(line, i)
            if end < 0 or end < n and line[end] != " " or (text := _decoded(line[i:end])) is None:
                return None
            out[name], i = text, end
        else:
            begin = i
            while i < n and line[i] != " ":
                i += 1
            out[name] = line[begin:i]
    return out


def _named(line: str, members: dict | None) -> tuple[str, str, str, str] | None:
    first = lambda names: next((members[n] for n in names if n in members), None)
    if not members:
        return None
    at, name, message, level = first(TIME_NAMES), first(COMPONENT_NAMES), first(MESSAGE_NAMES), first(LEVEL_NAMES)
    if at is None or not isinstance(name, str) or not isinstance(message, str) or not (level is None or isinstance(level, str)):
        return None
    time = _stamp(at if isinstance(at, str) else at[0])
    if time is None or level and level.lower() not in LEVELS:
        return None
    return time, LEVELS[level.lower()] if level else "", name, message


def _stamp(text: str) -> str | None:
    """UTC time of a named field: an ISO instant, or seconds or milliseconds since 1970."""
    try:
        whole = text.partition(".")[0]
        if whole.isascii() and whole.isdigit():
            return _utc(whole[:-3]) if len(whole) >= 12 else _utc(whole)
        at = datetime.fromisoformat(text)
        return (at.astimezone(timezone.utc) if at.tzinfo else at).strftime("%Y-%m-%d %H:%M:%S")
    except (ValueError, OverflowError):
        return None


def _utc(seconds: str) -> str | None:
    try:
        return str(datetime(1970, 1, 1) + timedelta(seconds=int(seconds)))
    except (ValueError, OverflowError):
        return None


def _real(year: str, month: str, day: str, clock: str) -> str | None:
    """``YYYY-MM-DD HH:MM:SS``, without the year if that is empty; None if there is no such time."""
    day = day.replace(" ", "0")
    if not (clock[:2] < "24" and clock[3:5] < "60" and clock[6:8] < "60" and "01" <= month <= "12" and "01" <= day <= "31"):
        return None
    if day > "28":
        try:
            datetime(int(year or 2000), int(month), int(day))
        except ValueError:
            return None
    return f"{year}-{month}-{day} {clock}"


def _time(line: str, m: dict[str, int]) -> str | None:
    """The time that a header's marks give, without its year if they give none; None if there is no such time."""
    if "epoch" in m:
        return _utc(line[m["epoch"] : m["epoch_end"]])
    month = line[m["month"] : m["month"] + 2]
    if not month.isdigit():
        month = MONTH_NAMES.get(line[m["month"] : m["month"] + 3], "")
    at = _real(line[m["year"] : m["year"] + 4] if "year" in m else "", month, line[m["day"] : m["day"] + 2], line[m["clock"] : m["clock"] + 8])
    zone = line[m["zone"]] if "zone" in m else "Z"
    if at is None or zone == "Z":
        return at
    digits = line[m["zone"] + 1 : m["zone"] + 6].replace(":", "")
    shift = timedelta(hours=int(digits[:2]), minutes=int(digits[2:4]))
    try:
        return str(datetime.fromisoformat(at) - (shift if zone == "+" else -shift))
    except OverflowError:
        return None


def _level(line: str, m: dict[str, int]) -> str | None:
    """The level that a header's marks give, empty if none states one; None if there is no such level."""
    if "priority" in m:
        number = int(line[m["priority"] : m["priority_end"]])
        return SEVERITIES[number % 8] if number <= 191 else None
    if "initial" in m:
        return INITIALS.get(line[m["initial"]])
    return LEVELS.get(line[m["level"] : m["level_end"]].lower()) if "level" in m else ""


MACHINE = HeaderMachine()


def read_header(line: str, machine: HeaderMachine = MACHINE) -> tuple[str, str, str, str] | None:
    """(time, level, component, message) of a line with a complete header, else None. A time without year begins with ``-``."""
    c = line[:1]
    if c == "{":
        return _named(line, scan_object(line))
    found = machine.run(line)
    if found is None:
        return _named(line, scan_pairs(line)) if c.isalpha() or c == "@" else None
    _, m, end = found
    time, level = _time(line, m), _level(line, m)
    if time is None or level is None:
        return None
    return time, level, line[m["name"] : m["name_end"]], line[end:]


_MIX = np.uint64(0x9E3779B97F4A7C15)  # tells pairs apart, but for chance
_PARSED = "file_id bigint, line_no bigint, year string, head boolean, entry_time string, level string, component string, text string"
_SCHEMA = pa.schema([("file_id", pa.int64()), ("line_no", pa.int64()), ("year", pa.string()), ("head", pa.bool_()), *((c, pa.string()) for c in ("entry_time", "level", "component", "text"))])
_PARTS = "file_id bigint, block bigint, edge boolean, start bigint, first bigint, n_lines bigint, entry_time string, level string, component string, text string"
_PARTS_SCHEMA = pa.schema([("file_id", pa.int64()), ("block", pa.int64()), ("edge", pa.bool_()), *((c, pa.int64()) for c in ("start", "first", "n_lines")), *((c, pa.string()) for c in ("entry_time", "level", "component", "text"))])


def _parser(machine: HeaderMachine):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Copies of a line within a batch go before the shuffle: a line delivered very often leaves one row for each batch.
            files, numbers = (b.column(i).to_numpy().astype(np.uint64) for i in (0, 1))
            if len(np.unique(files * _MIX + numbers)) < b.num_rows:
                seen: set[tuple[int, int]] = set()
                b = b.filter(pa.array([k not in seen and not seen.add(k) for k in zip(files.tolist(), numbers.tolist())]))
            times, levels, names, texts = [], [], [], []
            for line in b.column(3).to_pylist():
                if line[-1:] == "\r":
                    line = line[:-1]
                time, level, name, text = read_header(line, machine) or (None, None, None, line)
                times.append(time)
                levels.append(level)
                names.append(name)
                texts.append(text)
            head = pa.array([n is not None for n in names], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), head, *(pa.array(x, pa.string()) for x in (times, levels, names, texts))], schema=_SCHEMA)

    return parse


def _attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order of (file, block, line number) to the parts of entries in each block: (whether it may go on beyond an edge of the
    block; start, NULL before the block's first header; the first line; lines; fields; text).

    In the lookahead state after a line, another block's line or one with a header ends the part, a copy of the line is passed over, and any
    other line is attached. Parts are cut from whole batches at once; what isn't at its end waits for the next batch.
    """
    waiting: list[pa.Table] = []

    def parts(t: pa.Table, following: tuple[int, int] | None) -> pa.RecordBatch:
        """The parts in whole ones; ``following`` is the file and block of the line after them."""
        t = t.combine_chunks()
        file, block, line, head = (t.column(c).to_numpy() for c in ("file_id", "block", "line_no", "head"))
        at = np.flatnonzero(_ends(file, block, head))
        ends = np.concatenate((at[1:], [len(file)]))
        text = t.column("text").chunk(0)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate((at, ends[-1:])), pa.int32()), text), "\n")
        firsts = pa.array(at)
        last_of_block = np.ones(len(at), dtype=bool)
        last_of_block[:-1] = (file[at[1:]] != file[at[:-1]]) | (block[at[1:]] != block[at[:-1]])
        last_of_block[-1] = following != (file[-1], block[-1])
        start = pa.array(line[at], pa.int64(), mask=~head[at])
        fields = [t.column(c).chunk(0).take(firsts) for c in ("entry_time", "level", "component")]
        return pa.RecordBatch.from_arrays([pa.array(file[at]), pa.array(block[at]), pa.array(last_of_block | ~head[at]), start, pa.array(line[at]), pa.array(ends - at), *fields, texts], schema=_PARTS_SCHEMA)

    last: tuple[int, int] | None = None
    for b in batches:
        file, line = b.column(0).to_numpy(), b.column(b.schema.get_field_index("line_no")).to_numpy()
        fresh = np.ones(b.num_rows, dtype=bool)
        fresh[1:] = (file[1:] != file[:-1]) | (line[1:] != line[:-1])
        if b.num_rows:
            fresh[0] = last != (file[0], line[0])
            last = (file[-1], line[-1])
        b = b.filter(pa.array(fresh))
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        file, block, head = (t.column(c).to_numpy() for c in ("file_id", "block", "head"))
        before = waiting[-1].slice(waiting[-1].num_rows - 1) if waiting else None
        ends = _ends(file, block, head)
        ends[0] = before is None or head[0] or (before.column("file_id")[0].as_py(), before.column("block")[0].as_py()) != (file[0], block[0])
        cuts = np.flatnonzero(ends)
        if len(cuts):
            done = [*waiting, t.slice(0, int(cuts[-1]))]
            if sum(x.num_rows for x in done):
                yield parts(pa.concat_tables(done), (file[cuts[-1]], block[cuts[-1]]))
            waiting = []
        waiting.append(t.slice(int(cuts[-1]) if len(cuts) else 0))
    if waiting:
        yield parts(pa.concat_tables(waiting), None)


def _ends(file: np.ndarray, block: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Where a part begins, and the one before it is at its end."""
    out = head.copy()
    out[0] = True
    out[1:] |= (file[1:] != file[:-1]) | (block[1:] != block[:-1])
    return out


def _year(df: DataFrame, opened_at: str) -> Column:
    """The year of an instant, whatever the session's zone."""
    at = F.col(opened_at)
    day = F.date_from_unix_date(F.floor(F.unix_seconds(at) / 86400).cast("int")) if df.select(opened_at).dtypes[0][1] == "timestamp" else at.cast("date")
    return F.lpad(F.year(day).cast("string"), 4, "0")


def log_entries(
    df: DataFrame, file_id: str = "file_id", line_no: str = "line_no", line: str = "line", opened_at: str = "opened_at", grammars: Mapping[str, Sequence[Sequence[Element]]] = GRAMMARS, block_lines: int = 65536, blocks_together: int = 1024
) -> DataFrame:
    """One row for each entry: (file_id, line_no, n_lines, entry_time, level, component, message).

    An entry starts at a line with a complete header of one of the ``grammars`` (see ``grammar``), or with named fields, and takes all lines of
    its file up to the next such line; lines before a file's first header belong to none. Lines may stand in any order and more than once:
    copies of a (file, line number) count once. Rows without file, line number or line are ignored; an empty line belongs to its entry as an
    empty line. A header without year takes that of ``opened_at``; if that is NULL, entry_time is NULL. An empty input gives no rows. Other
    columns are ignored, whatever their names.
    """
    source = df.select(F.col(file_id).cast("bigint").alias("file_id"), F.col(line_no).cast("bigint").alias("line_no"), _year(df, opened_at).alias("year"), F.col(line).alias("text"))
    parsed = source.where("file_id IS NOT NULL AND line_no IS NOT NULL AND text IS NOT NULL").mapInArrow(_parser(HeaderMachine(grammars)), _PARSED)
    time = F.when(F.col("entry_time").startswith("-"), F.concat("year", "entry_time")).otherwise(F.col("entry_time"))
    lines = parsed.select("file_id", F.floor(F.col("line_no") / block_lines).alias("block"), "line_no", "head", time.alias("entry_time"), "level", "component", "text")
    parts = lines.repartition("file_id", "block").sortWithinPartitions("file_id", "block", "line_no").mapInArrow(_attach, _PARTS)
    # What reaches over an edge of blocks meets its neighbours, first among many blocks, then, what reaches over the edges of these, in the whole
    # file; all other parts are whole entries and stay where they are. The branches read the same shuffled rows.
    whole = parts.where(~F.col("edge"))
    near = _joined(parts.where("edge").withColumn("_g", F.floor(F.col("block") / blocks_together)), "file_id", "_g")
    last = F.max("start").over(Window.partitionBy("file_id", "_g"))
    near = near.withColumn("edge", F.col("start").isNull() | (F.col("start") == last))
    far = _joined(near.where("edge"), "file_id").where(F.col("start").isNotNull())
    columns = [F.col("start").alias("line_no"), "n_lines", "entry_time", "level", "component", F.col("text").alias("message")]
    return whole.select("file_id", *columns).union(near.where(~F.col("edge")).select("file_id", *columns)).union(far.select("file_id", *columns))


def _joined(parts: DataFrame, *keys: str) -> DataFrame:
    """Parts of entries of each key, in order, united with the part before them that has a header; those before the first header with each other."""
    up_to = Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.withColumn("start", F.last("start", ignorenulls=True).over(up_to))
        .groupBy(*keys, "start")
        .agg(F.min("first").alias("first"), F.sum("n_lines").alias("n_lines"), *[F.max(c).alias(c) for c in ("entry_time", "level", "component")], F.array_sort(F.collect_list(F.struct("first", "text"))).alias("texts"))
        .withColumn("text", F.concat_ws("\n", F.transform("texts", lambda t: t["text"])))
        .drop("texts")
    )
