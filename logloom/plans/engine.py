"""The embedding interface: tables, statements compiled once, batch and followed runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any
from uuid import uuid4

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.plans import tree
from logloom.plans.errors import BindError, RunError
from logloom.plans.grammar import parse
from logloom.plans.planner import Plan, needs_order, plan
from logloom.sources.extract import Extractor
from logloom.sources.lines import FollowFileIterator, ReadLinesIterator, python_lines, read_lines

Lines = ReadLinesIterator | FollowFileIterator | DataFrame | Iterable[str]


@dataclass
class Statistics:
    seconds: float
    lines: int
    megabytes: float

    def __str__(self) -> str:
        return f"read {self.lines} lines ({self.megabytes:.2f} MB) in {self.seconds:.2f} s"


class Table:
    """A defined table, as seen from outside."""

    def __init__(self, definition: tree.TableDef):
        self.definition = definition

    def name(self) -> str:
        return self.definition.name

    def columns(self) -> dict[str, str]:
        return {c.name: str(c.type) for c in self.definition.columns}


def compile_query(text: str) -> tree.Select:
    """A SELECT that can be run many times."""
    s = parse(text)
    if not isinstance(s, tree.Select):
        raise BindError("expected a SELECT")
    return s


class Tables:
    """Table definitions and the statements that run over them."""

    def __init__(self, spark: SparkSession | None = None):
        self._spark, self._tables = spark, {}

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        return self._spark

    # Definitions

    def add_table(self, text: str) -> None:
        """Adds the tables of one or several CREATE TABLE; the last definition of a name counts."""
        parsed = parse(text)
        if isinstance(parsed, tree.Select):
            raise BindError("expected CREATE TABLE")
        for t in (parsed,) if isinstance(parsed, tree.TableDef) else parsed:
            Extractor(t)
            self._tables.pop(t.name, None)
            self._tables[t.name] = t

    def tables(self) -> list[Table]:
        return [Table(t) for t in self._tables.values()]

    def table_names(self) -> list[str]:
        return list(self._tables)

    def get_table(self, name: str) -> Table | None:
        return Table(self._tables[name]) if name in self._tables else None

    def describe(self, name: str) -> DataFrame:
        """Column, Type, Nullable and Default of a table's columns."""
        if name not in self._tables:
            raise BindError(f"there is no table {name}")
        rows = [(c.name, str(c.type), not c.not_null, None if c.default is None else str(c.default)) for c in self._tables[name].columns]
        return self.spark.createDataFrame(rows, "Column string, Type string, Nullable boolean, Default string")

    def preview(self, name: str, source: str | DataFrame, n: int = 1000) -> DataFrame:
        """What the definition makes of the first ``n`` lines of a file (or of lines already read), beside the lines."""
        lines = (read_lines(self.spark, source) if isinstance(source, str) else source).limit(n)
        return Extractor(self._tables[name]).rows(lines).withColumnRenamed("_line", "input")

    # Batch

    def plan(self, lines: Lines | None, query: str | tree.Select) -> Plan:
        s = compile_query(query) if isinstance(query, str) else query
        ordered = needs_order(s)
        if s.path is not None:
            source = read_lines(self.spark, s.path, ordered)
        elif isinstance(lines, DataFrame):
            source = lines
            if ordered and "_order" not in source.columns:
                source = source.withColumn("_order", F.struct(F.monotonically_increasing_id().alias("i")))
        elif isinstance(lines, ReadLinesIterator):
            source = read_lines(self.spark, lines.paths, ordered)
        elif isinstance(lines, FollowFileIterator):
            raise RunError("a followed file needs a callback")
        elif lines is None:
            raise RunError("there is nothing to read")
        else:
            source = python_lines(self.spark, lines, ordered)
        return plan(s, self._tables, source, lambda path: read_lines(self.spark, path))

    def sql(self, query: str | tree.Select, lines: Lines | None = None) -> DataFrame:
        """The result as a DataFrame, nothing run yet."""
        return self.plan(lines, query).df

    def execute_query(self, lines: Lines | None, query: str | tree.Select) -> list[dict[str, Any]]:
        """The result as dicts."""
        p = self.plan(lines, query)
        return [dict(zip(p.names, r)) for r in p.df.collect()]

    def execute_compiled_query(self, lines: Lines | None, query: tree.Select) -> list[dict[str, Any]]:
        return self.execute_query(lines, query)

    def execute_query_callback(self, lines: Lines | None, query: str | tree.Select, callback: Callable[[list[dict[str, Any]]], Any], batch: int = 1000, **follow: Any) -> None:
        """Hands the result to ``callback`` in lists of dicts until it returns False; a followed file is followed until then."""
        s = compile_query(query) if isinstance(query, str) else query
        if isinstance(lines, FollowFileIterator):
            from logloom.streaming.follow import follow_query

            follow_query(self, s, lines.path, lambda names, types, rows: callback([dict(zip(names, r)) for r in rows]), **{"head": True, **follow}).awaitTermination()
            return
        p = self.plan(lines, s)
        if p.aggregate:
            callback([dict(zip(p.names, r)) for r in p.df.collect()])
            return
        for rows in _batches(p.df.toLocalIterator(prefetchPartitions=True), batch):
            if callback([dict(zip(p.names, r)) for r in rows]) is False:
                return

    def execute_compiled_query_callback(self, lines: Lines | None, query: tree.Select, callback: Callable[[list[dict[str, Any]]], Any], **more: Any) -> None:
        self.execute_query_callback(lines, query, callback, **more)

    def run_with_statistics(self, paths: list[str], query: str | tree.Select) -> tuple[Plan, Iterator, Statistics]:
        """Runs a statement over files: its plan, its rows as they come, and what was read for them, complete once all rows are taken.

        With a LIMIT less may be read than the files hold; a joined file counts, too.
        """
        s = compile_query(query) if isinstance(query, str) else query
        p = plan(s, self._tables, read_lines(self.spark, s.path or paths, needs_order(s)), lambda path: read_lines(self.spark, path))
        statistics = Statistics(0.0, 0, 0.0)

        def rows() -> Iterator:
            context, group, began = self.spark.sparkContext, uuid4().hex, time.time()
            context.setJobGroup(group, "statement with statistics")
            try:
                yield from p.df.toLocalIterator()
            finally:
                statistics.seconds = time.time() - began
                statistics.lines, read = _read_by(context, group)
                statistics.megabytes = read / 1e6
                context.setLocalProperty("spark.jobGroup.id", None)

        return p, rows(), statistics


def _read_by(context: SparkContext, group: str) -> tuple[int, int]:
    """Lines and bytes that the tasks of a job group have read from files, by Spark's own metrics."""
    sc, tracker = context._jsc.sc(), context.statusTracker()
    sc.listenerBus().waitUntilEmpty()
    infos = [i for i in map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)) if i is not None]
    lines = read = 0
    for stage in sorted({s for i in infos for s in i.stageIds}):
        if tracker.getStageInfo(stage) is not None:
            data = sc.statusStore().lastStageAttempt(stage)
            lines, read = lines + data.inputRecords(), read + data.inputBytes()
    return lines, read


def _batches(rows: Iterator, size: int) -> Iterator[list]:
    part: list = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
