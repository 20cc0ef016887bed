"""Statements over growing files: new rows as they come, or all groups anew after each micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.plans import tree
from logloom.plans.planner import plan
from logloom.sources.tail import follow_lines


def _first_of_each(df: DataFrame) -> DataFrame:
    """Equal rows once, in the order of the first of each."""
    names = [f"_p{i}" for i in range(len(df.columns))]
    kept = df.toDF(*names).withColumn("_i", F.monotonically_increasing_id()).groupBy(*names).agg(F.min("_i").alias("_i"))
    return kept.orderBy("_i").drop("_i").toDF(*df.columns)


def follow_query(tables: Any, query: tree.Select, path: str, on_rows: Callable[[list[str], list, list], Any], head: bool = False, interval: str = "200 milliseconds", checkpoint: str | None = None) -> StreamingQuery:
    """Follows ``path`` with a compiled statement; ``on_rows`` gets (names, types, rows) of each micro-batch that has any.

    A plain SELECT hands over new rows; an aggregate all groups as they then are, in order. DISTINCT keeps all rows seen as state, over groups it
    drops copies within each refresh. The query
    stops once LIMIT rows have been handed over (of an aggregate, over all refreshes), or ``on_rows`` returns False. With ``checkpoint``, a
    later run goes on where this one stopped. Joins are refused.
    """
    p = plan(query, tables._tables, follow_lines(tables.spark, query.path or path, head), streaming=True)
    left, done = [p.limit], [p.limit == 0]
    running: list[StreamingQuery] = []

    def batch(df: DataFrame, _: int) -> None:
        if done[0]:
            return
        if p.distinct:
            df = _first_of_each(df)
        rows = (df if left[0] is None else df.limit(left[0])).collect()
        if rows and on_rows(p.names, p.types, rows) is False:
            done[0] = True
        if left[0] is not None:
            left[0] -= len(rows)
            done[0] |= left[0] <= 0
        if done[0] and running:
            running[0].stop()

    writer = p.df.writeStream.outputMode("complete" if p.aggregate else "append").foreachBatch(batch).trigger(processingTime=interval)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    running.append(writer.start())
    return running[0]
