"""How many tasks a DataFrame's rows come from, and how many rounds a tree over their states takes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_TASKS = re.compile(r"(?:hashpartitioning|rangepartitioning)\(.*?, (\d+)\)|RoundRobinPartitioning\((\d+)\)")


def task_count(df: DataFrame) -> int:
    """How many tasks the rows of ``df`` come from: its splits, or, after shuffles, the most tasks of one (of which fewer may be left).

    Nothing is run but what the plan broadcasts.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    shuffled = [int(a or b) for a, b in _TASKS.findall(plan)]
    return max(shuffled) if shuffled else max(1, df.rdd.getNumPartitions())


def tree_levels(leaves: int, fan_in: int) -> list[int]:
    """How many states there may be after each round: ``leaves`` first, then fewer by ``fan_in``, one at last."""
    if leaves < 1 or fan_in < 2:
        raise ValueError("leaves must be at least 1 and fan_in at least 2")
    levels = [leaves]
    while levels[-1] > 1:
        levels.append(-(-levels[-1] // fan_in))
    return levels
