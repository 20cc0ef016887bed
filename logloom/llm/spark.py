"""What the operators need of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logloom.operators.tasks import tree_levels
from logloom.sources.shared import shared_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """A small intermediate table, written to the session's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def rounds_for(states: int, fan_in: int) -> int:
    """Rounds of merging by ``fan_in`` until one of ``states`` is left, at least one."""
    return max(1, len(tree_levels(states, fan_in)) - 1)
