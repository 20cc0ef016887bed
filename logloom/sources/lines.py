"""Lines of files or of Python iterables as a DataFrame with one string column, ``value``."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.lines import without_cr
from logloom.sources.shared import spool

#: Numbers the lines in the order of files and of their lines, where that order matters.
ORDER = "_order"


class ReadLinesIterator:
    """The lines of a file (or of several, in this order), read once."""

    def __init__(self, *paths: str):
        self.paths = list(paths)


class FollowFileIterator:
    """The lines of a growing file, from its beginning on."""

    def __init__(self, path: str):
        self.path = path


def read_lines(spark: SparkSession, paths: str | list[str], ordered: bool = False) -> DataFrame:
    """The lines of text files, each without its line feed and one carriage return before it. Files are split between tasks.

    With ``ordered``, the column ORDER sorts lines by (file in the order given, block of the file, line in the block).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.option("lineSep", "\n").text(paths)
    line = without_cr(F.col("value")).alias("value")
    if not ordered:
        return df.select(line)
    known = F.array(*[F.lit(os.path.abspath(p.removeprefix("file://"))) for p in paths])
    at = F.array_position(known, F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "^file:/*", "/"))
    return df.select(line, F.struct(at.alias("a"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias(ORDER))


def python_lines(spark: SparkSession, lines: Iterable[str], ordered: bool = False) -> DataFrame:
    """Lines of any Python iterable; a line feed at a line's end isn't part of it.

    Lists and tuples are in memory already and go to Spark as they are; what comes from any other iterable goes through a file, a block at a
    time, so that no more than that is held.
    """
    if not isinstance(lines, list | tuple):
        return read_lines(spark, spool(spark, lines), ordered)
    df = spark.createDataFrame([(x.removesuffix("\n").removesuffix("\r"),) for x in lines], "value string")
    return df.select("value", F.struct(F.monotonically_increasing_id().alias("i")).alias(ORDER)) if ordered else df
