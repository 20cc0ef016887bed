"""Where intermediate files go: the folder shared by all machines that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's folder. A local session that names none, as in tests, gets one of its own, removed at its end; on a cluster its absence is an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("the session must name a shared folder in spark.checkpoint.dir")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="logloom"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def lines_file(df: DataFrame, *order: str) -> str:
    """Writes a column of lines, ``value``, as a text file of many parts, in order if columns to sort by are given; its path."""
    path = f"{shared_folder(df.sparkSession)}/lines-{uuid4().hex}"
    (df.orderBy(*order) if order else df).select("value").where("value IS NOT NULL").write.option("lineSep", "\n").text(path)
    return path


def spool(spark: SparkSession, lines: Iterable[str], block_bytes: int = 1 << 20) -> str:
    """Writes the lines of an iterable to one text file, a block at a time, so that it may be longer than memory; its path."""
    jvm = spark._jvm
    path = f"{shared_folder(spark)}/spool-{uuid4().hex}.txt"
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    block = bytearray()
    try:
        for line in lines:
            block += line.removesuffix("\n").encode("utf-8", "surrogateescape") + b"\n"
            if len(block) >= block_bytes:
                out.write(block)
                block = bytearray()
        out.write(block)
    finally:
        out.close()
    return path
