"""A streaming source that follows a growing text file.

One reader reads from the last byte it has seen to the last line feed there is; what comes after is a line still being written and waits.
A file that has become shorter, or whose beginning is another than before, is read from its beginning. Bytes that are no UTF-8 become replacement characters. A file has one writer, so
one reader is enough; what is made of the lines is spread over the cluster.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from logloom.operators.lines import without_cr
from logloom.sources.lines import ORDER

NAME = "logloom_tail"
MAX_BYTES = 64 << 20
#: By so many of its first bytes a file is known again.
KNOWN_BYTES = 256


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, head: bool):
        self.path, self.head = path, head

    def initialOffset(self) -> dict:
        at = 0 if self.head or not os.path.exists(self.path) else os.path.getsize(self.path)
        return self._offset(at, at)

    def _offset(self, begin: int, at: int) -> dict:
        """Up to where the file has been read, from where on this time, and what it begins with."""
        return {"at": at, "from": begin, "seen": self._seen(at)}

    def _seen(self, at: int) -> int:
        if not os.path.exists(self.path):
            return 0
        with open(self.path, "rb") as f:
            return zlib.crc32(f.read(min(at, KNOWN_BYTES)))

    def _lines(self, begin: int, end: int | None) -> tuple[list[tuple[str, int]], int]:
        if not os.path.exists(self.path):
            return [], begin
        size = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            f.seek(begin)
            data = f.read((size if end is None else end) - begin if end is not None else min(size - begin, MAX_BYTES))
            while end is None and b"\n" not in data and (more := f.read(MAX_BYTES)):
                data += more
        data = data[: data.rfind(b"\n") + 1]
        out, at = [], begin
        for line in data.split(b"\n")[:-1]:
            out.append((line.decode("utf-8", "replace"), at))
            at += len(line) + 1
        return out, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        begin = start["at"]
        if os.path.exists(self.path) and (os.path.getsize(self.path) < begin or self._seen(begin) != start["seen"]):
            begin = 0
        rows, at = self._lines(begin, None)
        return iter(rows), self._offset(begin, at)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._lines(end["from"] if end["from"] != start["at"] and end["from"] == 0 else start["at"], end["at"])[0])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string, at bigint"

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("head", "false") == "true")


def follow_lines(spark: SparkSession, path: str, head: bool = False) -> DataFrame:
    """The lines that a file gains, as a streaming DataFrame; with ``head``, those it has already come first."""
    spark.dataSource.register(TailSource)
    df = spark.readStream.format(NAME).option("path", os.path.abspath(path)).option("head", str(head).lower()).load()
    return df.select(without_cr(F.col("value")).alias("value"), F.struct("at").alias(ORDER))
