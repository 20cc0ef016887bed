"""Most frequent values of columns within bounded memory: Space-Saving summaries, merged along a tree, then an exact count of the survivors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.spark import rounds_for
from logloom.operators.tasks import task_count

_SUMMARY = "field string, slot bigint, total bigint, missed bigint, items array<string>, counts array<bigint>, errors array<bigint>"
_SCHEMA = pa.schema([("field", pa.string()), ("slot", pa.int64()), ("total", pa.int64()), ("missed", pa.int64()), ("items", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("errors", pa.list_(pa.int64()))])


class SpaceSaving:
    """At most ``size`` values with counts that are never too low, and by at most ``errors`` too high; any other value has at most ``missed``.

    Values arrive with counts, in blocks: while fewer than ``4 * size`` are held, a new value starts at ``missed``, as it may have been let
    go; beyond, only the ``size`` highest stay, and ``missed`` becomes the highest count let go. The counts held never sum to more than all
    rows seen (each of the values let go takes with it at least what a new one was given), so ``missed`` is at most rows / size.
    """

    def __init__(self, size: int):
        self.size, self.total, self.missed = size, 0, 0
        self.counts: dict[str, int] = {}
        self.errors: dict[str, int] = {}

    def add(self, values: list[str], counts: list[int]) -> None:
        held, errors = self.counts, self.errors
        for v, n in zip(values, counts):
            if v in held:
                held[v] += n
            else:
                if len(held) >= 4 * self.size:
                    self.trim()
                    held, errors = self.counts, self.errors
                held[v], errors[v] = n + self.missed, self.missed

    def trim(self) -> None:
        if len(self.counts) > self.size:
            order = sorted(self.counts, key=lambda v: (-self.counts[v], v))
            self.missed = max(self.missed, self.counts[order[self.size]])
            self.errors = {v: self.errors[v] for v in order[: self.size]}
            self.counts = {v: self.counts[v] for v in order[: self.size]}

    def merge(self, total: int, missed: int, items: list[str], counts: list[int], errors: list[int]) -> None:
        """With another summary: a value that one doesn't hold may have had as much as that one missed."""
        there = dict(zip(items, zip(counts, errors)))
        for v in self.counts:
            n, e = there.pop(v, (missed, missed))
            self.counts[v] += n
            self.errors[v] += e
        for v, (n, e) in there.items():
            self.counts[v], self.errors[v] = n + self.missed, e + self.missed
        self.total += total
        self.missed += missed
        self.trim()

    def row(self, field: str, slot: int) -> pa.RecordBatch:
        self.trim()
        v = list(self.counts)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((field, slot, self.total, self.missed, v, [self.counts[x] for x in v], [self.errors[x] for x in v]), _SCHEMA.types)], schema=_SCHEMA)


def frequent_summaries(df: DataFrame, fields: list[str], size: int = 4096, fan_in: int = 16) -> DataFrame:
    """One summary row for each field: (field, total, missed, items, counts, errors).

    ``total`` counts all rows, with NULL or not; NULL values are in no summary; an empty string is a value. An empty input gives no rows.
    A task holds at most 4 * size values of each field. Summaries of neighbouring tasks are merged by ``fan_in``, in as many rounds as
    the number of tasks takes, one at a time as they are read.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [SpaceSaving(size) for _ in fields]
        for b in batches:
            for i, s in enumerate(states):
                s.total += b.num_rows
                found = pc.value_counts(b.column(i).drop_null())
                s.add(found.field(0).to_pylist(), found.field(1).to_pylist())
        for f, s in zip(fields, states):
            if s.total:
                yield s.row(f, TaskContext.get().partitionId())

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = SpaceSaving(size)
        for b in batches:
            for r in range(b.num_rows):
                state.merge(**b.slice(r, 1).select(["total", "missed", "items", "counts", "errors"]).to_pylist()[0])
        yield state.row(key[0].as_py(), key[1].as_py())

    source = df.select(*[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    parts = source.mapInArrow(local, _SUMMARY)
    rounds = rounds_for(task_count(source), fan_in)
    for r in range(1, rounds + 1):
        slot = F.floor(F.col("slot") / fan_in) if r < rounds else F.lit(0).cast("bigint")
        parts = parts.withColumn("slot", slot).groupBy("field", "slot").applyInArrow(merged, _SUMMARY)
    return parts.drop("slot")


def frequent_values(df: DataFrame, fields: list[str], share: float = 0.01, size: int = 4096, fan_in: int = 16) -> DataFrame:
    """The values that hold at least ``share`` of all rows, each field for itself: (field, value, n_rows, estimate, error, total).

    ``n_rows`` is exact; the true count lies within [estimate - error, estimate]. All values with so large a share come out: what a summary
    misses has at most total / size rows, so ``size`` must exceed 1 / share. At most 1 / (share - 1 / size) values of a field survive the
    first pass, however large the data; only these are broadcast for the second. NULLs are no value but count in the total.
    """
    if not 0 < share <= 1 or size <= 2 / share:
        raise ValueError("size must be more than 2 / share")
    summaries = frequent_summaries(df, fields, size, fan_in)
    survivors = (
        summaries.select("field", "total", F.explode(F.arrays_zip("items", "counts", "errors")).alias("x"))
        .where(F.col("x.counts") >= F.col("total") * share)
        .select("field", F.col("x.items").alias("value"), F.col("x.counts").alias("estimate"), F.col("x.errors").alias("error"), "total")
    )
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")).select("p.*")
    exact = pairs.join(F.broadcast(survivors), ["field", "value"]).groupBy("field", "value", "estimate", "error", "total").agg(F.count(F.lit(1)).alias("n_rows"))
    return exact.where(F.col("n_rows") >= F.col("total") * share).select("field", "value", "n_rows", "estimate", "error", "total")
