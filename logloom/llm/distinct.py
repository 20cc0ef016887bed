"""Distinct counts from the k smallest hashes of each group (KMV): mergeable, with confidence bounds, and with set operations.

A sketch is a sorted array of at most ``k`` distinct 64-bit hashes, kept as signed integers. With fewer than k it holds every hash of its
group and all results are exact (but for collisions of 64-bit hashes); with k, u being the k-th as a fraction of the hash range, (k-1)/u
estimates the number, with a relative standard error of 1/sqrt(k-2).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.spark import rounds_for
from logloom.operators.tasks import task_count

#: A task's unsent sketches hold at most so many hashes; beyond, they are sent on as partial results and begun anew.
MAX_HELD = 4_000_000


class _Local:
    """The sketches and row counts of the groups in one task."""

    def __init__(self, k: int):
        self.k, self.held = k, 0
        self.sketches: dict[str, np.ndarray] = {}
        self.rows: dict[str, int] = {}

    def add(self, names: list[str], codes: np.ndarray, hashes: np.ndarray, valid: np.ndarray) -> None:
        for name, n in zip(names, np.bincount(codes, minlength=len(names)).tolist()):
            self.rows[name] = self.rows.get(name, 0) + n
        # Only hashes below a full sketch's largest can change it.
        most = np.array([s[-1] if (s := self.sketches.get(g)) is not None and len(s) == self.k else np.iinfo(np.int64).max for g in names], dtype=np.int64)
        keep = valid & (hashes <= most[codes])
        codes, hashes = codes[keep], hashes[keep]
        order = np.lexsort((hashes, codes))
        codes, hashes = codes[order], hashes[order]
        ends = np.searchsorted(codes, np.arange(len(names) + 1))
        for g, name in enumerate(names):
            new = hashes[ends[g] : ends[g + 1]]
            old = self.sketches.get(name)
            merged = np.unique(new if old is None else np.concatenate((old, new)))[: self.k]
            self.held += len(merged) - (0 if old is None else len(old))
            self.sketches[name] = merged

    def batch(self) -> pa.RecordBatch:
        names = list(self.sketches)
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([self.rows[g] for g in names], pa.int64()), pa.array([self.sketches[g] for g in names], pa.list_(pa.int64()))], names=["g", "n_rows", "sketch"]
        )
        self.__init__(self.k)
        return out


def kmv_sketches(df: DataFrame, groups: Sequence[str], item: str, k: int = 4096, fan_in: int = 16) -> DataFrame:
    """One row for each combination of ``groups`` (as strings): (groups..., n_rows, sketch).

    A NULL in a group column is a group of its own; NULL and empty items count as rows and aren't in the sketch; repeated rows count each
    for n_rows and once for the sketch; an empty input gives no rows. Each task keeps one sketch a group of its own rows, within MAX_HELD
    hashes, so that rows needn't be shuffled. The tasks' sketches of a group are merged by ``fan_in`` in as many rounds as there are tasks
    to merge.
    """
    if k < 16:
        raise ValueError("k must be at least 16")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, waiting, n = _Local(k), [], 0

        def take():
            t = pa.Table.from_batches(waiting).combine_chunks()
            d = t.column(0).chunk(0).dictionary_encode() if t.column(0).num_chunks else None
            if d is not None:
                h = t.column(1).chunk(0)
                state.add(d.dictionary.to_pylist(), d.indices.to_numpy(), h.fill_null(0).to_numpy(zero_copy_only=False), h.is_valid().to_numpy(zero_copy_only=False))

        for b in batches:
            waiting.append(b)
            n += b.num_rows
            if n >= 200_000:
                take()
                waiting, n = [], 0
                if state.held > MAX_HELD:
                    yield state.batch()
        if waiting:
            take()
        if state.sketches:
            yield state.batch()

    key = F.to_json(F.struct(*[F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)]))
    hashed = F.when(F.col(item).isNotNull() & (F.col(item).cast("string") != ""), F.xxhash64(F.col(item)))
    source = df.select(key.alias("g"), hashed.alias("h"))
    parts = source.mapInArrow(local, "g string, n_rows bigint, sketch array<bigint>").withColumn("at", F.spark_partition_id())
    parts = merge_sketches(parts, ["g"], k, fan_in, task_count(source))
    names = F.from_json("g", ", ".join(f"g{i} string" for i in range(len(groups))))
    return parts.select(*[names[f"g{i}"].alias(g) for i, g in enumerate(groups)], "n_rows", "sketch")


def united(sketches: Iterator[np.ndarray], k: int) -> np.ndarray:
    """The k smallest distinct hashes of all sketches; never more than two of them are held at once."""
    out = np.array([], dtype=np.int64)
    for s in sketches:
        out = np.unique(np.concatenate((out, s)))[:k]
    return out


def merge_sketches(parts: DataFrame, keys: Sequence[str], k: int, fan_in: int = 16, states: int = 1) -> DataFrame:
    """Unites the sketches of rows with equal ``keys`` (strings, NULL being a key) and adds up n_rows: (keys..., n_rows, sketch).

    ``at`` tells the partial states of a key apart by numbers below ``states``; neighbours are merged by ``fan_in`` in rounds. However many
    rows a group of a round has, they are read in batches and united as they come, cut to k each time.
    """
    schema = pa.schema([*((c, pa.string()) for c in keys), ("n_rows", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def sketches() -> Iterator[np.ndarray]:
            nonlocal n
            for b in batches:
                n += sum(x or 0 for x in b.column(b.schema.get_field_index("n_rows")).to_pylist())
                yield b.column(b.schema.get_field_index("sketch")).flatten().to_numpy()

        sketch = united(sketches(), k)
        yield pa.RecordBatch.from_arrays([*(pa.array([v.as_py()], pa.string()) for v in key[: len(keys)]), pa.array([n], pa.int64()), pa.array([sketch], pa.list_(pa.int64()))], schema=schema)

    def merge_slot(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merge(key, batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([key[-1].as_py()], pa.int64())], names=[*b.schema.names, "at"])

    columns = ", ".join(f"`{c}` string" for c in keys) + ", n_rows bigint, sketch array<bigint>"
    parts = parts.select(*[F.col(c).cast("string").alias(c) for c in keys], "n_rows", "sketch", F.col("at").cast("bigint").alias("at") if states > 1 else F.lit(0).cast("bigint").alias("at"))
    for _ in range(rounds_for(states, fan_in) - 1):
        parts = parts.withColumn("at", F.floor(F.col("at") / fan_in)).groupBy(*keys, "at").applyInArrow(merge_slot, columns + ", at bigint")
    return parts.drop("at").groupBy(*keys).applyInArrow(merge, columns)


def _fraction(hash_value: Column) -> Column:
    return (hash_value.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)


def kmv_estimate(sketch: Column, k: int) -> Column:
    """The estimated number of distinct items; exact while the sketch isn't full."""
    u = _fraction(F.try_element_at(sketch, F.lit(k)))
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / u)


def kmv_bounds(sketch: Column, k: int, sigmas: float = 3.0) -> tuple[Column, Column]:
    """Lower and upper bound of the number, ``sigmas`` standard errors away; both exact while the sketch isn't full."""
    error = sigmas / (k - 2) ** 0.5
    n, full = kmv_estimate(sketch, k), F.size(sketch) >= k
    return F.when(full, F.greatest(F.lit(float(k)), n / (1 + error))).otherwise(n), F.when(full, n / (1 - error)).otherwise(n)


def kmv_set_operations(a: Column, b: Column, k: int, sigmas: float = 3.0) -> dict[str, Column]:
    """Estimates of |A or B|, |A and B|, |A without B| with bounds: columns union, intersection, difference, each also with _low and _high.

    The k smallest hashes of the union of two sets are the k smallest of their sketches' union; the share of them that is in both sets (in A
    alone) is that of the whole union. Its bounds are those of a share of k draws (Wilson), times those of the union's size.
    """
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    n = kmv_estimate(union, k)
    low, high = kmv_bounds(union, k, sigmas)
    drawn = F.greatest(F.size(union), F.lit(1)).cast("double")
    out = {"union": n, "union_low": low, "union_high": high}
    for name, part in (("intersection", F.array_intersect(F.array_intersect(union, a), b)), ("difference", F.array_except(F.array_intersect(union, a), b))):
        share, z2 = F.size(part) / drawn, sigmas**2
        middle, spread = (share + z2 / (2 * drawn)) / (1 + z2 / drawn), sigmas * F.sqrt(share * (1 - share) / drawn + z2 / (4 * drawn * drawn)) / (1 + z2 / drawn)
        exact = F.size(union) < k
        number = F.size(part).cast("double")
        out[name] = F.when(exact, number).otherwise(share * n)
        out[f"{name}_low"] = F.when(exact, number).otherwise(F.greatest(F.lit(0.0), middle - spread) * low)
        out[f"{name}_high"] = F.when(exact, number).otherwise((middle + spread) * high)
    return out
