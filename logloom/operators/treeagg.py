"""Per-key results without one task behind the heaviest keys: aggregation along a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.tasks import task_count, tree_levels


def tree_count(df: DataFrame, key: str, item: str, n_rows: str = "n_rows", n_items: str = "n_items", fan_in: int = 16) -> DataFrame:
    """For each key its number of rows and of distinct items, both exact: (key, n_rows, n_items).

    The leaves are tasks: each combines its own chunk, whose size Spark fixes (``spark.sql.files.maxPartitionBytes`` for splits of files, the
    advisory partition size after a shuffle), to one count for each (key, item), so that a hot pair leaves one row for each chunk. These counts meet by
    (key, item), which spreads a hot key over all tasks. Each of these tasks then adds up what it has of a key to one state, (rows, distinct
    items), its items being no other's, and the states of ``fan_in`` neighbouring tasks are merged in rounds, as many as the logarithm of
    the number of tasks to the base ``fan_in``: no reducer ever receives more than ``fan_in`` states of a key.

    Rows with a NULL key are left out; NULL and empty items count as rows and not as items; an empty input gives no rows. Other columns
    are ignored, whatever their names.
    """
    pairs = df.select(F.col(key).alias("_k"), F.col(item).alias("_i")).where(F.col("_k").isNotNull()).groupBy("_k", "_i").agg(F.count(F.lit(1)).alias("_n"))
    is_item = F.col("_i").isNotNull() & (F.col("_i").cast("string") != "")
    states = pairs.select("_k", F.spark_partition_id().alias("_s"), "_n", F.when(is_item, 1).otherwise(0).cast("bigint").alias("_d"))
    for left in tree_levels(max(2, task_count(pairs)), fan_in)[1:]:
        keys = ["_k"] if left == 1 else ["_k", "_s"]
        states = states.withColumn("_s", F.floor(F.col("_s") / fan_in).cast("int")).groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_d").alias("_d"))
    return states.select(F.col("_k").alias(key), F.col("_n").alias(n_rows), F.col("_d").alias(n_items))
