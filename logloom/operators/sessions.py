"""Sessions of activity, separated by gaps of inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(df: DataFrame, user: str, instant_s: str, gap_s: int = 1800, bucket_s: int = 21600) -> DataFrame:
    """Group the rows of each user into sessions in which neighbours lie at most ``gap_s`` seconds apart.

    Gives (user, start_s, end_s, duration_s, n_events), one row for each session. Rows whose user or instant is NULL are in no
    session; an empty string is a user like any other; equal instants count once for the gaps and each for ``n_events``; an empty input
    gives no rows. Other columns are ignored, whatever their names.

    No task holds all rows of a user. Rows are first counted by (user, second), with map-side partial counts. A window over
    (user, bucket) sees at most ``bucket_s`` rows, one for each second. What it leaves for the window over a user are the sessions of
    its buckets: of these at most one for each ``gap_s`` seconds of the time covered and one for each bucket, however many rows there are.
    """
    if gap_s < 0 or bucket_s <= 0:
        raise ValueError("gap_s must not be negative and bucket_s must be positive")
    seconds = (
        df.select(F.col(user).alias("_u"), F.col(instant_s).cast("bigint").alias("_t"))
        .where(F.col("_u").isNotNull() & F.col("_t").isNotNull())
        .groupBy("_u", F.floor(F.col("_t") / bucket_s).alias("_b"), "_t")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    in_bucket = Window.partitionBy("_u", "_b").orderBy("_t")
    parts = (
        seconds.withColumn("_new", F.when(F.col("_t") - F.lag("_t").over(in_bucket) > gap_s, 1).otherwise(0))
        .withColumn("_s", F.sum("_new").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_u", "_b", "_s")
        .agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.sum("_n").alias("_n"))
    )
    of_user = Window.partitionBy("_u").orderBy("_from")
    return (
        parts.select("_u", "_from", "_to", "_n")
        .withColumn("_new", F.when(F.col("_from") - F.lag("_to").over(of_user) > gap_s, 1).otherwise(0))
        .withColumn("_s", F.sum("_new").over(of_user.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_u", "_s")
        .agg(F.min("_from").alias("start_s"), F.max("_to").alias("end_s"), F.sum("_n").alias("n_events"))
        .select(F.col("_u").alias(user), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "n_events")
    )
