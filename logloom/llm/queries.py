"""Queries of the operators for training data, each over its whole tables, and their SQL for DuckDB."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.bpe import VOCABULARY, encode_texts
from logloom.llm.distinct import kmv_bounds, kmv_estimate, kmv_set_operations, kmv_sketches, merge_sketches
from logloom.llm.frequent import frequent_values
from logloom.llm.leakage import leaked_items
from logloom.llm.sentences import sentence_units
from logloom.llm.spark import cut_lineage
from logloom.operators.lines import host_key, once_per_line, read_table, usable_instant
from logloom.queries import USABLE_SQL

#: Hashes in a sketch, and standard errors of the bounds within which a group is decided by its estimate.
K, SIGMAS = 4096, 5.0


def _p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered usable lines: file, line number, address and day, as a number of days since 1970 (the session's zone has no part in it)."""
    rows = read_table(spark, sf_dir, "connections").select("file_id", "line_no", "ip", usable_instant().alias("at_s")).where("at_s IS NOT NULL")
    return rows.select("file_id", "line_no", "ip", F.floor(F.col("at_s") / 86400).cast("int").alias("day"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "log_files").select("file_id", "site")


def _with_site(rows: DataFrame, sites: DataFrame) -> DataFrame:
    return rows.join(sites, "file_id").withColumn("day", F.date_from_unix_date("day").cast("string"))


def _p4_groups(day: F.Column, site: F.Column) -> F.Column:
    """The groups of a line or of a day's sketch: the day at its site, the day at all sites, the month at its site."""
    pairs = [(day, site), (day, F.lit("all")), (F.substring(day, 1, 7), site)]
    return F.explode(F.array(*[F.struct(p.alias("period"), s.alias("site")) for p, s in pairs]))


def _p4_sketches(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """(period, site, n_rows, sketch): days of sites are sketched; the wider groups come from merging their sketches.

    A sketch doesn't care how often a line was delivered, so that rows are sketched where they are read. Only the number of lines needs each
    line once: file, line number and day are shuffled for it, no address.
    """
    rows, sites = _p4_rows(spark, sf_dir), _sites(spark, sf_dir)
    daily = kmv_sketches(_with_site(rows, sites), ["day", "site"], "ip", k).select("day", "site", F.lit(0).cast("bigint").alias("n_rows"), "sketch")
    counts = once_per_line(rows.select("file_id", "line_no", "day")).groupBy("file_id", "day").agg(F.count(F.lit(1)).alias("n_rows"))
    counted = _with_site(counts, sites).select("day", "site", "n_rows", F.array().cast("array<bigint>").alias("sketch"))
    both = daily.union(counted)
    wide = both.select(_p4_groups(F.col("day"), F.col("site")).alias("g"), F.pmod(F.xxhash64("day", "site"), F.lit(256)).alias("at"), "n_rows", "sketch")
    # A month has at most 31 days; a day at all sites, of which there may be many, is merged in two rounds.
    return merge_sketches(wide.select("g.*", "at", "n_rows", "sketch"), ["period", "site"], k, 16, 256)


#: So many groups left open by the bounds are broadcast to the exact count; more are joined by their keys.
MAX_BROADCAST_GROUPS = 100_000


def _dense_groups(spark: SparkSession, sf_dir: str, k: int = K, sigmas: float = SIGMAS) -> DataFrame:
    low, high = kmv_bounds(F.col("sketch"), k, sigmas)
    groups = _p4_sketches(spark, sf_dir, k).where("n_rows >= 20").select("period", "site", "n_rows", low.alias("low"), high.alias("high"))
    groups = cut_lineage(groups.where(F.col("high") * 2 >= F.col("n_rows")))
    sure, doubtful = groups.where(F.col("low") * 2 >= F.col("n_rows")), groups.where(F.col("low") * 2 < F.col("n_rows"))
    sure, n_open = sure.select("period", "site"), doubtful.count()
    if not n_open:
        return sure
    # What the bounds leave open is counted exactly: only the lines of these groups, their distinct addresses first.
    rows = _with_site(_p4_rows(spark, sf_dir), _sites(spark, sf_dir)).select("ip", _p4_groups(F.col("day"), F.col("site")).alias("g")).select("ip", "g.*")
    doubtful = doubtful.select("period", "site", "n_rows")
    pairs = rows.join(F.broadcast(doubtful) if n_open <= MAX_BROADCAST_GROUPS else doubtful, ["period", "site"])
    exact = pairs.distinct().groupBy("period", "site", "n_rows").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 2 >= F.col("n_rows"))
    return sure.union(exact.select("period", "site"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of at least 20 lines whose distinct addresses number at least half of them: decided by the bounds of their sketches, five
    standard errors away, or, where these leave it open, by an exact count."""
    return _dense_groups(spark, sf_dir)


def p4_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses of all groups, with bounds of three standard errors."""
    low, high = kmv_bounds(F.col("sketch"), K)
    return _p4_sketches(spark, sf_dir).select("period", "site", F.col("n_rows").alias("n_lines"), kmv_estimate(F.col("sketch"), K).alias("n_ips"), low.alias("low"), high.alias("high"))


def p4_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day of a site against the day before: addresses of either, of both and only of the later one, with bounds."""
    days = cut_lineage(_p4_sketches(spark, sf_dir).where("length(period) = 10")).select("site", F.to_date("period").alias("day"), "sketch")
    before = days.select("site", F.date_add("day", 1).alias("day"), F.col("sketch").alias("earlier"))
    ops = kmv_set_operations(F.col("sketch"), F.col("earlier"), K)
    return days.join(before, ["site", "day"]).select("site", F.date_format("day", "yyyy-MM-dd").alias("day"), *[c.alias(n) for n, c in ops.items()])


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def _p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "connections").select(host_key(F.col("hostname")).alias("hostname"), F.when(F.col("ip") != "", F.col("ip")).alias("ip"))
    return frequent_values(rows, ["hostname", "ip"], 0.01)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5(spark, sf_dir).select("field", "value")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5(spark, sf_dir).select("field", "value", "n_rows")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_documents(spark, sf_dir), "doc_id", "text", os.environ.get("LOGLOOM_VOCABULARY", VOCABULARY))


def _p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_documents(spark, sf_dir), read_table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir).select("item_id", "doc_id")


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which a document's tiles cover at least a half."""
    return _p8(spark, sf_dir).where("2 * covered >= n_words").select("item_id", "doc_id", "n_words", "n_tiles", "longest", "covered")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(_documents(spark, sf_dir), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_distinct, p4_days, p5_found, p5_counts, p7_ids, p8_found, p8_coverage, p9_found)}


_P4_SQL = f"""
WITH u AS (SELECT ip, site, strftime(make_timestamp(at_s * 1000000), '%Y-%m-%d') d FROM ({USABLE_SQL}) JOIN log_files USING (file_id)),
g AS (SELECT ip, d period, site FROM u UNION ALL SELECT ip, d, 'all' FROM u UNION ALL SELECT ip, substr(d, 1, 7), site FROM u)"""
_P5_SQL = """
WITH k AS (SELECT ip, CASE WHEN length(hostname) > 1 AND starts_with(hostname, '"') AND ends_with(hostname, '"') THEN substr(hostname, 2, length(hostname) - 2) ELSE hostname END h FROM connections),
v AS (SELECT 'hostname' field, nullif(regexp_replace(lower(h), '\\.$', ''), '') "value" FROM k UNION ALL SELECT 'ip', nullif(ip, '') FROM k),
c AS (SELECT field, "value", count(*)::BIGINT n_rows FROM v WHERE "value" IS NOT NULL GROUP BY field, "value" HAVING count(*) * 100 >= (SELECT count(*) FROM connections))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4_SQL + "\nSELECT period, site FROM g GROUP BY period, site HAVING count(*) >= 20 AND count(DISTINCT ip) * 2 >= count(*)",
        # These two hold as long as no group's sketch is full, which at the driver's size is so.
        "p4_distinct": _P4_SQL + "\nSELECT period, site, count(*)::BIGINT n_lines, count(DISTINCT ip)::DOUBLE n_ips, count(DISTINCT ip)::DOUBLE low, count(DISTINCT ip)::DOUBLE high FROM g GROUP BY period, site",
        "p4_days": _P4_SQL
        + """,
s AS (SELECT site, period::DATE d, list(DISTINCT ip) v FROM g WHERE length(period) = 10 GROUP BY ALL),
n AS (SELECT a.site, strftime(a.d, '%Y-%m-%d') AS "day", len(list_distinct(list_concat(a.v, b.v)))::DOUBLE u, len(list_intersect(a.v, b.v))::DOUBLE i, len(a.v)::DOUBLE m FROM s a JOIN s b ON a.site = b.site AND a.d = b.d + 1)
SELECT site, "day", u AS "union", u AS union_low, u AS union_high, i AS intersection, i AS intersection_low, i AS intersection_high, m - i AS difference, m - i AS difference_low, m - i AS difference_high FROM n""",
        "p5_found": _P5_SQL + '\nSELECT field, "value" FROM c',
        "p5_counts": _P5_SQL + '\nSELECT field, "value", n_rows FROM c',
    }
