"""Row-level rules shared by the operators over delivered log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The month names that the extraction of timestamps accepts.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "june": 6, "july": 7, "sept": 9,
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_number(month: Column) -> Column:
    """1-12 of a month's name in any case; NULL for anything else."""
    names, numbers = F.array(*map(F.lit, MONTHS)), F.array(*[F.lit(n).cast("bigint") for n in (None, *MONTHS.values())])
    return F.get(numbers, F.array_position(names, F.lower(month)).cast("int"))


def instant_seconds(year: Column, month_name: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since 1970 UTC of date and time columns, whatever the session's zone; NULL unless all are present and form a real instant."""
    month = month_number(month_name).cast("int")
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.get(F.array(*map(F.lit, (0, 31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))), month)
    fits = year.between(1000, 9999) & day.between(1, 31) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    real = fits & (day <= last) & ((day < 29) | (month != 2) | leap)
    days = F.unix_date(F.make_date(year.cast("int"), month, F.lit(1))) + day - 1
    return F.when(real, days * 86400 + hour * 3600 + minute * 60 + second)


def usable_instant(prefix: str = "") -> Column:
    """The instant of a connections row, NULL where the row isn't usable for its address."""
    c = lambda n: F.col(prefix + n)
    at = instant_seconds(c("year"), c("month"), c("day"), c("hour"), c("minute"), c("second"))
    return F.when(c("ip").isNotNull() & (c("ip") != ""), at)


def host_key(hostname: Column) -> Column:
    """A hostname without one pair of enclosing double quotes, lower-cased, without one final dot; NULL if nothing is left of it.

    NULL, empty, ``""`` (two quotes) and a lone dot have no key. A single double quote is kept as it stands.
    """
    bare = F.when(F.length(hostname) > 1, F.regexp_replace(hostname, r'(?s)\A"(.*)"\z', "$1")).otherwise(hostname)
    key = F.regexp_replace(F.lower(bare), r"\.\z", "")
    return F.when(key != "", key)


def without_cr(line: Column) -> Column:
    """A line without one trailing carriage return."""
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.char_length(line) - 1)).otherwise(line)


def worked_out_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once for each row.

    Were it projected, predicates on it would be pushed below the projection and work it out once more for each mention; they aren't pushed
    below the explosion of an array of one.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def once_per_line(df: DataFrame) -> DataFrame:
    """One row for each delivered line, of rows that hold its file, its number and what is read of it.

    Copies of a line agree in all of these, so that equal rows are the copies; hashing whole rows lets each task drop its own copies before
    the shuffle without sorting, and a line delivered very often leaves one row for each task.
    """
    return df.distinct()
