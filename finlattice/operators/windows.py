"""Ranking, look-ahead and running operators; every window is partitioned by a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column]


def ranked(df: DataFrame, keys: Sequence[str], order: Order, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Order, flag: str = "is_current") -> DataFrame:
    """All versions, with a flag on the one that comes first in order."""
    return ranked(df, keys, order, "__rn").withColumn(flag, F.col("__rn") == 1).drop("__rn")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    return ranked(df, keys, order, "__rn").where("__rn = 1").drop("__rn")


def next_flagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, value: str, name: str) -> DataFrame:
    """value of the next row strictly below for which flag holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.first(F.when(flag, F.col(value)), ignorenulls=True).over(w))


def dense_order(df: DataFrame, keys: Sequence[str], order: Order, name: str = "line_order") -> DataFrame:
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))


def distinct_in_window(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """How many values a key has, on each of its rows; an aggregate joined back, as a window can't count distinct values."""
    counts = df.groupBy(*keys).agg(F.count_distinct(value).alias(name))
    return df.join(counts, list(keys))


def occurrence_suffix(df: DataFrame, keys: Sequence[str], label: str, order: Order, name: str = "line_key") -> DataFrame:
    """The label, with #n from its second occurrence on."""
    n = F.row_number().over(Window.partitionBy(*keys, label).orderBy(*order))
    return df.withColumn("__n", n).withColumn(name, F.when(F.col("__n") == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit("#"), F.col("__n")))).drop("__n")


def totals_else_breakdown(df: DataFrame, keys: Sequence[str], is_total: Column) -> DataFrame:
    """A key's total rows where it has any, else all its rows."""
    has = F.max(F.when(is_total, 1).otherwise(0)).over(Window.partitionBy(*keys))
    return df.withColumn("__has", has).withColumn("__is", is_total).where("__has = 0 OR __is").drop("__has", "__is")


def elect(df: DataFrame, group: str, candidate: str, voter: str) -> DataFrame:
    """Per group the candidate with most distinct voters, then most rows, then the least name."""
    votes = df.groupBy(group, candidate).agg(F.count_distinct(voter).alias("voters"), F.count("*").alias("n"))
    return first_per_key(votes, [group], [F.desc("voters"), F.desc("n"), F.asc(candidate)])


def islands(df: DataFrame, keys: Sequence[str], ordinal: Column) -> DataFrame:
    """Adds `island`: rows of a key whose distinct ordinals follow one another share it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal)) if keys else F.row_number().over(Window.orderBy(ordinal))
    return df.withColumn("island", ordinal - n)


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str = "n") -> DataFrame:
    """Rows of the key in the `seconds` up to and including each row's time."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn(name, F.count("*").over(w))
