"""Interval, as-of and difference joins, all local to an equality key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match_within(left: DataFrame, right: DataFrame, on: str, at: str, other_at: str, other_id: str, seconds: int, keep: Sequence[str]) -> DataFrame:
    """Per left row the earliest right row with at < other_at <= at + seconds (null if none): `matched_at`, `matched_id`.

    Both sides meet on the key and a time slot of that width, so a key with many events still joins only neighbours.
    """
    slot = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    l2 = left.withColumn("__slot", F.explode(F.array(slot(at), slot(at) + 1, slot(at) + 2)))
    r2 = right.select(F.col(on), F.col(other_at).alias("__at"), F.col(other_id).alias("__id"), slot(other_at).alias("__slot"))
    hits = l2.join(r2, [on, "__slot"]).where((F.col("__at") > F.col(at)) & (F.col("__at") <= F.col(at) + F.make_dt_interval(secs=F.lit(seconds))))
    best = hits.groupBy(*keep).agg(F.min(F.struct("__at", "__id")).alias("__m"))
    return left.select(*keep).join(best, list(keep), "left").select(*keep, F.col("__m.__at").alias("matched_at"), F.col("__m.__id").alias("matched_id"))


def next_anchor(rows: DataFrame, anchors: DataFrame, on: str, at: Column, anchor_at: Column, keep: Sequence[str], anchor: str = "anchor", carried: Column | None = None) -> DataFrame:
    """Forward as-of: the first anchor of the key at or after `at`, or what it carries (the least of one time). One sort of both sides together; no pair is formed."""
    r = rows.select(F.col(on), at.alias("__at"), F.lit(0).alias("__kind"), *keep)
    a = anchors.select(F.col(on), anchor_at.alias("__at"), F.lit(1).alias("__kind"), (anchor_at if carried is None else carried).alias("__anchor")).distinct()
    w = Window.partitionBy(on).orderBy("__at", "__kind", "__anchor").rowsBetween(0, Window.unboundedFollowing)
    both = r.unionByName(a, allowMissingColumns=True).withColumn(anchor, F.first("__anchor", ignorenulls=True).over(w))
    return both.where("__kind = 0").select(on, *keep, anchor)


def newest_later(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "latest_value") -> DataFrame:
    """value of the key's newest row, where that is later than the row itself; else null."""
    best = F.max(F.struct(*order, F.col(value))).over(Window.partitionBy(*keys))
    later = F.struct(*(best[c] for c in order)) > F.struct(*order)
    return df.withColumn(name, F.when(later, best[value]))


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, equal: Column | None = None) -> DataFrame:
    """Full outer difference: added, removed, value_changed or same, with both values."""
    b = before.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("__b"))
    a = after.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("__a"))
    kind = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "same").otherwise("value_changed")
    return b.join(a, list(keys), "full_outer").select(*keys, "old_value", "new_value", kind.alias("change"))


def dangling(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left whose key stands in no row of right."""
    return left.join(right.select(F.col(right_key).alias(left_key)).distinct(), left_key, "left_anti")


def keep_missing(all_rows: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """kept, and one row with nulls for each key of all_rows that kept has lost."""
    lost = all_rows.select(*keys).distinct().join(kept.select(*keys), list(keys), "left_anti")
    return kept.unionByName(lost, allowMissingColumns=True)
