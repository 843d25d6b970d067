"""Presentation and calculation trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walk(arcs: DataFrame, parent: str, child: str, root: str, max_depth: int = 64) -> DataFrame:
    """(node, path, depth) of every node under root; an arc that leads back into its own path is not followed."""
    spark = arcs.sparkSession
    edges = arcs.select(F.col(parent).cast("string").alias("parent"), F.col(child).cast("string").alias("child")).distinct()
    level = spark.createDataFrame([(root, root, 0)], "node string, path string, depth int")
    out, depth = level, 0
    while depth < max_depth:
        slash = lambda c: F.concat(F.lit("/"), c, F.lit("/"))
        level = level.join(edges, F.col("node") == F.col("parent")).where(~F.contains(slash(F.col("path")), slash(F.col("child")))).select(
            F.col("child").alias("node"), F.concat_ws("/", "path", "child").alias("path"), (F.col("depth") + 1).alias("depth"))
        depth += 1
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def weighted_totals(arcs: DataFrame, values: DataFrame) -> DataFrame:
    """(parent, total, children, missing): weight times value summed over a parent's children."""
    j = arcs.join(values, "child", "left")
    return j.groupBy("parent").agg(F.sum(F.col("weight") * F.col("value")).alias("total"), F.count("*").alias("children"), F.count_if(F.col("value").isNull()).alias("missing"))
