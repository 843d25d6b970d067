"""Connected components: in-task reduction to stars, then alternating star joins over Spark tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlattice.llm._common import removed, written


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        low, high = np.minimum(p, q), np.maximum(p, q)
        if not (open_ := low != high).any():
            return nodes, nodes[label]
        np.minimum.at(label, high[open_], low[open_])
        while not np.array_equal(up := label[label], label):
            label = up


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, root): the least node reachable from each node that has an edge (columns a, b: long, undirected).

    Alternates large-star and small-star steps until the edge set stands still; each
    round's edges go to a table in the shared folder, and nothing but two totals reaches the driver.
    """
    spark = edges.sparkSession
    pairs = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    total = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now, path = written(pairs(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), tag)
    seen = total(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pairs(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after, new = written(pairs(small), tag)
        removed(spark, path)
        now, path, before, seen = after, new, seen, total(after)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
