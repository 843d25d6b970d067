"""Embedding near-duplicates: int8 tile products with error bounds; possible pairs are recomputed in double precision."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.llm._common import written
from finlattice.llm._graph import components, stars
from finlattice.session import ship_package

THRESHOLD = 0.9
#: Vectors of a tile's side. Each vector goes to as many tiles as there are sides, so larger ones shuffle less.
SIDE = 8192
#: Rows of the smaller products that a tile is worked through by; a product has at most STRIP x STRIP_WIDE entries.
STRIP = 512
STRIP_WIDE = 4096
EDGE_BLOCK = 1 << 20


class Quantised:
    """Unit vectors as int8 steps of a scale each, with the norms that bound what rounding can change.

    With x = s q + e, a product of units is x.y = s q.t r + s q.f + e.y, so it differs from the
    int8 product by at most |s q||f| + |e||y|, and |y| is 1.
    """

    def __init__(self, vectors: np.ndarray):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.scale = np.abs(unit).max(axis=1) / 127
        self.steps = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.steps * self.scale[:, None]
        self.error = np.linalg.norm(unit - near, axis=1)
        self.length = np.linalg.norm(near, axis=1)

    def wide(self, rows: slice, beside: np.ndarray) -> np.ndarray:
        """The int8 steps of some rows for a product, with one more column. Their sums are whole numbers that float32 holds exactly up to 1040 dimensions."""
        kind = np.float32 if self.steps.shape[1] <= 1040 else np.float64
        return np.concatenate([self.steps[rows].astype(kind), beside[rows, None].astype(kind)], axis=1)


def moderate(x: np.ndarray) -> np.ndarray:
    """Rows whose components are very large or very small, scaled by a power of two, which changes no cosine; others as they are."""
    top = np.frexp(np.abs(x).max(axis=1))[1]
    return np.ldexp(x, np.where(np.abs(top) > 300, -top, 0)[:, None])


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def tile_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """(i, j) of the pairs of rows with cosine of threshold or more; of x with itself, i < j.

    The column beside the steps adds each pair's own |s q||f| to the product, so that what is compared is the bound on its cosine.
    """
    x, y = moderate(x), moderate(y)
    a, b = Quantised(x), Quantised(y)
    left, right = a.length / a.scale, b.error / b.scale
    least = (threshold - 1e-5 - a.error) / a.scale
    for from_ in range(0, len(y), STRIP_WIDE):
        columns = slice(from_, from_ + STRIP_WIDE)
        other = b.wide(columns, right).T
        for at in range(0, len(x), STRIP):
            rows = slice(at, at + STRIP)
            if same and at >= columns.stop:
                continue
            product = a.wide(rows, left) @ other
            product *= b.scale[columns].astype(product.dtype)
            i, j = np.nonzero(product >= least[rows, None].astype(product.dtype))
            i += at
            j += from_
            if same:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), EDGE_BLOCK):
                p, q = i[part : part + EDGE_BLOCK], j[part : part + EDGE_BLOCK]
                ok = cosine(x[p], y[q]) >= threshold
                yield p[ok], q[ok]


def tiles(distinct: DataFrame, threshold: float, sides: int) -> DataFrame:
    """(node, links, root) per tile and vector with links there, from rows (node, copies, embedding); links counts copies."""
    side = F.pmod(F.xxhash64("node"), F.lit(sides)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
    dealt = distinct.withColumn("side", side).withColumn("other", other).select(
        (F.least("side", "other") * sides + F.greatest("side", "other")).alias("tile"), "side", "node", "copies", "embedding"
    )

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        lists = table["embedding"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        links = np.zeros(len(node), np.int64)
        held, count = [], 0
        for d in np.unique(size):  # vectors of unequal length have no cosine
            of = [np.nonzero((size == d) & (side == s))[0] for s in np.unique(side)]
            same = len(of) == 1
            p, q = of[0], of[-1]
            if not len(p) or not len(q):
                continue
            vectors = lambda at: flat[start[at][:, None] + np.arange(d)]
            for i, j in tile_pairs(vectors(p), vectors(q), threshold, same):
                i, j = p[i], q[j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                held.append((node[i], node[j]))
                count += len(i)
                if count > EDGE_BLOCK:
                    held, count = [stars(*map(np.concatenate, zip(*held, strict=True)))], 0
        some = links > 0
        root = node[some]
        if held:
            names, roots = stars(*map(np.concatenate, zip(*held, strict=True)))
            root = roots[np.searchsorted(names, root)]
        return pa.table({"node": node[some], "links": links[some], "root": root})

    # A tile of one side alone holds its pairs once; one of two sides only those across.
    return dealt.groupBy("tile").applyInArrow(compare, "node bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other rows with cosine >= threshold), component_id, kept.

    Equal vectors are compared once and counted as often as they stand. Null, empty and zero vectors, those with a null or
    non-finite component, and rows without id link with nothing and stay. Vectors of unequal length don't link. Rows that
    share a vec_id count as one node with the links of each. Other columns are not read.
    """
    ship_package(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # Adding zero makes -0 and 0 one key.
    v = v.withColumn("embedding", F.when(sound, F.transform("embedding", lambda x: x + F.lit(0.0))))
    distinct, _ = written(v.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "embeddings")
    sides = max(1, math.ceil(distinct.count() / SIDE))
    found, _ = written(tiles(distinct.withColumn("embedding", F.col("embedding").cast("array<double>")), threshold, sides), "embedding-links")
    of = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "embedding-classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = distinct.join(links, "node", "left").join(of, "node", "left").select(
        "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id")
    )
    out = v.join(named, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
