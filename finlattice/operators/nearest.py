"""Cosine rankings of stated queries against all vectors, by tiles of queries and vectors; only rows that can matter leave a tile.

A tile takes its products from a matrix product. Scores count to nine digits, so what that product may change is settled: scores
that near to the middle of two steps are taken again, component after component in order, as SQL's list_dot_product adds them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlattice.operators.retrieval import QUERY_BLOCK
from finlattice.session import ship_package

#: Vectors of a tile, about; queries that are multiplied with them at once.
SIDE, STRIP = 8192, 128
STEPS = 1e9
#: Steps that stand for no score (last) and for NaN (first, as in SQL), and what is added to make all of them positive.
NONE, NAN, MOST, SHIFT = -4_000_000_000, 4_000_000_000, 3_900_000_000, 4_000_000_001


class Vectors:
    """Rows of a list column by length; those that are null or hold a null have none."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        lists = lists.cast(pa.large_list(lists.type.value_type))
        flat = lists.values
        self.flat = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        edges = lists.offsets.to_numpy()
        self.start, self.size = edges[:-1], np.diff(edges)
        if flat.null_count:
            nulls = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
            self.size = np.where(nulls[edges[1:]] > nulls[edges[:-1]], -1, self.size)
        self.size = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, self.size)
        self.lengths = [d for d in np.unique(self.size) if d >= 0]

    def rows(self, at: np.ndarray, d: int) -> np.ndarray:
        return self.flat[self.start[at][:, None] + np.arange(d)]


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, added in the order of their components."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return out


def rounded(c: np.ndarray) -> np.ndarray:
    """Cosines in steps of 1e-9, halves away from zero."""
    t = np.clip(c * STEPS, -MOST, MOST)
    whole = np.where(np.abs(t - np.trunc(t)) == 0.5, np.trunc(t) + np.copysign(0.5, t) * 2, np.rint(t))
    return np.where(np.isnan(t), NAN, whole).astype(np.int64)


def steps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of all rows of x with all of y, in steps."""
    nx, ny = np.sqrt(dots(x, x)), np.sqrt(dots(y, y))
    odd = lambda n: ~((n > 1e-140) & (n < 1e140))  # noqa: E731  the bound on the error is relative
    t = x @ y.T / nx[:, None] / ny
    t *= STEPS
    near = (2 * x.shape[1] + 8) * 2.3e-16 * STEPS
    whole = np.rint(t)
    again = ~(np.abs(t - whole) < 0.5 - near)  # not finite: again
    again |= odd(nx)[:, None]
    again |= odd(ny)
    i, j = np.nonzero(again)
    whole[i, j] = 0
    out = whole.astype(np.int64)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[p, q] = rounded(dots(x[p], y[q]) / nx[p] / ny[q])
    return out


def scored(queries: Vectors, at: np.ndarray, vectors: Vectors) -> np.ndarray:
    """Steps of some queries with all vectors."""
    out = np.full((len(at), len(vectors.size)), NONE)
    with np.errstate(all="ignore"):
        for d in set(vectors.lengths) & set(queries.lengths):
            i, j = np.nonzero(queries.size[at] == d)[0], np.nonzero(vectors.size == d)[0]
            if len(i):
                out[np.ix_(i, j)] = steps(queries.rows(at[i], d), vectors.rows(j, d))
    return out


def highest(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest positive keys of each row."""
    n = keys.shape[1]
    top = np.argpartition(keys, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), keys.shape)
    i = np.repeat(np.arange(len(keys)), top.shape[1])
    j = top.ravel()
    some = keys[i, j] > 0
    return i[some], j[some]


def tiled(vectors: DataFrame, asked: DataFrame, vector_rows: int, queries: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(vectors, asked) of each tile. Rows of one vec_id share tiles, as do those of one query_id; each row of asked meets all vectors."""
    ship_package(vectors.sparkSession)
    chunks, blocks = -(-vector_rows // SIDE) or 1, -(-queries // QUERY_BLOCK) or 1
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("__other", every(blocks)).withColumn("__tile", part("vec_id", chunks) * blocks + F.col("__other"))
    right = asked.withColumn("__other", every(chunks)).withColumn("__tile", F.col("__other") * blocks + part("query_id", blocks))
    # A stated number of partitions, as tiles are small for the work that they make and would be put together.
    n = 2 * chunks * blocks
    deal = lambda df: df.drop("__other").repartition(n, "__tile").groupBy("__tile")
    return deal(left).cogroup(deal(right)).applyInArrow(work, schema)


def strips(ids: np.ndarray):
    """Places of some sorted ids at a time; equal ones stay together."""
    at = 0
    while at < len(ids):
        end = np.searchsorted(ids, ids[min(len(ids), at + STRIP) - 1], "right")
        yield np.arange(at, end)
        at = end


def shared(keep: np.ndarray, ids: np.ndarray, axis: int) -> np.ndarray:
    """What one of equal, neighbouring ids has, all of them have."""
    starts = np.nonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))[0]
    return np.repeat(np.logical_or.reduceat(keep, starts, axis=axis), np.diff(starts, append=len(ids)), axis=axis)


def packed(parts: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([pa.table(p, schema=schema) for p in parts]) if parts else schema.empty_table()


def cosine_leaders(vectors: DataFrame, queries: DataFrame, group: str, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, group, step): rows among which are, for each query, the k best of all vectors but itself and the k best firsts of a group.

    step is the cosine in steps of 1e-9; of equal steps the smaller vec_id comes first. Vectors of zeros have NaN, which leads; null
    vectors, those that hold a null and those of another length come last. Rows without id are no rows.
    """
    v = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(group).alias("g"))
    q = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("v"))
    kind = dict(vectors.dtypes)[group]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("g", left.schema.field("g").type), ("step", pa.int64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        left, right = left.sort_by("vec_id"), right.sort_by("query_id")
        ids, label, asked = left["vec_id"].to_numpy(), left["g"].combine_chunks(), right["query_id"].to_numpy()
        held, wanted = Vectors(left["v"]), Vectors(right["v"])
        of = np.asarray(label.dictionary_encode(null_encoding="encode").indices)
        by = np.argsort(of, kind="stable")
        starts = np.nonzero(np.diff(of[by], prepend=-1))[0]
        n = len(ids)
        bits = int(n).bit_length()
        place = np.arange(n, 0, -1) % (1 << bits)  # the smaller id is the larger key
        parts = []
        for at in strips(asked):
            step = scored(wanted, at, held)
            keys = ((step + SHIFT) << bits) + place
            keys[ids == asked[at][:, None]] = 0
            firsts = np.maximum.reduceat(keys[:, by], starts, axis=1)
            i, j = highest(firsts, k)
            j = n - (firsts[i, j] & ((1 << bits) - 1))
            a, b = highest(keys, k)
            i, j = np.divmod(np.unique(np.concatenate([i * n + j, a * n + b])), n)
            parts.append({"query_id": asked[at[i]], "vec_id": ids[j], "g": label.take(pa.array(j)), "step": step[i, j]})
        return packed(parts, schema)

    return tiled(v, q, v.count(), q.count(), work, f"query_id long, vec_id long, g {kind}, step long").withColumnRenamed("g", group)


def cosine_fused(vectors: DataFrame, queries: DataFrame, same: str, tier: Column, k: int, constant: int = 60, weight: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, fused): for each query the k best by reciprocal rank fusion of two rankings of all vectors but itself, exact.

    One ranks by cosine, to nine digits, as cosine_leaders() takes it; one ranks those above 0 by weight where the column `same` equals the query's, plus tier.
    Both rank equal rows by falling vec_id; tier is a whole number below 2**30. Where no id is repeated, what stands below place 2 * (constant + k) - constant
    in both rankings scores less than the first k of either, so the rows above it are the only candidates; then each tile counts, for every candidate, the
    rows that precede it. Rows that share ids add their scores: with up to m rows of a pair of ids, the first k pairs lie within k * m places and a pair
    has 2 * m scores, which sets that place.
    """
    v = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(same).alias("s"), tier.cast("long").alias("t"))
    q = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("v"), F.col(same).alias("s"))
    sizes = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    of_v, of_q = sizes(v, "vec_id"), sizes(q, "query_id")
    m = max(1, of_v.most * of_q.most)
    depth = 2 * m * (constant + k * m) - constant
    kind = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("step", pa.int64()), ("other", pa.int64())]
    schema = pa.schema(kind)

    def pairs(left: pa.Table, right: pa.Table):
        """For each strip of queries: their places in right, ids of the vectors, steps and the other ranking's scores (0: not ranked), and which pairs count."""
        ids, asked = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        codes = pa.chunked_array([*left["s"].chunks, *right["s"].chunks], left.schema.field("s").type).combine_chunks().dictionary_encode().indices
        code = np.asarray(codes.fill_null(-1))
        mine, theirs = code[: len(ids)], code[len(ids) :]
        tiers = left["t"].combine_chunks()
        ranked = (mine >= 0) & ~tiers.is_null().to_numpy(zero_copy_only=False)
        height = np.asarray(tiers.fill_null(0))
        held, wanted = Vectors(left["v"]), Vectors(right["v"])
        for at in strips(asked):
            other = (theirs[at][:, None] == mine) * weight + height
            other[~(ranked & (theirs[at] >= 0)[:, None])] = 0
            yield at, scored(wanted, at, held), np.maximum(other, 0), ids != asked[at][:, None]

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        left, right = left.sort_by("vec_id"), right.sort_by("query_id")
        ids, asked = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        n, parts = len(ids), []
        order = np.arange(n)
        bits = int(n).bit_length()
        for at, step, other, counts in pairs(left, right):
            a, b = highest(np.where(counts, ((step + SHIFT) << bits) + order, 0), depth)
            c, d = highest(np.where(counts & (other > 0), (other << bits) + order, 0), depth)
            keep = np.zeros(step.shape, bool)
            keep[a, b] = keep[c, d] = True
            i, j = np.nonzero(shared(shared(keep, asked[at], 0), ids, 1) & counts if m > 1 else keep)
            parts.append({"query_id": asked[at[i]], "vec_id": ids[j], "step": step[i, j], "other": other[i, j]})
        return packed(parts, schema)

    columns = ", ".join(f"{name} long" for name, _ in kind)
    found = tiled(v, q, of_v.rows, of_q.rows, first, columns)
    pair, row = ["query_id", "vec_id"], F.row_number()
    for c in ("step", "other"):
        found = found.withColumn(f"by_{c}", row.over(Window.partitionBy("query_id").orderBy(F.desc(c), F.desc("vec_id"))))
    place = F.when(F.col("other") > 0, F.least("by_step", "by_other")).otherwise(F.col("by_step"))
    if m > 1:  # rows of a pair stand by their best; equal ones of a ranking are numbered, as are all
        place = F.min(place).over(Window.partitionBy(*pair))
        again = {f"n_{c}": row.over(Window.partitionBy(*pair, c).orderBy("by_step")) - 1 for c in ("step", "other")} | {"n": row.over(Window.partitionBy(*pair).orderBy("by_step"))}
    else:
        again = {c: F.lit(0) for c in ("n_step", "n_other", "n")}
    numbers = list(again)
    candidates = found.withColumn("__p", place).where(F.col("__p") <= depth).withColumns(again).select(*pair, "step", "other", *(F.col(c).cast("long").alias(c) for c in numbers))
    asked = q.unionByName(candidates, allowMissingColumns=True)
    counts_of = pa.schema([*kind, *((c, pa.int64()) for c in numbers), ("ranked", pa.bool_())])

    def ahead(left: pa.Table, right: pa.Table) -> pa.Table:
        is_query = pc.is_null(right["vec_id"])
        right, stated = right.filter(is_query).sort_by("query_id"), right.filter(pc.invert(is_query)).sort_by("query_id")
        if not len(right) or not len(stated) or not len(left):
            return counts_of.empty_table()
        ids, asked = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        of, vec, step_of, other_of = (stated[c].to_numpy() for c in ("query_id", "vec_id", "step", "other"))
        from_, to = np.searchsorted(of, asked), np.searchsorted(of, asked, "right")
        # Ids count by their place among the candidates' ids: on one, or between two.
        known = np.unique(vec)
        at_ = np.searchsorted(known, ids)
        mine = 2 * at_ + (known[np.minimum(at_, len(known) - 1)] == ids)
        theirs = 2 * np.searchsorted(known, vec) + 1
        bits = int(2 * len(known) + 1).bit_length()
        before = np.zeros((2, len(of)), np.int64)
        for at, step, other, counts in pairs(left, right):
            rows = np.where(counts, ((step + SHIFT) << bits) + mine, 0), np.where(counts & (other > 0), (other << bits) + mine, 0)
            for i, x in enumerate(at):
                part = slice(from_[x], to[x])
                for r, base in enumerate((step_of[part] + SHIFT, other_of[part])):
                    cut = (base << bits) + theirs[part]
                    rank = np.argsort(cut)
                    below = np.searchsorted(cut[rank], rows[r][i])  # candidates that each row exceeds
                    before[r, part][rank] += len(ids) - np.cumsum(np.bincount(below, minlength=len(rank) + 1))[:-1]
        return pa.table({"query_id": of, "vec_id": vec, "step": before[0], "other": before[1], **{c: stated[c] for c in numbers}, "ranked": other_of > 0}, schema=counts_of)

    counted = tiled(v, asked, of_v.rows, of_q.rows, ahead, f"{columns}, {', '.join(f'{c} long' for c in numbers)}, ranked boolean")
    counted = counted.groupBy(*pair, *numbers, "ranked").agg(F.sum("step").alias("step"), F.sum("other").alias("other"))
    term = lambda c: 1.0 / (constant + 1 + F.col(c) + F.col(f"n_{c}"))
    scores = counted.groupBy(*pair).agg(F.round(F.sum(term("step") + F.when(F.col("ranked"), term("other")).otherwise(0.0)), 9).alias("fused"))
    best = Window.partitionBy("query_id").orderBy(F.desc("fused"), "vec_id")
    return scores.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k).drop("__n")
