"""Shared plumbing: normalised inputs, partition counts, shared-folder tables, packed rows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finlattice.session import shared_dir, ship_package

#: Largest stretch of text, in bytes, that one vectorised step works on (scratch memory is about 60 times that).
CHUNK_BYTES = 2 << 20


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): the two columns that text operators read; a null text is empty."""
    ship_package(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    """How many partitions a packed exchange deals to: the session's own setting, which grows with the cluster's input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_MADE: ContextVar[list[str] | None] = ContextVar("tables made on the way", default=None)


@contextmanager
def scratch():
    """Lists the tables that written() makes in this block, so that who writes a result can remove what it was made from."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The rows of df from a Parquet table in the shared folder (cut lineage that survives lost executors), and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/finlattice/{tag}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made and no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def only(docs: DataFrame, picked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose (doc_id, th = text hash) is in picked; one where equal rows repeat. Other columns' names are free."""
    null = F.lit(-(1 << 63))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), null).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"))
    keys = picked.select(F.coalesce("doc_id", null).alias("id"), "th").distinct().hint("shuffle_hash")
    nth = F.row_number().over(Window.partitionBy("id", "th").orderBy("id"))
    return rows.join(keys, ["id", "th"], "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")


def u64(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A bigint column without nulls, as unsigned."""
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def unsigned_hex(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Start of each piece when pieces of these lengths are laid end to end, and the total."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each pair, end to end."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    o = offsets(lengths)
    return np.arange(o[-1]) + np.repeat(starts - o[:-1], lengths)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Numpy arrays as one compressed binary value: few, wide rows shuffle at a fraction of the cost of many narrow ones."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), np.dtype(a.dtype).num))], np.int64)
    whole = b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return len(whole).to_bytes(8, "little") + _ZSTD.compress(whole, asbytes=True)


def unpacked(blob: bytes | pa.Buffer) -> list[np.ndarray]:
    view = memoryview(blob)
    blob = _ZSTD.decompress(pa.py_buffer(view[8:]), int.from_bytes(view[:8], "little"), asbytes=True)
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n, 8).tolist()
    at, out = 8 + 16 * n, []
    for size, num in zip(head[::2], head[1::2], strict=True):
        kind = _KINDS[num]
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * kind.itemsize
    return out


_ZSTD = pa.Codec("zstd", 1)
_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.int64, np.uint64, np.int32, np.uint32, np.uint16, np.uint8, np.float32, np.float64)}
BLOB = "bucket int, blob binary"


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def by_bucket(bucket: np.ndarray, n: int, arrays: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """Rows (bucket, packed arrays) of the entries of each bucket."""
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    arrays = [a[order] for a in arrays]
    return [(b, packed([a[x:y] for a in arrays])) for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if y > x]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed copy of unsigned 64-bit values (finaliser of a multiply-xorshift hash)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
