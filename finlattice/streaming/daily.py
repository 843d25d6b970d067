"""Durable micro-batches: a file stream, keyed upserts per batch, and a table that a rerun leaves as it is."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.operators.windows import first_per_key
from finlattice.session import shared_dir


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def keyed_stream(spark: SparkSession, source: str, keys: Sequence[str], recency: str, keep: Column, folder: str | None = None, files_per_batch: int = 7) -> DataFrame:
    """Run what is new in a Parquet folder or file through to an append-only log, and return its latest row per key.

    Each batch is written under its own number, so that a batch that runs again overwrites itself; late rows win by recency, and the
    checkpoint holds which files are done. A second call with the same folder reads only new files.
    """
    folder = folder or work_folder(spark)
    schema = spark.read.parquet(source).schema
    at, name = source.rsplit("/", 1) if source.endswith(".parquet") else (source, "*")

    def batch(rows: DataFrame, number: int) -> None:
        first_per_key(rows.where(keep), keys, [F.desc(recency)]).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet")
    stream = reader.parquet(source if name == "*" or _is_folder(spark, source) else f"{at}/{name[:-8]}*.parquet")
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema(schema.add("batch", "integer")).parquet(f"{folder}/log")
    return first_per_key(log, keys, [F.desc(recency), F.desc("batch")]).drop("batch")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Tumbling counts with a watermark, for a streaming or a batch table."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
