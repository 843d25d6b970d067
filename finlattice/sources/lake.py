"""The lake: Parquet folders by table, read through views and written by partition or by version."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.sources.schemas import TABLES, empty


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, ciks: Sequence[int] | None = None) -> DataFrame:
        """A table by name, of some companies only if ciks are given; empty and typed where nothing is stored."""
        path = f"{self.root}/{name}"
        if not exists(self.spark, path):
            df = empty(self.spark, name)
        else:
            reader = self.spark.read.option("mergeSchema", True)
            df = (reader.schema(TABLES[name]) if name in TABLES else reader).parquet(path)
        return df.where(F.col("cik").isin(*ciks)) if ciks else df

    def register(self) -> None:
        """A temporary view for every table of the catalog."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)

    def overwrite_partitions(self, name: str, df: DataFrame, by: Sequence[str], sort: Sequence[str] = ()) -> None:
        """Replace the partitions that df has rows of, sorted within files so that scans skip row groups."""
        out = df.repartition(*by)
        if sort:
            out = out.sortWithinPartitions(*by, *sort)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{name}")

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").option("compression", "zstd").parquet(f"{self.root}/{name}")

    def publish(self, name: str, df: DataFrame, required: Sequence[str] = ()) -> str:
        """Write a new version of a table and point to it last, so that readers see the old one or the new one whole. Required tables must be there."""
        missing = [t for t in required if not exists(self.spark, f"{self.root}/{t}")]
        if missing:
            raise ValueError(f"not published: {', '.join(missing)} missing")
        version = uuid.uuid4().hex
        df.write.option("compression", "zstd").parquet(f"{self.root}/versions/{name}/{version}")
        self.append("publications", self.spark.createDataFrame([(name, version)], "name string, version string").withColumn("at", F.current_timestamp()))
        return version

    def published(self, name: str) -> DataFrame:
        last = self.spark.read.parquet(f"{self.root}/publications").where(F.col("name") == name).orderBy(F.desc("at")).select("version").first()
        return self.spark.read.parquet(f"{self.root}/versions/{name}/{last.version}")


def write_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """CSV with a header; cells that a spreadsheet would run as formulas get an apostrophe. With a limit, a larger table is refused."""
    if limit is not None and df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    safe = [F.when(F.col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").option("header", True).csv(path)
