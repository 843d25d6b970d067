"""Session builder, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, ANSI mode, adaptive execution. master and conf are for tests and benches."""
    builder = SparkSession.builder.appName("finlattice")
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    if master:
        builder = builder.master(master)
    if partitions:
        fixed["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=fixed | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a temporary one is set on a single machine (tests), and nothing else will do on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share: tables written on the way go there")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="finlattice-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors once a context, so that Python operators run wherever the driver imported it from."""
    sc = spark.sparkContext
    if getattr(sc, "_finlattice_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="finlattice-code-"), "finlattice.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._finlattice_shipped = True
