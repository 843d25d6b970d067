"""A corpus pipeline over ``documents``: each stage works on all its predecessor kept.

Toxic documents go, of equal texts the one with the largest doc_id stays, of near copies the one with the smallest, secrets are
masked, and what is left is packed into training sequences. Null and empty texts count as equal texts without words: the row with the largest id of
them stays, null ids being smaller than all. Extra columns of any name travel along to the last stage. No rows give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.llm import exact_dedup, packing, secret_scan, simhash_dedup, toxicity
from finlattice.llm._common import removed, scratch, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score under one half; labels of ids that are missing or null count for nothing."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; of rows that share text and id, one."""
    return exact_dedup.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id; components without ids keep a row each."""
    return simhash_dedup.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by marks and n_chars following the text."""
    return secret_scan.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row's tokens in full sequences; empty texts have the end token alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]
#: Learned scores, XXH64 fingerprints and tokens have no SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        for old in [*(m for m in made if m != path), *([before] if before else [])]:
            removed(spark, old)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
