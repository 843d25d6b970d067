"""Exact duplicates: counting quotient filters per partition, merged by sorted remainders, then byte verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.llm._common import BLOB, blob_batch, documents, only, packed, partitions, texts, u64, unpacked

#: Bits of a fingerprint's quotient; the other 48 are its remainder.
QUOTIENT_BITS = 16
#: Fingerprints that a task holds before it closes a filter and starts the next.
FILTER_ENTRIES = 1 << 21
#: Bytes of distinct texts that a task holds before it sends them on.
HELD_BYTES = 64 << 20


class CountingQuotientFilter:
    """Remainders of 64-bit fingerprints in sorted runs, one run for each quotient, with a counter each.

    The quotient isn't stored with an entry: run lengths by quotient say where it stands. As the
    remainders are kept whole, a merge of sorted runs loses nothing.
    """

    def __init__(self, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray, first: int = 0):
        self.runs, self.remainders, self.counts, self.first = runs, remainders, counts, first

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, first: int = 0, quotients: int = 1 << QUOTIENT_BITS) -> CountingQuotientFilter:
        values, at = np.unique(fingerprints, return_inverse=True)
        sums = np.bincount(at, counts, len(values)).astype(np.int64)
        quotient = (values >> np.uint64(64 - QUOTIENT_BITS)).astype(np.int64) - first
        return cls(np.bincount(quotient, minlength=quotients).astype(np.uint32), values & np.uint64((1 << 64 - QUOTIENT_BITS) - 1), sums, first)

    def fingerprints(self) -> np.ndarray:
        quotient = np.repeat(np.arange(len(self.runs), dtype=np.uint64) + np.uint64(self.first), self.runs)
        return quotient << np.uint64(64 - QUOTIENT_BITS) | self.remainders

    def part(self, low: int, high: int) -> CountingQuotientFilter:
        """The quotients from low to before high."""
        x, y = int(self.runs[:low].sum()), int(self.runs[:high].sum())
        return CountingQuotientFilter(self.runs[low:high], self.remainders[x:y], self.counts[x:y], self.first + low)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter of the same quotients: all runs interleave by remainder in one pass, counters of equal ones add up.

        Each filter is sorted by quotient and remainder, so a stable sort finds one run a filter and only merges them.
        """
        a = filters[0]
        if len(filters) == 1:
            return a
        quotient = np.concatenate([np.repeat(np.arange(len(f.runs)), f.runs) for f in filters])
        remainder, counts = np.concatenate([f.remainders for f in filters]), np.concatenate([f.counts for f in filters])
        order = np.argsort(quotient.astype(np.uint64) << np.uint64(64 - QUOTIENT_BITS) | remainder, kind="stable")
        quotient, remainder, counts = quotient[order], remainder[order], counts[order]
        new = np.ones(len(order), bool)
        new[1:] = (quotient[1:] != quotient[:-1]) | (remainder[1:] != remainder[:-1])
        first = np.nonzero(new)[0]
        sums = np.add.reduceat(counts, first) if len(first) else counts
        return cls(np.bincount(quotient[first], minlength=len(a.runs)).astype(np.uint32), remainder[first], sums, a.first)

    def to_bytes(self) -> bytes:
        six = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].ravel()
        return packed([np.array([self.first], np.int64), self.runs, six, self.counts.astype(np.uint32)])

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountingQuotientFilter:
        first, runs, six, counts = unpacked(blob)
        eight = np.zeros((len(counts), 8), np.uint8)
        eight[:, :6] = six.reshape(-1, 6)
        return cls(runs, eight.view("<u8").ravel(), counts.astype(np.int64), int(first[0]))


def repeated_fingerprints(fingerprints: DataFrame, column: str = "fp") -> DataFrame:
    """(fp long): the values of a bigint column that occur more than once; each task sends one filter part per quotient range."""
    n = min(partitions(fingerprints.sparkSession), 1 << QUOTIENT_BITS)
    cut = np.linspace(0, 1 << QUOTIENT_BITS, n + 1).astype(int).tolist()

    def build(batches):
        held, size = [], 0

        def flush():
            f = CountingQuotientFilter.build(np.concatenate(held))
            return blob_batch([(b, p.to_bytes()) for b in range(n) if (p := f.part(cut[b], cut[b + 1])).runs.any()])

        for batch in batches:
            held.append(u64(batch.column(0)))
            size += len(held[-1])
            if size >= FILTER_ENTRIES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(batches):
        whole: dict[int, list[CountingQuotientFilter]] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole.setdefault(b, []).append(CountingQuotientFilter.from_bytes(blob.as_buffer()))
        for b in list(whole):
            f = CountingQuotientFilter.merge(whole.pop(b))
            yield pa.RecordBatch.from_arrays([pa.array(f.fingerprints()[f.counts > 1].view(np.int64))], ["fp"])

    parts = fingerprints.select(column).mapInArrow(build, BLOB)
    return parts.repartition(n, "bucket").mapInArrow(merge, "fp bigint")


def collapsed(t: DataFrame) -> DataFrame:
    """(fp, text, keep_id, n): equal texts that one task holds as one row, so that a text with many copies travels once a task.

    t: (doc_id, fp, text). Texts are compared byte by byte. A task holds at most HELD_BYTES of text, or one longer text.
    """

    def run(batches):
        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def flush():
            keys = list(held)
            keep, n = zip(*held.values(), strict=True)
            columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()).view(pa.string()), pa.array(keep, pa.int64()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["fp", "text", "keep_id", "n"])

        for batch in batches:
            for who, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                now = held.get((fp, text))
                if now is None:
                    held[fp, text] = [who, 1]
                    size += len(text) + 200
                else:
                    now[0] = who if now[0] is None or (who is not None and who > now[0]) else now[0]
                    now[1] += 1
                if size >= HELD_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return t.select("doc_id", "fp", "text").mapInArrow(run, "fp bigint, text string, keep_id bigint, n bigint")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, th (the text's fingerprint).

    Texts are equal when their bytes are; a null text counts as empty. The largest doc_id of a
    group stays (null ids are smaller than all; if a group has no other, keep_id is null). Of repeated rows that
    share text and doc_id, one stays. No other column is read, so clashing names do no harm; no rows give no rows.
    """
    t = texts(docs, id_col, text_col).withColumn("fp", F.xxhash64("text"))
    twice = repeated_fingerprints(t.select("fp")).hint("shuffle_hash")
    # Byte verification: only the whole texts themselves decide which rows with one fingerprint are equal.
    groups = (
        collapsed(t).join(twice, "fp", "left_semi")
        .groupBy("fp", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    )
    rows = t.select("doc_id", "fp", F.unhex(F.sha2("text", 256)).alias("sha")).groupBy("doc_id", "sha", "fp").agg(F.count("*").alias("n"))
    out = rows.join(groups, "sha", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("fp").alias("th"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without exact copies: of equal texts the row with the largest doc_id stays."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept")
    return only(docs, kept.select("doc_id", "th"), id_col, text_col)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).drop("th")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
