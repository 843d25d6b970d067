"""SimHash near-duplicates: covering-code anchors, fingerprints replicated to every anchor that can meet a pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.llm._common import BLOB, blob_batch, by_bucket, documents, mixed, only, partitions, texts, u64, unpacked, unsigned_hex, written
from finlattice.llm._graph import components, stars

SEED = 42
THRESHOLD = 3
#: Edges that a task holds before they are reduced to stars.
EDGE_BLOCK = 1 << 20
#: Fingerprints under an anchor from which on they are told apart by blocks of their other half.
CROWD = 64


def fingerprint(data: bytes, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    n = len(words)
    shingles = [b" ".join(words)] if n < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, 1 if n < width else n - width + 1)
    ones = sum(np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), 65536))
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp) of each row: th is a hash of the text, which with the id names a row; fp the SimHash."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x.as_buffer().to_pybytes()) for x in batch.column(1).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    return texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, th bigint, fp bigint")


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome of the perfect [31,26] code (covering radius 1): the changes of at most two bits that lead to a codeword."""
    column = np.arange(1, 32)  # parity-check column of each bit
    of: list[list[int]] = [[] for _ in range(32)]
    of[0].append(0)
    for i in range(31):
        of[column[i]].append(1 << i)
        for j in range(i):
            of[column[i] ^ column[j]].append(1 << i | 1 << j)
    return np.array([m + [m[0]] * (16 - len(m)) for m in of], np.uint64), np.array([len(m) for m in of])


MASKS, REACHED = _masks()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor key): every anchor within covering radius plus threshold of each fingerprint.

    Of two fingerprints that differ in at most 3 bits, one 32-bit half differs in at most 1. The anchors of a half are the
    codewords of a perfect code on 31 of its bits, so the nearest is within 1; a fingerprint goes to
    all within 1 + 1. (Over all 64 bits at once the same rule would need tens of thousands of replicas.)
    """
    index, keys = [], []
    for half in range(2):
        x = fp >> np.uint64(32 * half) & np.uint64(0x7FFFFFFF)
        syndrome = np.zeros(len(x), np.uint64)
        for i in range(31):
            syndrome ^= (x >> np.uint64(i) & np.uint64(1)) * np.uint64(i + 1)
        s = syndrome.astype(np.int64)
        key = (x[:, None] ^ MASKS[s]) | np.uint64(half << 31)
        here = np.arange(16) < REACHED[s][:, None]
        index.append(np.nonzero(here)[0])
        keys.append(key[here])
    return np.concatenate(index), np.concatenate(keys)


def narrowed(key: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(finer key, fp), sorted: what has to be compared under each anchor (key sorted).

    Under an anchor that more than CROWD fingerprints meet at, the other half of a fingerprint is cut into threshold + 1 blocks. Two
    fingerprints that differ in at most threshold bits agree in one of them, so only those that share a block's place and value meet.
    """
    count = np.diff(np.append(first := np.nonzero(np.append(True, key[1:] != key[:-1]))[0], len(key)))
    crowded = np.repeat(count > CROWD, count)
    wide = key.astype(np.uint64) << np.uint64(32)
    keys, fps = [wide[~crowded]], [fp[~crowded]]
    if crowded.any():
        other = fp[crowded] >> np.where(key[crowded] >> np.uint32(31), 0, 32).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        edge = np.linspace(0, 32, threshold + 2).astype(int).tolist()
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            block = other >> np.uint64(x) & np.uint64((1 << y - x) - 1)
            # A place from 1 on keeps these apart from one another and from anchors that aren't crowded.
            keys.append(wide[crowded] | np.uint64(x + 1) << np.uint64(26) | block & np.uint64((1 << 26) - 1))
            fps.append(fp[crowded])
    key, fp = np.concatenate(keys), np.concatenate(fps)
    order = np.lexsort((fp, key))
    return key[order], fp[order]


def close_pairs(key: np.ndarray, fp: np.ndarray, threshold: int):
    """Star edges (node, root) among fingerprints that share a key and differ in at most threshold bits; key sorted."""
    held, size = [], 0
    key, fp = narrowed(key, fp, threshold)
    live = np.arange(len(key))
    step = 1
    while True:
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        if not len(live):
            break
        for at in range(0, len(live), EDGE_BLOCK):
            i = live[at : at + EDGE_BLOCK]
            ok = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= threshold]
            if len(ok):
                held.append((fp[ok], fp[ok + step]))
                size += len(ok)
            if size > EDGE_BLOCK:
                held, size = [stars(*map(np.concatenate, zip(*held, strict=True)))], 0
        step += 1
    if held:
        node, root = stars(*map(np.concatenate, zip(*held, strict=True)))
        yield node[node != root], root[node != root]


def linked(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) that span the classes of distinct fingerprints (column fp) linked at threshold or fewer bits."""
    n = 2 * partitions(distinct.sparkSession)

    def replicate(batches):
        for batch in batches:
            fp = u64(batch.column(0))
            for at in range(0, len(fp), 1 << 16):
                index, key = anchors(part := fp[at : at + (1 << 16)])
                yield blob_batch(by_bucket((mixed(key) % np.uint64(n)).astype(np.int64), n, [key.astype(np.uint32), part[index]]))

    def compare(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got.setdefault(b, []).append(unpacked(blob.as_buffer()))
        for b in list(got):
            key, fp = map(np.concatenate, zip(*got.pop(b), strict=True))
            order = np.lexsort((fp, key))
            for node, root in close_pairs(key[order], fp[order], threshold):
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], ["a", "b"])

    return distinct.select("fp").mapInArrow(replicate, BLOB).repartition(n, "bucket").mapInArrow(compare, "a bigint, b bigint")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, fp, root, component_id) of each row: root is one fingerprint of its component and alone names it, as ids may be null or repeat."""
    rows, _ = written(fingerprints(docs, id_col, text_col), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    of = components(linked(distinct), "simhash-links")
    classes = distinct.join(of, distinct.fp == of.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    least = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, th (hash of the text). component_id is the smallest doc_id reachable over links of at most 3 bits.

    A text without words, empty and null ones among them, has fingerprint zero and is linked like any other; documents that share a
    fingerprint, repeated rows too, are linked. Null ids get a component like other rows but never name one unless it has no other.
    Each distinct fingerprint is compared once, however many copies it has.
    """
    return _classes(docs, id_col, text_col).select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id", "th")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without near copies: of each component the row that names it stays (of several with its id, that with the least text hash).

    Components that share a name, as all rows of theirs have null ids or one id repeats, keep a row each.
    """
    classes = _classes(docs, id_col, text_col)
    named = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("th").alias("th"))
    return only(docs, named.select("doc_id", "th"), id_col, text_col)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
