"""Repeated passages of 20 words: token k-mers as De Bruijn edges, nonbranching paths compacted by joins, source coordinates verified."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finlattice.llm import _anchors as A
from finlattice.llm._common import BLOB, CHUNK_BYTES, blob_batch, by_bucket, documents, mixed, offsets, packed, partitions, spread, unpacked
from finlattice.llm.suffix_dedup import first_copies, is_lead, keyed, low, named, own

K = 20
#: Words of the grams that anchor a window.
GRAM = 8
#: Words whose windows are anchored in one step, and edges that a task holds before it sends them on.
CHUNK_WORDS = 1 << 18
HELD_EDGES = 1 << 20
EDGE_P = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    p = 0xD1342543DE82EF95
    up, down = np.full(CHUNK_BYTES, p, np.uint64), np.full(CHUNK_BYTES, pow(p, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    out, at = [], 0
    while at < len(data):
        stop = min(len(data), at + CHUNK_BYTES)
        if stop < len(data):  # cut after white space; a word longer than a chunk is hashed by itself
            stop = max((data.rfind(c, at, stop) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")), default=-1) + 1
            if stop <= at:
                rest = data[at : at + len(data)].split(None, 1)
                if not rest:
                    break
                out.append(np.frombuffer(hashlib.blake2b(rest[0], digest_size=8).digest(), np.uint64))
                at = len(data) - (len(rest[1]) if len(rest) > 1 else 0)
                continue
        b = np.frombuffer(data, np.uint8, stop - at, at)
        space = np.concatenate([[True], _SPACE[b], [True]])
        change = np.nonzero(space[1:] != space[:-1])[0]
        start, end = change[::2], change[1::2]
        if len(start):
            up, down = _powers()
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
            out.append(mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def edges(words: np.ndarray) -> np.ndarray:
    """The De Bruijn edge of each window of K words, as a hash of its tokens."""
    return A.gram_hashes(words, K, EDGE_P) if len(words) >= K else np.zeros(0, np.uint64)


def repeats(group: np.ndarray, edge: np.ndarray, who: np.ndarray, th: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, source): edge occurrences sorted by edge, document and start, and for each place in that order the place of the edge's earliest occurrence."""
    order = np.lexsort((start, th, who, edge, group))
    g, e = group[order], edge[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (e[1:] != e[:-1])
    first = np.nonzero(new)[0]
    return order, np.repeat(first, np.diff(np.append(first, len(order))))


FRAGMENT = ("id", "th", "start", "n", "src", "src_th", "src_start")


def fragments(who, th, start, src, src_th, src_start) -> list[np.ndarray]:
    """Paths of successive edges whose sources are successive too: columns FRAGMENT."""
    order = np.lexsort((start, th, who))
    c = [a[order] for a in (who, th, start, src, src_th, src_start)]
    new = np.ones(len(order), bool)
    new[1:] = False
    for k, step in enumerate((0, 0, 1, 0, 0, 1)):
        new[1:] |= c[k][1:] != c[k][:-1] + step
    first = np.nonzero(new)[0]
    n = np.diff(np.append(first, len(order)))
    return [c[0][first], c[1][first], c[2][first], n, c[3][first], c[4][first], c[5][first]]


def _settled(h, edge, who, th, start):
    """(fragments of occurrences that have an earlier one here, mask of those that have none)."""
    order, source = repeats(h, edge, who, th, start)
    claim = source != np.arange(len(order))
    i, s = order[claim], order[source[claim]]
    other = (who[i] != who[s]) | (th[i] != th[s]) | (start[i] != start[s])  # a repeated row isn't its own source
    first = np.ones(len(order), bool)
    first[i] = False
    i, s = i[other], s[other]
    return (fragments(who[i], th[i], start[i], who[s], th[s], start[s]) if len(i) else None), first


def _find(n: int):
    def run(batches):
        held, size = [], 0
        names, lengths, chunks, total = [], [], [], 0

        def work():
            h, text, start, count, again = A.anchors(np.concatenate(chunks), np.array(lengths, np.int64), K, GRAM)
            pick = lambda k: np.array([x[k] for x in names], np.int64)[text]
            return h, pick(0), pick(1), start + pick(2), count, again

        for batch in batches:
            for who, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                words = word_hashes(text.as_buffer().to_pybytes())
                for at in range(0, len(words) - K + 1, CHUNK_WORDS):
                    piece = words[at : at + CHUNK_WORDS + K - 1]
                    names.append((who, th, at))
                    lengths.append(len(piece))
                    chunks.append(piece)
                    total += len(piece)
                    if total >= CHUNK_WORDS:
                        held.append(work())
                        size += len(held[-1][0])
                        names, lengths, chunks, total = [], [], [], 0
                        if size >= A.HELD:
                            yield A.sent(held, n, True)
                            held, size = [], 0
        if total:
            held.append(work())
        if held:
            yield A.sent(held, n, True)

    return run


def _cut(n: int):
    def flush(held):
        h, who, th, start, edge, hot = map(np.concatenate, zip(*held, strict=True))
        done, first = _settled(h, edge, who, th, start)
        h, who, th, start, edge, hot = (a[first] for a in (h, who, th, start, edge, hot))
        new = np.ones(len(h), bool)
        new[1:] = hot[1:] | hot[:-1] | (h[1:] != h[:-1]) | (who[1:] != who[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.nonzero(new)[0]
        since = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
        at = np.nonzero(since % A.LONGEST_RUN == 0)[0]  # anchors of one hash that follow one another are one stretch here; a run is sent as a byte
        run = np.diff(np.append(at, len(h)))
        out = []
        # Edges of an anchor that many hold are dealt out one by one.
        bucket = (np.where(hot[at], mixed(edge[at]), h[at]) % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(n + 1))
        for b in range(n):
            if (part := order[cut[b] : cut[b + 1]]).size:
                p = at[part]
                out.append((b, packed([h[p], who[p], th[p], start[p].astype(np.uint32), run[part].astype(np.uint8), edge[spread(p, run[part])]])))
        if done:
            out += by_bucket((mixed(done[0].view(np.uint64)) % np.uint64(n)).astype(np.int64), n, done)
        return blob_batch(out)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for who, th, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                words = word_hashes(text.as_buffer().to_pybytes())
                if len(words) < K:
                    continue
                begin, count, hot = A.opened(places.values.to_numpy())
                h = A.minima(A.gram_hashes(words, GRAM), K - GRAM + 1)
                at, hot = spread(begin, count), np.repeat(hot, count)
                inside = at < len(h)  # places of another text that shares id and low may lie past the end
                at, hot = at[inside], hot[inside]
                held.append((h[at], np.full(len(at), who), np.full(len(at), th), at, edges(words)[at], hot))
                size += len(at)
                if size >= HELD_EDGES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _decide(batches):
    parts: dict[int, list] = {}
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = unpacked(blob.as_buffer())
            if len(got) == len(FRAGMENT):
                yield _fragment_batch(got)
            else:
                parts.setdefault(b, []).append(got)
    for b in list(parts):
        h, who, th, start, run, edge = map(np.concatenate, zip(*parts.pop(b), strict=True))
        run = run.astype(np.int64)
        wide = [np.repeat(a, run) for a in (h, who, th)]
        done, _ = _settled(wide[0], edge, wide[1], wide[2], spread(start.astype(np.int64), run))
        if done:
            yield _fragment_batch(done)


def _fragment_batch(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], list(FRAGMENT))


def _decide(batches):
    parts: dict[int, list] = {}
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = unpacked(blob.as_buffer())
            if len(got) == len(FRAGMENT):
                yield _fragment_batch(got)
            else:
                parts.setdefault(b, []).append(got)
    for b in list(parts):
        h, who, th, start, run, edge = map(np.concatenate, zip(*parts.pop(b), strict=True))
        run = run.astype(np.int64)
        wide = [np.repeat(a, run) for a in (h, who, th)]
        done, _ = _settled(wide[0], edge, wide[1], wide[2], spread(start.astype(np.int64), run))
        if done:
            yield _fragment_batch(done)


def compacted(found: DataFrame) -> DataFrame:
    """Maximal nonbranching paths (FRAGMENT columns) from fragments that follow one another in a document and in its source.

    A join tells which fragments have a predecessor on their diagonal, one that ends where they start; those without open a path, and
    the openings counted so far along the diagonal number the paths.
    """
    # Columns that can't be null: else each join puts a null filter of its own under the exchange, which then isn't shared.
    solid = found.select(*(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FRAGMENT))
    f = solid.withColumn("shift", F.col("src_start") - F.col("start")).drop("src_start").distinct()
    line = ["id", "th", "src", "src_th", "shift"]
    ends = f.select(*line, (F.col("start") + F.col("n")).alias("start"), F.lit(True).alias("follows"))
    marked = f.join(ends, [*line, "start"], "left")
    opened = F.count_if(F.col("follows").isNull()).over(Window.partitionBy(*line).orderBy("start"))
    paths = marked.withColumn("path", opened).groupBy(*line, "path").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("stop"))
    paths = paths.withColumn("n", F.col("stop") - F.col("start"))  # fragments of repeated rows may overlap
    return paths.select("id", "th", "start", "n", "src", "src_th", (F.col("start") + F.col("shift")).alias("src_start"))


def _digest(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.sha256(b" ".join(words[start : start + n + K - 1])).digest()


def _source_digests(batches):
    for batch in batches:
        rows = []
        for who, th, text, asked in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
            words, v = text.as_buffer().to_pybytes().split(), asked.values
            rows += [(who, th, s, n, _digest(words, s, n)) for s, n in zip(v.field(0).to_pylist(), v.field(1).to_pylist(), strict=True)]
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["src", "src_th", "src_start", "n", "digest"])


def _remove(batches):
    for batch in batches:
        rows = []
        for text, whole, paths in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = text.as_buffer().to_pybytes().split()
            if whole and len(words) >= K:
                rows.append((len(words), [{"start": 0, "stop": len(words)}], ""))
                continue
            spans: list[list[int]] = []
            for p in sorted(paths or (), key=lambda p: p["start"]):
                s, n = p["start"], p["n"]
                if _digest(words, s, n) != p["digest"]:
                    continue  # the words at the two coordinates differ: no passage
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s + n + K - 1)
                else:
                    spans.append([s, s + n + K - 1])
            kept = b" ".join(w for x, y in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(words)], strict=True) for w in words[x:y])
            rows.append((len(words), [{"start": s, "stop": e} for s, e in spans], kept.decode()))
        n, s, k = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(k, pa.string())],
            ["doc_id", "n_words", "spans", "kept"],
        )


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, spans array<struct<start, stop>> (words removed, maximal runs), kept (words that stay, joined by spaces).

    A word goes if a window of 20 words that covers it also starts earlier: in a document with a smaller id, or before it in its own. Null texts have
    no words; texts under 20 words never change. Null ids count as one id larger than all; different texts with one id are ordered by a
    hash of the text, and equal rows don't remove one another. Other columns are not read; no rows give no rows. A path whose words
    differ from those at its source's coordinates (128 hash bits would have to agree by chance) is no passage, and stays.
    """
    base = keyed(docs, id_col, text_col)
    n = 2 * partitions(docs.sparkSession)
    key = ["id", "low"]
    leads = first_copies(base)
    found = base.join(leads.hint("shuffle_hash"), key).where(is_lead()).select("id", "low", "text").mapInArrow(_find(n), BLOB)
    places = A.gathered(A.repeated_anchors(found, True))
    cut = base.join(places.hint("shuffle_hash"), key).select("id", "th", "text", "places").mapInArrow(_cut(n), BLOB)
    pieces = cut.repartition(n, "bucket").mapInArrow(_decide, ", ".join(f"{c} bigint" for c in FRAGMENT))
    paths = compacted(pieces)
    asked = paths.select("src", "src_th", "src_start", "n").distinct().groupBy(F.col("src").alias("id"), low(F.col("src_th")).alias("low")).agg(F.collect_list(F.struct("src_start", "n", F.col("src_th").alias("th"))).alias("asked"))
    said = base.join(asked.hint("shuffle_hash"), key).select("id", "th", "text", own("asked").alias("asked")).mapInArrow(_source_digests, "src bigint, src_th bigint, src_start bigint, n bigint, digest binary")
    checked = paths.join(said, ["src", "src_th", "src_start", "n"], "left").groupBy("id", low(F.col("th")).alias("low")).agg(F.collect_list(F.struct("start", "n", "digest", "th")).alias("paths"))
    rows = base.join(leads.hint("shuffle_hash"), key, "left").join(checked.hint("shuffle_hash"), key, "left")
    out = "doc_id bigint, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, kept string"
    return named(rows).select("doc_id", "text", (~is_lead()).alias("whole"), own("paths").alias("paths")).mapInArrow(_remove, out)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return remove_passages(documents(spark, sf_dir)).select("doc_id", "n_words", length.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CAST(i AS BIGINT) AS i, array_to_string(w[i : i + 19], ' ') AS s FROM n, unnest(range(1, len(w) - 18)) AS t(i)), f AS (SELECT s, min({'d': doc_id, 'i': i}) AS least FROM g GROUP BY s),
r AS (SELECT doc_id, i FROM g JOIN f USING (s) WHERE {'d': doc_id, 'i': i} > least),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM r, unnest(range(0, 20)) AS t(j)), words AS (SELECT doc_id, CAST(generate_subscripts(w, 1) AS BIGINT) AS pos, unnest(w) AS word FROM n),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS k FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM n LEFT JOIN kept USING (doc_id)
"""
