"""Repeated byte strings across documents: collection BWT and common prefixes, built column by column over external files.

Texts are cut into segments whose 50-byte windows share an anchor, since equal windows have equal anchors. The segments that a task holds, and
then those that meet in the bucket of an anchor, are the documents of a collection BWT; its common prefixes alone say which windows repeat.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.llm import _anchors as A
from finlattice.llm._common import BLOB, CHUNK_BYTES, blob_batch, by_bucket, documents, mixed, offsets, packed, partitions, spread, texts, unpacked

WINDOW = 50
#: Bytes of the grams that anchor a window, and of those that windows of a hot anchor are dealt by.
GRAM, LONG_GRAM = 18, 40
LONG_P = np.uint64(0xC6BC279692B5C323)
#: Bytes of a symbol of the BWT. A segment is read as so many documents, one from each of its first bytes on.
SYMBOL = 8
#: Bytes of segments from which on a BWT is closed; segments of one anchor always stay together.
BLOCK_BYTES = 1 << 18
#: Bytes of segments that a task holds before it sends them on.
HELD_BYTES = 8 << 20
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


class Columns:
    """The growing columns as files that each round reads from front to end and writes anew with its suffixes merged in.

    A row is a distinct suffix: its first symbol (by rank), the row of what follows that symbol, the bytes it shares with the row before,
    and its number. (row of the rest, first symbol) is the BWT's entry: the symbol that stands before that row's suffix.
    """

    KINDS = (("first", np.int32), ("rest", np.int32), ("lcp", np.uint8), ("number", np.int32))

    def __init__(self, folder: str):
        self.files = [open(os.path.join(folder, name), "w+b", buffering=0) for name, _ in self.KINDS]
        self.rows = 0

    def write(self, *columns: np.ndarray) -> None:
        self.rows = len(columns[0])
        for f, (_, kind), a in zip(self.files, self.KINDS, columns, strict=True):
            f.seek(0)
            left = memoryview(np.ascontiguousarray(a, kind)).cast("B")
            while len(left):
                left = left[f.write(left) :]

    def read(self) -> list[np.ndarray]:
        out = [np.empty(self.rows, kind) for _, kind in self.KINDS]
        for f, a in zip(self.files, out, strict=True):
            f.seek(0)
            left = memoryview(a).cast("B")
            while len(left):
                left = left[f.readinto(left) :]
        return out

    def close(self) -> None:
        for f in self.files:
            f.close()


def symbols(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, bytes left) at each byte: SYMBOL bytes as a number that sorts like them, with zeros past the segment's end."""
    padded = np.concatenate([text, np.zeros(SYMBOL, np.uint8)])
    w = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, SYMBOL)[: len(text)]).view(">u8").ravel().astype(np.uint64)
    left = np.repeat(offsets(lengths)[1:], lengths) - np.arange(len(text))
    short = np.nonzero(left < SYMBOL)[0]
    w[short] &= ~((np.uint64(1) << (np.uint64(8) * (SYMBOL - left[short]).astype(np.uint64))) - np.uint64(1))
    return w, left


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that two symbols share at the front."""
    x = a ^ b
    for s in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(s)
    return (64 - np.bitwise_count(x).astype(np.int64)) >> 3


def range_min(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of a[low] to a[high], for each pair."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out, table = np.empty(len(low), a.dtype), a
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        here = np.nonzero(level == k)[0]
        if len(here):
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k) + 1])
    return out


def collection_bwt(text: np.ndarray, lengths: np.ndarray, columns: Columns, cap: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Leaves the collection's columns in their files; returns (the number of the row of each byte's suffix, bytes left there).

    Round r puts one more symbol before the suffix of every document longer than r. Suffixes are those of the text with zeros after its
    end; equal ones that come up in one round are one row, so copies cost a row once. Where a new suffix goes follows from its symbol and
    the place of the suffix it extends. Common prefixes (up to cap) change only beside new rows: where first symbols
    differ they say so, else what the rests share is the least of the last round's column between the two rests.
    """
    w, left = symbols(text, lengths)
    by = np.argsort(w)
    new = np.append(True, np.diff(w[by]) != 0)
    symbol = w[by[new]]
    rank = np.empty(len(w), np.int64)
    rank[by] = np.cumsum(new) - (symbol[:1] == 0).sum()  # zero is the symbol of the empty suffix
    symbol = np.append(np.zeros(1, np.uint64), symbol[symbol > 0])
    round_of = (left - 1) // SYMBOL
    order = np.argsort(round_of.astype(np.uint8), kind="stable")
    edge = np.searchsorted(round_of[order], np.arange(int(round_of.max(initial=-1)) + 2))
    place, number_of = np.zeros((2, len(text) + SYMBOL), np.int32)
    columns.write(*(np.zeros(1, kind) for _, kind in Columns.KINDS))  # the empty suffix
    made = 1
    for r in range(len(edge) - 1):
        first, rest, lcp, number = columns.read()
        at = order[edge[r] : edge[r + 1]]
        n = len(first)
        key = rank[at] * n
        if r:
            key += place[at + SYMBOL]
        by = np.argsort(key)
        key = key[by]
        new = np.append(True, key[1:] != key[:-1])
        key = key[new]
        # Rows stand by first symbol, then by the row of the rest.
        before = np.searchsorted(first * np.int64(n) + rest, key)
        to = before + np.arange(len(key))
        moved = np.arange(n) + np.cumsum(np.bincount(before, minlength=n + 1))[:n]

        def merged(old, fresh, moved=moved, to=to):
            out = np.empty(len(old) + len(to), old.dtype)
            out[moved], out[to] = old, fresh
            return out

        first, rest = merged(first, key // n), merged(rest, key % n)
        size = len(first)
        touched = np.zeros(size + 1, bool)
        touched[to] = touched[to + 1] = True
        b = np.nonzero(touched[1:size])[0] + 1
        got = shared_bytes(symbol[first[b - 1]], symbol[first[b]])
        same = np.nonzero(got == SYMBOL)[0]
        low, high = rest[b[same] - 1] + 1, rest[b[same]]
        apart = low <= high
        got[same] = cap  # one rest: nothing but zeros in both
        got[same[apart]] = np.minimum(cap, SYMBOL + range_min(lcp, low[apart], high[apart]).astype(np.int64))
        lcp = merged(lcp, np.uint8(0))
        lcp[b] = np.minimum(got, cap)
        columns.write(first, moved[rest], lcp, merged(number, np.arange(made, made + len(key), dtype=np.int32)))
        which = np.cumsum(new) - 1
        at = at[by]
        place[at], number_of[at] = to[which], made + which
        made += len(key)
    return number_of[: len(text)], left


def repeated_windows(text: np.ndarray, lengths: np.ndarray, owner: np.ndarray, columns: Columns) -> np.ndarray:
    """Whether the window at each byte of these segments also stands in a segment of a smaller owner."""
    number_of, left = collection_bwt(text, lengths, columns)
    _, _, lcp, number = columns.read()
    class_of = np.empty(len(number), np.int64)
    class_of[number] = np.cumsum(lcp < WINDOW) - 1
    at = np.nonzero(left >= WINDOW)[0]
    of, who = class_of[number_of[at]], np.repeat(owner, lengths)[at]
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, of, who)
    out = np.zeros(len(text), bool)
    out[at] = who > least[of]
    return out


def anchor_of(text: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The least gram hash of the window at each place: what all windows of a segment share."""
    return A.minima(A.gram_hashes(text, GRAM, table=_TABLE), WINDOW - GRAM + 1)[begin]


def judged(text: np.ndarray, lengths: np.ndarray, owner: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(whether the window at each byte repeats one of a smaller owner, anchor of each segment), by blocks of whole anchors.

    Windows whose hash no second owner has can't repeat, as equal windows have equal hashes; only stretches of the others enter a BWT.
    """
    begin = offsets(lengths)
    group = anchor_of(text, begin[:-1])
    out, fresh = np.zeros((2, len(text)), bool)
    fresh[begin[:-1]] = True
    at = spread(begin[:-1], lengths - WINDOW + 1)
    h = A.gram_hashes(text, WINDOW, table=_TABLE)[at]
    by = np.argsort(h)
    cls, several = A._groups(h[by], np.repeat(owner, lengths - WINDOW + 1)[by], False)
    maybe = np.zeros(len(text), bool)
    maybe[at[by[several[cls]]]] = True
    first, count = runs(maybe, fresh)
    if not len(first):
        return out, group
    of, size = np.searchsorted(begin, first, "right") - 1, count + WINDOW - 1
    order = np.argsort(group[of], kind="stable")
    first, of, size = first[order], of[order], size[order]
    g, total = group[of], offsets(size)
    cuts = [*np.nonzero(g[1:] != g[:-1])[0] + 1, len(g)]
    columns, x = Columns(folder), 0  # one set of files for all blocks
    for y in map(int, cuts):
        if y < len(g) and total[y] - total[x] < BLOCK_BYTES:
            continue
        part = spread(first[x:y], size[x:y])
        out[part[repeated_windows(text[part], size[x:y], owner[of[x:y]], columns)]] = True  # stretches may overlap
        x = y
    columns.close()
    return out, group


def runs(yes: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the stretches of true values; apart: places where a stretch has to begin anew."""
    start = yes & (apart | ~np.append(False, yes[:-1]))
    first = np.nonzero(start)[0]
    return first, np.bincount(np.cumsum(start)[yes] - 1, minlength=len(first)) if len(first) else first


class Held:
    """Segments of a task by document and text, each with the places (th, start) where the document has it."""

    def __init__(self):
        self.places: dict[tuple[int, bytes, bool], list[tuple[int, int]]] = {}
        self.size = 0

    def add(self, segment: bytes, who: int, th: int, start: int, hot: bool) -> None:
        now = self.places.get((who, segment, hot))
        if now is None:
            self.places[who, segment, hot] = [(th, start)]
            self.size += len(segment) + 32
        else:
            now.append((th, start))
            self.size += 16

    def blobs(self, n: int, folder: str) -> pa.RecordBatch:
        """What repeats a smaller document here goes to a bucket of its document as spans; what is left of the segments to the bucket of its anchor."""
        if not self.places:
            return blob_batch([])
        lengths = np.array([len(s) for _, s, _ in self.places], np.int64)
        owner, hot = np.array([w for w, _, _ in self.places], np.int64), np.array([x for *_, x in self.places], bool)
        text, begin = np.frombuffer(b"".join([s for _, s, _ in self.places]), np.uint8), offsets(lengths)
        times = np.array([len(v) for v in self.places.values()], np.int64)
        th, start = np.array([p for v in self.places.values() for p in v], np.int64).reshape(-1, 2).T
        gone, group = judged(text, lengths, owner, folder)
        window = np.zeros(len(text), bool)
        window[spread(begin[:-1], lengths - WINDOW + 1)] = True
        fresh = np.zeros(len(text), bool)
        fresh[begin[:-1]] = True
        out = []
        at, count = runs(gone, fresh)
        if len(at):
            of = np.searchsorted(begin, at, "right") - 1
            places = spread(offsets(times)[:-1][of], times[of])
            low = np.repeat(at - begin[of], times[of]) + start[places]
            done = [np.repeat(owner[of], times[of]), th[places], low, np.repeat(count + WINDOW - 1, times[of])]
            out += by_bucket((mixed(done[0].view(np.uint64) ^ mixed(done[1].view(np.uint64)) ^ (low >> 14).view(np.uint64)) % np.uint64(n)).astype(np.int64), n, done)
        # Windows of a hot anchor are dealt by a longer gram beside it: runs of one such gram travel together.
        second = A.minima(A.gram_hashes(text, LONG_GRAM, LONG_P, _TABLE), WINDOW - LONG_GRAM + 1)
        second[~np.repeat(hot, lengths)[: len(second)]] = 0
        fresh[1 : len(second)] |= second[1:] != second[:-1]
        at, count = runs(window & ~gone, fresh)
        of = np.searchsorted(begin, at, "right") - 1
        size = count + WINDOW - 1
        bucket = (np.where(hot[of], mixed(group[of] ^ second[at]), group[of]) % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n + 1))
        for b in range(n):
            if (part := order[edges[b] : edges[b + 1]]).size:
                seg = of[part]
                places = spread(offsets(times)[:-1][seg], times[seg])
                low = np.repeat(at[part] - begin[seg], times[seg]) + start[places]
                arrays = [owner[seg], times[seg].astype(np.uint32), size[part].astype(np.uint8), text[spread(at[part], size[part])], th[places], low.astype(np.uint32)]
                out.append((b, packed(arrays)))
        return blob_batch(out)


SPANS = "id bigint, th bigint, start bigint, stop bigint"


def _span_batch(who, th, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (who, th, start, stop)], ["id", "th", "start", "stop"])


def _find(n: int):
    def run(batches):
        held, size = [], 0
        names, lengths, chunks, total = [], [], [], 0

        def work():
            h, text, start, count, again = A.anchors(np.frombuffer(b"".join(chunks), np.uint8), np.array(lengths, np.int64), WINDOW, GRAM, _TABLE, within=False)
            who = np.array([x[0] for x in names], np.int64)[text]
            th = np.array([x[1] for x in names], np.int64)[text]
            return h, who, th, start + np.array([x[2] for x in names], np.int64)[text], count, again

        for batch in batches:
            for who, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                data = text.as_buffer()
                for at in range(0, max(1, len(data) - WINDOW + 1), CHUNK_BYTES):
                    piece = data[at : at + CHUNK_BYTES + WINDOW - 1]
                    names.append((who, th, at))
                    lengths.append(len(piece))
                    chunks.append(piece.to_pybytes())
                    total += len(piece)
                    if total >= CHUNK_BYTES:
                        held.append(work())
                        size += len(held[-1][0])
                        names, lengths, chunks, total = [], [], [], 0
                        if size >= A.HELD:
                            yield A.sent(held, n, False)
                            held, size = [], 0
        if total:
            held.append(work())
        if held and sum(len(x[0]) for x in held):
            yield A.sent(held, n, False)

    return run


def _cut(n: int):
    def run(batches):
        held = Held()
        with tempfile.TemporaryDirectory() as folder:
            for batch in batches:
                for who, th, text, places in zip(*(batch.column(i) for i in range(2)), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                    who, th, data = who.as_py(), th.as_py(), text.as_buffer().to_pybytes()
                    for start, count, hot in zip(*(x.tolist() for x in A.opened(places.values.to_numpy())), strict=True):
                        segment = data[start : start + count + WINDOW - 1]
                        if len(segment) >= WINDOW:  # not a place of another text that shares id and low
                            held.add(segment, who, th, start, hot)
                    if held.size >= HELD_BYTES:
                        yield held.blobs(n, folder)
                        held = Held()
            if held.places:
                yield held.blobs(n, folder)

    return run


def _decide(batches):
    parts: dict[int, list] = {}
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = unpacked(blob.as_buffer())
            if len(got) == 4:
                who, th, start, length = got
                yield _span_batch(who, th, start, start + length)
            else:
                parts.setdefault(b, []).append(got)
    with tempfile.TemporaryDirectory() as folder:
        for b in list(parts):
            owner, times, lengths, text, th, start = map(np.concatenate, zip(*parts.pop(b), strict=True))
            times, lengths = times.astype(np.int64), lengths.astype(np.int64)
            begin = offsets(lengths)
            fresh = np.zeros(len(text), bool)
            fresh[begin[:-1]] = True
            gone, _ = judged(text, lengths, owner, folder)
            at, count = runs(gone, fresh)
            if len(at):
                of = np.searchsorted(begin, at, "right") - 1
                places = spread(offsets(times)[:-1][of], times[of])
                low = np.repeat(at - begin[of], times[of]) + start[places].astype(np.int64)
                yield _span_batch(*_merged(np.stack([np.repeat(owner[of], times[of]), th[places], low, low + np.repeat(count + WINDOW - 1, times[of])], axis=1)))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Columns id, th, start, stop with overlapping and touching spans of a document joined."""
    s = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    same = np.zeros(len(s), bool)
    same[1:] = (s[1:, 0] == s[:-1, 0]) & (s[1:, 1] == s[:-1, 1])
    # The furthest stop so far within a document: a running maximum that starts anew, as documents are set apart by an offset.
    doc = np.cumsum(~same)
    gap = int(s[:, 3].max()) + 1
    reach = np.maximum.accumulate(s[:, 3] + doc * gap) - doc * gap
    new = ~same
    new[1:] |= s[1:, 2] > reach[:-1]
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(s)) - 1
    return np.stack([s[first, 0], s[first, 1], s[first, 2], reach[last]])


def _remove(batches):
    for batch in batches:
        rows = []
        for text, whole, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3), strict=True):
            data = text.as_buffer().to_pybytes()
            if whole:
                rows.append((len(data), [{"start": 0, "stop": len(data)}] if data else [], b""))
                continue
            if not spans.as_py():
                rows.append((len(data), [], data))
                continue
            v = spans.values
            start, stop = v.field(0).to_numpy(), v.field(1).to_numpy()
            zero = np.zeros(len(start), np.int64)
            _, _, start, stop = _merged(np.stack([zero, zero, start, stop], axis=1)).tolist()
            kept = b"".join(data[x:y] for x, y in zip([0, *stop], [*start, len(data)], strict=True))
            rows.append((len(data), [{"start": x, "stop": y} for x, y in zip(start, stop, strict=True)], kept))
        n, s, k = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(k, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )


#: Stands for a null id: it is larger than any other.
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, low, th, text): id orders documents; id and a 64-bit text hash name a row's text (it tells rows apart that share an id).

    low is the half of th that travels with anchors. Every join with texts is on id and low, its other side has one row for them and lists
    what belongs to each th, and every join takes these four columns and no other, so that one exchange of the texts serves them all.
    """
    th = F.xxhash64("text")
    return texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), low(th).alias("low"), th.alias("th"), "text")


def low(th: Column) -> Column:
    return th.bitwiseAND(F.lit(0xFFFFFFFF))


def own(listed: str) -> Column:
    """The entries of a list by (id, low) that belong to the row's own th."""
    return F.filter(listed, lambda x: x["th"] == F.col("th"))


def is_lead() -> Column:
    return F.coalesce(F.array_contains("leads", F.col("th")), F.lit(False))


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.nullif("id", F.lit(NO_ID)))


def first_copies(base: DataFrame) -> DataFrame:
    """(id, low, leads array<th>) of the first document of each distinct text; the small side of joins with base."""
    first = base.groupBy(F.unhex(F.sha2("text", 256)).alias("sha")).agg(F.min("id").alias("id"), F.min("th").alias("th"))
    return first.groupBy("id", low(F.col("th")).alias("low")).agg(F.collect_list("th").alias("leads"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans array<struct<start, stop>> (bytes removed, maximal runs), kept (the bytes that stay).

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. Null texts are empty; texts under 50 bytes
    never change. Null ids count as one id larger than all. Rows that repeat an id are each judged by smaller ids only, so they don't
    remove one another. Other columns are not read; no rows give no rows.
    """
    base = keyed(docs, id_col, text_col)
    n = 2 * partitions(docs.sparkSession)
    key = ["id", "low"]
    leads = first_copies(base)
    found = base.join(leads.hint("shuffle_hash"), key).where(is_lead()).select("id", "low", "text").mapInArrow(_find(n), BLOB)
    places = A.gathered(A.repeated_anchors(found, False))
    cut = base.join(places.hint("shuffle_hash"), key).select("id", "th", "text", "places").mapInArrow(_cut(n), BLOB)
    spans = cut.repartition(n, "bucket").mapInArrow(_decide, SPANS).groupBy("id", low(F.col("th")).alias("low")).agg(F.collect_list(F.struct("start", "stop", "th")).alias("spans"))
    whole = ~is_lead() & (F.octet_length("text") >= WINDOW)
    rows = base.join(leads.hint("shuffle_hash"), key, "left").join(spans.hint("shuffle_hash"), key, "left")
    out = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    return named(rows).select("doc_id", "text", whole.alias("whole"), own("spans").alias("spans")).mapInArrow(_remove, out)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM n, unnest(range(0, n - 49)) AS t(i)), f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > least),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS apart FROM r),
k AS (SELECT doc_id, i, sum(apart) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g), spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, k),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans UNION ALL SELECT doc_id, coalesce(b, 0), n FROM n LEFT JOIN (SELECT doc_id, max(b) AS b FROM spans GROUP BY doc_id) USING (doc_id)),
o AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM p JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM n JOIN o USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS m, count(*) AS c FROM spans GROUP BY doc_id) USING (doc_id)
"""
