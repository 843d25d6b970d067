"""Which stretches can repeat: window minima as anchors, matched over the whole corpus before any text is moved.

Every window of `window` units (bytes or words) is represented by the least hash among the grams of `gram` units
inside it. Equal windows have equal minima, so a window whose minimum stands nowhere else can't repeat. Successive windows mostly
share a minimum and travel as one anchor (hash, document, start, run of windows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlattice.llm._common import BLOB, blob_batch, by_bucket, mixed, offsets, packed, partitions, spread, unpacked

P = np.uint64(0x9E3779B97F4A7C15)
#: Windows of an anchor at most: text of one repeated symbol would otherwise be a single endless run.
LONGEST_RUN = 64
#: Values that one step of hashing works on.
STRETCH = 1 << 14
#: Anchors that a task holds before it sends them on.
HELD = 1 << 21
#: An anchor with so many holders in one task, or in the bucket of its hash, is hot: its windows are dealt on by more than their anchor.
HOT_IN_TASK, HOT_IN_BUCKET = 32, 1024
#: place is (start * LONGEST_RUN + run - 1) * 2 + hot. Texts under one id may share low, 32 bits of the text hash: each gets the places of all.
CANDIDATES = "id bigint, low bigint, place bigint"


def grams(units: np.ndarray, m: int, p: np.uint64 = P) -> np.ndarray:
    """Polynomial hash of each m successive units along the last axis (64-bit, wrapping), by doubling."""
    h, length = units, 1
    for bit in bin(m)[3:]:
        power = np.uint64(pow(int(p), length, 1 << 64))
        h = h[..., :-length] * power + h[..., length:]
        length *= 2
        if bit == "1":
            h = h[..., :-1] * p + units[..., length : length + h.shape[-1] - 1]
            length += 1
    return h


def gram_hashes(units: np.ndarray, m: int, p: np.uint64 = P, table: np.ndarray | None = None) -> np.ndarray:
    """A well-mixed hash of each m successive units (of table[units], if there is a table), by blocks that stay in a core's cache."""
    n = len(units) - m + 1
    out = np.empty(max(0, n), np.uint64)
    for at in range(0, n, STRETCH):
        part = units[at : at + STRETCH + m - 1]
        out[at : at + STRETCH] = mixed(grams(part if table is None else table[part], m, p))
    return out


def minima(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w successive values."""
    n = len(h) - w + 1
    out = np.empty(max(0, n), h.dtype)
    for at in range(0, n, STRETCH):
        low, k = h[at : at + STRETCH + w - 1], 1
        size = len(low) - w + 1
        while 2 * k <= w:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        out[at : at + STRETCH] = np.minimum(low[:size], low[w - k : w - k + size])
    return out


def anchors(units: np.ndarray, lengths: np.ndarray, window: int, gram: int, table: np.ndarray | None = None, within: bool = True) -> tuple[np.ndarray, ...]:
    """(hash, text, start, run, again) for texts laid end to end; start counts units within a text.

    again (if within): the least gram stands more than once among an anchor's own windows, so that one of them may repeat another.
    """
    none = np.zeros(0, np.int64)
    hashes = gram_hashes(units, gram, table=table)
    low = minima(hashes, window - gram + 1)
    n, begin = len(low), offsets(lengths)
    whole = np.ones(n + 2, bool)  # windows inside one text, between two that are not
    whole[0] = whole[-1] = False
    past = spread(np.maximum(begin[:-1], begin[1:] - window + 1), np.minimum(lengths, window - 1))
    whole[past[past < n] + 1] = False
    if not whole.any():
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    step = np.ones(n + 1, bool)
    step[1:-1] = low[1:] != low[:-1]
    first = np.nonzero(whole[1:-1] & (step[:-1] | ~whole[:-2]))[0]
    run = np.nonzero(whole[1:-1] & (step[1:] | ~whole[2:]))[0] - first + 1
    if (run > LONGEST_RUN).any():
        parts = (run - 1) // LONGEST_RUN + 1
        k = spread(np.zeros(len(parts), np.int64), parts)
        first, run = np.repeat(first, parts) + k * LONGEST_RUN, np.minimum(np.repeat(run, parts) - k * LONGEST_RUN, LONGEST_RUN)
    h, text = low[first], np.searchsorted(begin, first, "right") - 1
    again = np.zeros(len(first), bool)
    if within:
        width = run + window - gram
        equal = hashes[spread(first, width)] == np.repeat(h, width)
        again = np.add.reduceat(equal, offsets(width)[:-1], dtype=np.int64) > 1
    return h, text, first - begin[text], run, again


def _groups(h: np.ndarray, who: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """For values sorted by h: the group of each, and whether a group stands in several documents (within: or several times in one)."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    first = np.nonzero(new)[0]
    if within:
        return group, np.diff(np.append(first, len(h))) > 1
    return group, np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)


def repeated_anchors(found: DataFrame, within: bool) -> DataFrame:
    """CANDIDATES: the anchors whose hash stands more than once in the corpus.

    found: blobs (bucket, packed arrays) from sent(). An anchor that is hot inside one task is decided there; its holders pass by
    a bucket of their own document and one witness goes to the bucket of the hash, so no bucket gathers a common passage, and
    all holders learn alike that it is hot.
    """
    n = 2 * partitions(found.sparkSession)

    def match(batches):
        open_: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = unpacked(blob.as_buffer())
                if len(parts) == 4:
                    yield _candidates(*parts, np.ones(len(parts[0]), np.int64))
                else:
                    open_.setdefault(b, []).append(parts)
        for b in list(open_):
            high, low, who, th, start, run, kind = map(np.concatenate, zip(*open_.pop(b), strict=True))
            h = high.astype(np.uint64) << np.uint64(8) | low
            order = np.argsort(h, kind="stable")
            h, who, th, start, run, kind = (a[order] for a in (h, who, th, start, run, kind))
            group, several = _groups(h, who, within)
            several |= np.bincount(group, kind, len(several)) > 0
            hot = (np.bincount(group, kind == WITNESS, len(several)) > 0) | (np.bincount(group, minlength=len(several)) >= HOT_IN_BUCKET)
            yes = several[group] & (kind != WITNESS)
            yield _candidates(who[yes], th[yes], start[yes], run[yes], hot[group[yes]])

    return found.repartition(n, "bucket").mapInArrow(match, CANDIDATES)


def _candidates(who, th, start, run, hot) -> pa.RecordBatch:
    place = (start.astype(np.int64) * LONGEST_RUN + run - 1) * 2 + hot
    return pa.RecordBatch.from_arrays([pa.array(who), pa.array(th.astype(np.int64)), pa.array(place)], ["id", "low", "place"])


def opened(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, hot) of places, in order of their starts."""
    place = np.sort(place)
    return place // (2 * LONGEST_RUN), place // 2 % LONGEST_RUN + 1, place % 2 > 0


PLAIN, WITNESS, AGAIN = range(3)


def sent(held: list[tuple], n: int, within: bool) -> pa.RecordBatch:
    """Blobs of the anchors (h, id, th, start, run, again) that a task holds.

    Of a hash its first 40 bits travel, beside the bucket that all 64 choose; a chance match only makes a candidate.
    """
    h, who, th, start, run, again = map(np.concatenate, zip(*held, strict=True))
    by_hash = np.argsort(h, kind="stable")
    group, several = _groups(h[by_hash], who[by_hash], within)
    several &= np.bincount(group, minlength=len(several)) >= HOT_IN_TASK
    done = np.empty(len(h), bool)
    done[by_hash] = several[group]
    rest = ~done  # in document order: within a bucket ids and starts rise, and compress
    witness = h[by_hash][np.nonzero(np.append(True, np.diff(group) > 0))[0][several]]
    zero = np.zeros(len(witness), np.int64)
    keys = np.concatenate([h[rest], witness])
    join = lambda a, kind: np.concatenate([a[rest], zero]).astype(kind)
    kind = np.concatenate([np.where(again[rest] & within, AGAIN, PLAIN), zero + WITNESS]).astype(np.uint8)
    columns = [(keys >> np.uint64(32)).astype(np.uint32), (keys >> np.uint64(24)).astype(np.uint8), join(who, np.int64), join(th, np.uint32), join(start, np.uint32), join(run, np.uint8), kind]
    rows = by_bucket((keys % np.uint64(n)).astype(np.int64), n, columns)
    if done.any():
        rows += by_bucket((mixed(who[done].view(np.uint64)) % np.uint64(n)).astype(np.int64), n, [who[done], th[done].astype(np.uint32), start[done].astype(np.uint32), run[done].astype(np.uint8)])
    return blob_batch(rows)


def gathered(candidates: DataFrame) -> DataFrame:
    """(id, low, places array<bigint>): candidates by document; as many as the document has, at most."""
    return candidates.groupBy("id", "low").agg(F.collect_list("place").alias("places"))


__all__ = ["BLOB", "CANDIDATES", "HELD", "anchors", "gathered", "gram_hashes", "grams", "packed", "repeated_anchors", "sent"]
