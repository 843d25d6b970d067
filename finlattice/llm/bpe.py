"""BPE encoding and decoding: a queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.llm._common import documents, offsets, texts

#: Entries of each generation of a worker's caches.
CACHED = 250_000
#: Rows that go back to Spark at once.
ROWS_OUT = 512
#: Bytes of text that one step encodes, unless a single text is longer.
TEXT_OUT = 16 << 20
#: Words of a normalised text (fixed by the vocabulary file's format).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

#: More than any id.
WIDE = 1 << 20
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is visible Latin-1, else the next code point from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b if b in set(seen) else next(rest)) for b in range(256)]


class Cache(dict):
    """What make() gives for a key, kept for two generations: a full one becomes the old one, and what is asked for again moves up from there."""

    def __init__(self, make, size: int = CACHED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, as a tokenizer's JSON file describes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Rank of each pair of ids (left * WIDE + right), and the id that a merge of that rank gives.
        self.ranks = {self.ids[a] * WIDE + self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.result = [self.ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.strings = pa.array([named.get(i, "") for i in range(max(named) + 1)])
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        alphabet = byte_alphabet()
        self.inner = [self.ids.get(c) for c in alphabet]
        self.last = [self.ids.get(c + self.end) for c in alphabet]
        self.words = Cache(self.merged)
        self.chunks = Cache(self.chunk)

    def merged(self, word: str) -> bytes:
        """Ids of one word. The queue holds rank * n + place; an entry is stale when the pair at its place isn't of that rank any more."""
        data = word.encode()
        symbol = [self.inner[b] for b in data[:-1]]
        symbol.append(self.last[data[-1]])
        if None in symbol:
            symbol = [s for s in symbol if s is not None]
        n, rank_of, result = len(symbol), self.ranks.get, self.result
        queue = [r * n + i for i, (a, b) in enumerate(zip(symbol, symbol[1:], strict=False)) if (r := rank_of(a * WIDE + b)) is not None]
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            rank, i = divmod(heappop(queue), n)
            left, j = symbol[i], after[i]
            if left < 0 or j >= n or rank_of(left * WIDE + symbol[j]) != rank:
                continue
            symbol[i] = new = result[rank]
            symbol[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new * WIDE + symbol[k])) is not None:
                    heappush(queue, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbol[h] * WIDE + new)) is not None:
                heappush(queue, r * n + h)
        return array("i", [s for s in symbol if s >= 0]).tobytes()

    def chunk(self, text: str) -> bytes:
        """Ids (32-bit) of a stretch of text without special tokens."""
        text = unicodedata.normalize("NFC", text)
        # Lower case goes character by character: a final sigma isn't special.
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return b"".join(map(self.words.__getitem__, WORD.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, 32 bits each, end to end."""
        if "<|" not in text and not SEPARATORS.search(text):
            return b"".join(map(self.chunks.__getitem__, text.split()))
        out = []
        for piece in self.split.split(text):
            if piece in self.special:
                out.append(np.int32(self.special[piece]).tobytes())
            elif SEPARATORS.search(piece):  # Python's white space, but not the vocabulary's
                out.append(self.chunk(piece))
            else:  # no word reaches across white space, so what stands between is looked up whole
                out += map(self.chunks.__getitem__, piece.split())
        return b"".join(out)

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """Vocabulary strings one after another; the file names no decoder, so a space stands between two. Null and unknown ids are passed over."""
        # Ids as the batch slices them: neither the array's own offset nor lists that are null count.
        ids = pa.ListArray.from_arrays(pa.array(offsets(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()).astype(np.int32)), ids.flatten())
        flat = ids.values
        known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.strings))), False)
        if not pc.all(known).as_py():
            mask = known.to_numpy(zero_copy_only=False)
            ends = offsets(mask.astype(np.int64))[ids.offsets.to_numpy()]
            ids, flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(known)), flat.filter(known)
        strings = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), self.strings.take(flat))
        return pc.binary_join(strings, " ").cast(pa.string())


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(v: Vocabulary, text: pa.Array) -> pa.ListArray:
    lists = [v.encode(s or "") for s in text.to_pylist()]
    ends = offsets(np.array([len(x) for x in lists], np.int64)) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(lists), np.int32)))


def _slices(batches):
    """Batches of at most ROWS_OUT rows and about TEXT_OUT bytes, but for a row that is larger by itself."""
    for batch in batches:
        at, n = 0, batch.num_rows
        size = offsets(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)) if pa.types.is_string(batch.schema.types[1]) else None
        while at < n:
            stop = min(n, at + ROWS_OUT)
            if size is not None:
                stop = min(stop, max(at + 1, int(np.searchsorted(size, size[at] + TEXT_OUT, "right")) - 1))
            yield batch.slice(at, stop - at)
            at = stop


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text; null and empty texts have no ids, and every row, repeated ones too, gets a row.

    path: the vocabulary file on each machine. Only the two named columns are read.
    """

    def run(batches):
        v = vocabulary(path)
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), encoded(v, part.column(1))], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded string) from rows (doc_id, ids); null ids decode as none, and ids that the vocabulary lacks are passed over."""

    def run(batches):
        v = vocabulary(path)
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), v.decode(part.column(1))], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): encode() and then decode(), in one pass over each batch."""

    def run(batches):
        v = vocabulary(path)
        for part in _slices(batches):
            ids = encoded(v, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), ids, v.decode(ids)], ["doc_id", "ids", "decoded"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return round_trip(documents(spark, sf_dir), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
