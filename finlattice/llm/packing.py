"""Hierarchical multi-length packing: context tiers, gaps of long windows filled from shorter tiers, balanced step groups."""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.llm._common import documents, texts

CONTEXT = 2048
#: Context sizes below the longest that remainders are routed to.
SHORTER = (1024, 512, 256)
#: Tokens of documents that are packed together; it bounds a task's memory.
BLOCK_TOKENS = 1 << 21
#: Tokens of a step group.
STEP_TOKENS = 64 * CONTEXT
END = 1
SPECIAL = "<|endoftext|>"
LONG_SPACE = 4096
SPACES = regex.compile(r"\p{White_Space}{%d,}" % LONG_SPACE)


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level vocabulary at path (rank lines); its end-of-text string is one id after them, as in the JSON twin of the file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def token_ids(enc, text: str) -> np.ndarray:
    """Ids of a whole text. Runs of LONG_SPACE white-space characters are cut out first: the pattern's step back from the end of a run is too deep.

    The pattern takes all of a run but its last character as one word, or all where the text or a special string ends it; so does this.
    """
    if len(text) < LONG_SPACE or not (runs := list(SPACES.finditer(text))):
        return enc.encode_to_numpy(text, allowed_special="all")
    out, at = [], 0
    for m in runs:
        stop = m.end() if m.end() == len(text) or text.startswith(SPECIAL, m.end()) else m.end() - 1
        if m.start() > at:
            out.append(enc.encode_to_numpy(text[at : m.start()], allowed_special="all"))
        out.append(np.array(enc._encode_single_piece(text[m.start() : stop]), np.uint32))
        at = stop
    out.append(enc.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(out)


def pack_block(lengths: list[int], context: int = CONTEXT, shorter: tuple[int, ...] = SHORTER) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); every token lies in one piece, and nothing is padded.

    A document gives full windows first. What is left is routed to the smallest context size that holds
    it. Windows of the longest tier take its pieces and fill their gaps from the next shorter tiers (the last piece is cut to
    fit); each shorter tier is then packed in the same way in windows of its own size. What remains
    under the smallest size leaves as sequences of falling powers of two.
    """
    sizes = (context, *sorted(shorter, reverse=True))
    tier: list[deque] = [deque() for _ in sizes]
    out = []
    for d, n in enumerate(lengths):
        full = n - n % context
        out += [[(d, at, context)] for at in range(0, full, context)]
        if n > full:
            tier[max(k for k, s in enumerate(sizes) if n - full <= s)].append((d, full, n - full))
    for k, window in enumerate(sizes):
        while tier[k]:
            room, sequence, source = window, [], k
            while room and source < len(sizes):
                if not tier[source]:
                    source += 1
                    continue
                d, at, n = tier[source].popleft()
                take = min(n, room)
                sequence.append((d, at, take))
                room -= take
                if take < n:
                    tier[max(j for j, s in enumerate(sizes) if n - take <= s)].append((d, at + take, n - take))
            if room:  # nothing is left but this: fall by powers of two
                rest, size = deque(sequence), 1 << (window - room).bit_length() - 1
                while rest:
                    left, part = size, []
                    while left:
                        d, at, n = rest.popleft()
                        take = min(n, left)
                        part.append((d, at, take))
                        left -= take
                        if take < n:
                            rest.appendleft((d, at + take, n - take))
                    out.append(part)
                    size = 1 << max(0, sum(n for *_, n in rest).bit_length() - 1)
            else:
                out.append(sequence)
    return out


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, context int, step_group bigint"


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, context, step_group.

    A document's tokens are those of its whole text and then END, so empty and null texts have one; each row is packed, repeated
    rows and null ids too. Sequences are full windows of 2048 or of a smaller power of two: none needs padding. Every task packs
    the rows it has read, without an exchange; ids of sequences and step groups hold the partition's number, so they're the same
    when a lost task runs again. A step group holds sequences of one context size and STEP_TOKENS tokens, but for the last of a task.
    """

    def run(batches):
        enc, base = encoder(path), TaskContext.get().partitionId() << 36
        state = {"sequence": 0, "step": 0, "fill": {}}

        def flush(names, tokens):
            rows = []
            for sequence in pack_block([len(t) for t in tokens]):
                size = sum(n for *_, n in sequence)
                group, held = state["fill"].get(size, (None, STEP_TOKENS))
                if held + size > STEP_TOKENS:
                    group, held = state["step"], 0
                    state["step"] += 1
                state["fill"][size] = (group, held + size)
                at = 0
                for d, start, n in sequence:
                    rows.append((names[d], start, n, tokens[d][start : start + n].tobytes(), len(tokens[d]), base + state["sequence"], at, size, base + group))
                    at += n
                state["sequence"] += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        names, tokens, held = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                t = np.append(token_ids(enc, text.as_py()), np.uint32(END)).astype("<u4")
                names.append(name.as_py())
                tokens.append(t)
                held += len(t)
                if held >= BLOCK_TOKENS:
                    yield flush(names, tokens)
                    names, tokens, held = [], [], 0
        if tokens:
            yield flush(names, tokens)

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken")))
