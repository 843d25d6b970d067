"""Plain versions of what the operators must return, over small lists of rows."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def byte_repeats(rows, width=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] for rows (doc_id, text); null ids last, equal ids don't remove one another."""
    first: dict[bytes, float] = {}
    data = [(float("inf") if i is None else i, i, (t or "").encode()) for i, t in rows]
    for order, _, b in data:
        for k in range(len(b) - width + 1):
            first[b[k : k + width]] = min(order, first.get(b[k : k + width], order))
    out = []
    for order, i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < order:
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), sha(kept)))
    return out


def word_repeats(rows, width=20):
    """[(doc_id, n_words, n_removed, kept_sha256)]; ids must be distinct, or their texts equal."""
    seen: dict[tuple, tuple] = {}
    out = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = WORD.findall(t or "")
        gone = [0] * len(w)
        for k in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[k : k + width]), (i, k)) != (i, k):
                gone[k : k + width] = [1] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def simhash(text) -> int:
    w = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    """Least node of each one's component."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def secrets(text):
    """[(start, kind, end)] of the base kinds."""
    fold = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
    key = "|".join([*(fold(w) for w in ("password", "passwd", "secret", "token")), fold("api") + "_?" + fold("key")])
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def toxic_evidence(text, lexicon, lists, marks, numbers):
    """(sum of clause scores, greatest, clauses with any), each head looked at by itself. lists: threats, objects, targets, negations, reports."""
    threats, objects, targets, negations, reports = lists
    threat_weight, full, alone, negated, reported = numbers
    clauses, now = [], []
    for line in (text or "").split("\n"):
        for raw in line.split():
            if w := raw.strip(marks).lower():
                now.append(w)
            if raw[-1] in ".!?;:|":
                clauses.append(now)
                now = []
        clauses.append(now)
        now = []
    scores = []
    for c in clauses:
        score = 0.0
        kinds = ["I" if w in lexicon else "T" if w in threats else "Q" if w in objects else "P" if w in targets else "N" if w in negations else "R" if w in reports else "" for w in c]
        near = lambda i, kind, before, after, k=kinds: any(x and x in kind for x in k[max(0, i - before) : i] + k[i + 1 : i + 1 + after])
        for i, w in enumerate(c):
            if kinds[i] not in ("I", "T"):
                continue
            if kinds[i] == "I":
                pays = lexicon[w] * (full if near(i, "PQ", 6, 6) else alone)
            else:
                pays = threat_weight * full * (near(i, "Q", 3, 0) or near(i, "PQ", 0, 3))
            score += pays * (negated if near(i, "N", 4, 4) else 1) * (reported if "R" in kinds else 1)
        scores.append(score)
    hit = [x for x in scores if x]
    return sum(hit), max(hit, default=0.0), len(hit)
