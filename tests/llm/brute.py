"""Plain versions of the operators, and a small corpus with the odd cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SPACE, WORD = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, ord long, size long, spans string"


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    """Random texts with exact and near copies, a common passage, repeated rows, nulls, empty and long texts; the last four columns
    clash with names that the operators use."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"wörd{i}" if i % 5 == 0 else f"w{i}" for i in range(400)]
    text = lambda m: " ".join(rng.choice(vocabulary) for _ in range(m))
    passage = text(60)
    out = [text(rng.randint(1, 120)) for _ in range(n)]
    for i in range(0, n, 3):
        out[i] = out[i] + "\n" + passage + " " + text(5)
    for i in range(1, n, 5):
        words = out[i - 1].split(" ")
        words[len(words) // 2] = "other"
        out[i] = " ".join(words)
    out[7] = out[8]
    out[9] = text(3000)
    out[10] = out[9][:9000] + " end"
    out[11] = "ab " * 300
    out[12], out[13], out[14], out[15], out[16] = None, "", "  \n ", "one two", "one two"
    out[17] = "Released under the MIT License. " + text(20) + " licensed under the Apache License, Version 2.0. General Public License, version 3"
    out[18] = "Licensed under CC BY-NC 4.0."
    ids = list(range(3, 3 + n))
    ids[20], ids[21] = None, None
    rows = [(i, t, "en", None if j % 11 == 0 else f"s{j % 4}" if j % 2 else "hot", j, 1, 2, 3, "x") for j, (i, t) in enumerate(zip(ids, out, strict=True))]
    rows.append(rows[5])  # a repeated row
    rng.shuffle(rows)
    return rows


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def suffix(rows, width):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for r, b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append((r[0], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def rlz(rows, width):
    order = lambda r: 2**63 - 1 if r[0] is None else r[0]
    first: dict = {}
    for r in rows:
        ws = SPACE.findall(r[1] or "")
        for i in range(len(ws) - width + 1):
            key = tuple(ws[i : i + width])
            first[key] = min(first.get(key, 2**63), order(r))
    out = []
    for r in rows:
        ws = SPACE.findall(r[1] or "")
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < order(r):
                gone[i : i + width] = [True] * width
        out.append((r[0], len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone, strict=True) if not g).encode())))
    return out


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def jaccard(rows, n, least):
    """(id, class, links, copies) by all pairs."""
    def shingles(t):
        ws = SPACE.findall(t or "")
        return frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))) if ws else None

    sets = [shingles(r[1]) for r in rows]
    distinct = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    near = {s: [t for t in distinct if t is not s and len(s & t) >= least * len(s | t)] for s in distinct}
    root = {s: i for i, s in enumerate(distinct)}
    for _ in distinct:
        for s in distinct:
            for t in near[s]:
                root[s] = root[t] = min(root[s], root[t])
    ids: dict = {}
    for r, s in zip(rows, sets, strict=True):
        if s and r[0] is not None:
            ids[root[s]] = min(ids.get(root[s], 2**63), r[0])
    copies = Counter(s for s in sets if s)
    return [(r[0], ids.get(root[s]) if s else r[0], len(near[s]) if s else 0, copies[s] if s else 1) for r, s in zip(rows, sets, strict=True)]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, [(x is None, str(x)) for x in r]))
