"""Texts as bytes in numpy: blocks of an Arrow column, words, and hashes of any range of a sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK = 1 << 18


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and len+1 offsets into them; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if a.null_count:
        a = pc.fill_null(a, "")
    a = a.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64, len(a) + 1 + a.offset)[a.offset :] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `limit` bytes; a longer text is a run of its own."""
    raw, off = text_bytes(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which each bit of the input moves about half of the output's."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


#: Words and ranges longer than this are coded by a library digest, shorter ones eight bytes at a time.
LONG = 512


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros follow the end); a view, so only what is picked is read."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def range_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, view: np.ndarray | None = None) -> np.ndarray:
    """64-bit codes of the byte ranges [start, end): eight bytes after the other go through a bijection that is no sum or
    product of them. Equal ranges have equal codes; unequal ones can be made to have one (eight bytes undo the eight before), so these codes only propose."""
    view = eights(data) if view is None else view
    size = end - start
    code = mix(size.astype(U) + U((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64))
    live, at, left = slice(None), start, size
    for i in range(0, min(int(size.max(initial=0)), LONG), 8):
        if len(left) and left.min() <= 0:
            live = np.flatnonzero((size > i) & (size <= LONG))
            at, left = start[live] + i, size[live] - i
        chunk = view[at]
        short = left < 8
        if short.any():
            keep = (U(1) << (np.clip(left, 0, 7) * 8).astype(U)) - U(1)
            chunk = np.where(short, chunk & keep, chunk)
        code[live] = mix((code[live] ^ chunk) * U(0xD6E8FEB86659FD93) + U(i + 1))
        at, left = at + 8, left - 8
    for j in np.flatnonzero(size > LONG).tolist():
        raw = data[start[j] : end[j]].tobytes()
        code[j] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return code


def word_array(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as a column of their own (ranges in order, none empty or overlapping)."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    data = raw[np.cumsum(edge[:-1], dtype=np.int8).view(bool)] if len(raw) else raw
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def _keys(key: int, n: int) -> list[np.uint64]:
    """Round constants of a key."""
    raw = hashlib.blake2b(key.to_bytes(8, "little"), digest_size=8 * n).digest()
    return [U(int.from_bytes(raw[8 * i : 8 * i + 8], "little")) for i in range(n)]


_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
#: Words of so many bytes at most have codes of their own.
SHORT = 15


def word_lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Two codes of each byte range, for where codes decide and nothing compares bytes afterwards. Ranges of up to 15 bytes are, with their size, 16 bytes that a
    keyed bijection scrambles, so no two have the same pair of codes; longer ones are told by 120 bits of BLAKE2b, marked by a size that no short one has."""
    size = end - start
    view = eights(data)
    top = len(data)
    b = view[np.minimum(start + 8, top)] & _LOW[np.clip(size - 8, 0, 8)] | np.minimum(size, 255).astype(U) << U(56)
    a = view[start] & _LOW[np.clip(size, 0, 8)]
    salt = key.to_bytes(8, "little")
    for j in np.flatnonzero(size > SHORT).tolist():
        digest = hashlib.blake2b(data[start[j] : end[j]].tobytes(), digest_size=16, salt=salt).digest()
        a[j], b[j] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:15] + b"\xff", "little")
    for k in _keys(key, 3):
        a, b = b, a ^ mix(b + k)
    return a, b


def run_lanes(lanes: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two codes of each run of n words, each made from both codes of the words."""
    a, b = run_codes(lanes[0], n), run_codes(lanes[1] ^ U(0x94D049BB133111EB), n)
    return mix(a ^ mix(b + U(0xBF58476D1CE4E5B9))), mix(b ^ mix(a + U(0x9E6C63D0876A9A63)))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0xC2B2AE3D27D4EB4F) + mix(b ^ U(0x165667B19E3779F9)))


def run_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of all runs of n consecutive codes, by a tree of pairs."""
    total = len(codes) - n + 1
    if total <= 0:
        return np.zeros(0, U)
    out, have, part, size, rest = None, 0, codes, 1, n
    while True:
        if rest & 1:
            out = part if out is None else pair(out[: len(part) - have], part[have:])
            have += size
        rest >>= 1
        if not rest:
            return out[:total]
        part = pair(part[:-size], part[size:])
        size *= 2


def _lut(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], bool)


#: Words of contracts. NOT_SPACE: everything but space, tab, line feed, vertical tab, form feed, return.
NOT_SPACE = _lut(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Everything but 00-2F, 3A-60, 7B-7F; upper-case ASCII is lowered before.
ALNUM = _lut(lambda b: not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F))
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of `inside` bytes, which end at a text's end, and for each text the
    offset of its first word (len+1)."""
    w = inside[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    begin, stop = w.copy(), w.copy()
    begin[1:] &= ~w[:-1]
    stop[:-1] &= ~w[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] = w[edge]
    stop[edge - 1] = w[edge - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(start, off)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. counts[0]-1, 0, 1, .. for each count."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
