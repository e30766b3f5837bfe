"""Windows of fixed width that occur more than once, over any number of texts: sampled suffixes and how they are sorted out.

A text is a sequence (bytes or words); a window is `width` consecutive elements of one text. Shipping a suffix for each
element would move the corpus `width` times, so suffixes are sampled by content: the anchor of a window is the leftmost
smallest gram code among its first `reach` grams. Equal windows have equal anchors at equal distance, and the windows of one
anchor are consecutive, so one row stands for a span of windows:

    lead, head   the first bytes, and a code, of what all windows of the span share (a range that starts at the anchor)
    at           place of the first window, count of windows - 1, and distance of the anchor, packed into one number

Equal texts are one text (`distinct_texts`), told by SHA-256. Rows are range-partitioned by splitters that Spark samples and
sorted; equal suffixes may lie in several partitions, so a hot one is never in one task. Codes only say which rows may have something
in common; what goes is decided on the texts' own bytes (`suffix_dedup`, `rlz_dedup`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meshwork.llm.scratch import Scratch
from meshwork.llm.textbytes import NOT_SPACE, U, blocks, eights, mix, pair, range_codes, run_codes, run_lanes, signed, within, word_lanes, words

#: The largest id of a row without one, which sorts it last.
LAST = 2**63 - 1


class Bytes:
    """Texts as bytes: windows of `width` bytes."""

    def __init__(self, width: int = 200):
        self.width, self.gram = width, max(1, min(16, width // 3))
        self.reach = max(1, min(128, (width - self.gram) * 7 // 10))
        self.blocks = [self.reach, 8, 1] if self.reach > 16 else sorted({self.reach, 1}, reverse=True)

    def load(self, data, off):
        self.data, self.first, self.n = data, off, len(data)
        self.view = eights(data)

    def grams(self):
        many, code = self.n - self.gram + 1, U(0x9E3779B97F4A7C15)
        for i in range(0, self.gram, 8):
            chunk, left = self.view[i : i + many], self.gram - i
            code = mix((chunk if left >= 8 else chunk & U((1 << 8 * left) - 1)) * U(0xD6E8FEB86659FD93) ^ code)
        return code

    def leads(self, at, n):
        """The first eight of n bytes as numbers of the same order."""
        got = self.view[at].byteswap()
        if n < 8:
            got = got >> U(64 - 8 * n) << U(64 - 8 * n)
        return signed(got ^ U(1 << 63))

    def codes(self, start, end, seed):
        return range_codes(self.data, start, end, seed, self.view)


class Words:
    """Texts as runs of bytes that aren't white space: windows of `width` words."""

    def __init__(self, width: int = 13, key: int = 0):
        self.width, self.gram, self.key = width, max(1, min(4, width // 3)), key
        self.reach = width - self.gram + 1
        self.blocks = sorted({self.reach, 1}, reverse=True)

    def load(self, data, off):
        self.start, self.end, self.first = words(data, off, NOT_SPACE)
        self.lanes = word_lanes(data, self.start, self.end, self.key)
        self.n = len(self.start)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def grams(self):
        return run_codes(self.lanes[0], self.gram)

    def runs(self, n, lane=0):
        if n not in self.known:
            self.known[n] = run_lanes(self.lanes, n)
        return self.known[n][lane]

    def codes(self, start, end, seed):
        """Spans of no more than two windows' length are told by their first and their last window, which cover them."""
        one = self.runs(self.width)
        return pair(pair(one[start], one[end - self.width]), (end - start).astype(U))


def anchors(grams: np.ndarray, reach: int) -> np.ndarray:
    """For each i the place of the leftmost smallest of grams[i : i+reach]; the place is packed below the code, so that the
    smallest key is also the leftmost."""
    bits = U(max(1, int(len(grams)).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    done = 1
    while done < reach:
        step = min(done, reach - done)
        key = np.minimum(key[:-step], key[step:])
        done += step
    return (key & ((U(1) << bits) - U(1))).astype(np.int64)


def packed(pos, n, off):
    return (pos << 16) | ((n - 1) << 8) | off


def unpacked(at):
    return at >> 16, ((at >> 8) & 255) + 1, at & 255


def sampled(seq) -> tuple[np.ndarray, ...]:
    """Of a loaded block, the spans of windows that share an anchor: (row, first window in the block, count, distance of the anchor)."""
    count = np.maximum(0, np.diff(seq.first) - seq.width + 1)
    row = np.repeat(np.arange(len(count)), count)
    if not len(row):
        return (np.zeros(0, np.int64),) * 4
    anchor = anchors(seq.grams(), seq.reach)
    start = seq.first[row] + within(count)
    own = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    return row[begin], start[begin], np.diff(np.append(begin, len(start))), own[begin] - start[begin]


def in_blocks(row, start, n, off, size: int) -> tuple[np.ndarray, ...]:
    """The spans cut so that the distances from the anchor of one span lie in one block of `size`, and the place that its windows share:
    (row, first window, count, distance, shared place)."""
    low = (off - n + 1) // size
    count = off // size - low + 1
    j = np.repeat(np.arange(len(start)), count)
    b = (np.repeat(low, count) + within(count)) * size
    hi, lo = np.minimum(off[j], b + size - 1), np.maximum((off - n + 1)[j], b)
    anchor = start[j] + off[j]
    return row[j], anchor - hi, hi - lo + 1, hi, anchor - b


def lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """Offsets and values of a column of lists of longs, or of the named fields of lists of structs; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(a.value_lengths().fill_null(0), np.int64)
    flat = a.flatten()
    values = [flat.field(x) for x in fields] if fields else [flat]
    return np.concatenate([[0], np.cumsum(sizes)]), *(np.asarray(v, np.int64) if len(flat) else np.zeros(0, np.int64) for v in values)


def spans_of(kind: type, width: int, size: int, emit: Callable, listed: bool = False) -> Callable:
    """A step over texts (k, text and, if listed, the column `spans` of packed spans): emit(seq, batch, lo, row, start, n, off, shared)
    makes batches of the spans of each block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = kind(width)
        for batch in batches:
            cut, at = lists(batch.column("spans")) if listed else (None, None)
            for lo, hi, data, off in blocks(batch.column("text")):
                if listed and cut[hi] == cut[lo]:
                    continue
                seq.load(data, off)
                if listed:
                    row = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1]))
                    pos, n, dist = unpacked(at[cut[lo] : cut[hi]])
                    got = row, pos + seq.first[row], n, dist
                else:
                    got = sampled(seq)
                if len(got[0]):
                    yield from emit(seq, batch, lo, *in_blocks(*got, size))

    return run


def merged(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [start, start + n) of each row, those that touch joined."""
    order = np.lexsort((start, row))
    row, start, n = row[order], start[order], n[order]
    if not len(row):
        return row, start, n
    shift = (row - row[0]) * (int((start + n).max()) + 2)
    reach = np.maximum.accumulate(start + n + shift)
    new = np.ones(len(row), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(row)) - 1
    return row[begin], start[begin], reach[last] - (start + shift)[begin]


def key_of(text: Column) -> Column:
    """16 bytes of the text's SHA-256; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def order_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def distinct_texts(docs: DataFrame, text: str, doc_id: str, scratch: Scratch) -> DataFrame:
    """(k, c, text, ord, copies): every different text once, with a number, its key, its smallest id and how many rows hold it. Copies
    fall together before the shuffle, so a text that fills a third of the table is no hot key."""
    own = docs.select(key_of(F.col(text)).alias("c"), order_of(F.col(doc_id)).alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one = own.groupBy("c").agg(F.first("text").alias("text"), F.min("ord").alias("ord"), F.count("*").alias("copies"))
    # the numbers are unique in whatever order a task meets its rows, and later steps read the table that is written
    return scratch.save(one.select(F.monotonically_increasing_id().alias("k"), "*"), "texts")


def key_of_table(texts: DataFrame) -> int:
    """A key for codes, from the digests of all texts: the same for the same texts, and not known to who writes one of them."""
    x = F.xxhash64("c")
    r = texts.agg(F.count("*"), F.bit_xor(x), F.sum(x.cast("decimal(20,0)")), F.hex(F.min("c")), F.hex(F.max("c"))).first()
    return int.from_bytes(hashlib.blake2b(str(tuple(r)).encode(), digest_size=8).digest(), "little")


def covered(first: np.ndarray, n_all: int, cut: np.ndarray, pos: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Which elements of a block lie in one of the windows; cut: offsets of each text's spans (first window, count)."""
    row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    start = pos + first[row]
    step = np.bincount(start, minlength=n_all + 1) - np.bincount(start + n + width - 1, minlength=n_all + 1)
    return np.cumsum(step[:n_all]) > 0


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str], most: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, bool]]:
    """Streams a sorted partition as whole groups of equal `names`: (columns, group number of each row, which rows belong to groups that are
    not known whole). A group is not known whole if it touches an end of the partition or has more than `most` rows."""
    held: dict | None = None
    first_key = large_key = None

    def keys(t, i):
        return tuple(t[x][i] for x in names)

    def give(t, final):
        nonlocal large_key
        size = len(t[names[0]])
        new = np.ones(size, bool)
        new[1:] = np.logical_or.reduce([t[x][1:] != t[x][:-1] for x in names])
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        count = np.diff(np.append(begin, size))
        vague = count > most
        vague[0] |= keys(t, 0) in (first_key, large_key)
        vague[-1] |= final or keys(t, -1) == first_key
        large_key = keys(t, -1) if count[-1] > most else None if keys(t, -1) != large_key else large_key
        return t, group, vague[group]

    for batch in batches:
        if not batch.num_rows:
            continue
        t = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in batch.schema.names}
        if held is not None:
            t = {x: np.concatenate([held[x], t[x]]) for x in t}
        if first_key is None:
            first_key = keys(t, 0)
        size = len(t[names[0]])
        same = np.logical_and.reduce([t[x] == t[x][-1] for x in names])
        cut = size - int(np.argmin(same[::-1])) if not same.all() else 0
        if size - cut > most:  # the open group is large already, whatever follows
            yield give(t, False)
            held = None
        elif cut:
            held = {x: t[x][cut:] for x in t}
            yield give({x: t[x][:cut] for x in t}, False)
        else:
            held = t
    if held is not None and len(held[names[0]]):
        yield give(held, True)
