"""Spelling variants: words that differ by one code point, found by range reporting over two sorted orders.

Words are Latin letters, so a code point is a byte in Latin-1 and byte order is code-point order. For an edit at place p of a word, words that share what
stands before p are an interval of the forward order (words sorted), words that share what stands after it an interval of the reverse order (words sorted from
their ends); the near words are the points of a wavelet tree in both. Spark range-partitions the words twice, by sampled splitters of the forward and of the
reverse order, into blocks of about `BLOCK_BYTES`. A word asks the forward blocks for the places from p0 on and the reverse blocks for those before it; p0 is
the place from which the words that share its beginning span no more blocks than those that share its end. Words of one length are a tree of their own: a word asks that of its own
length for replaced code points, and the next for inserted ones; a deleted one is the same pair seen from the other word.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshwork.llm.scratch import Scratch
from meshwork.llm.textbytes import blocks, word_array
from meshwork.llm.wavelet import WaveletTree

#: The contract's fixed values: words have 7 code points and 2 occurrences at least, a form is 10 times as frequent, one run in 31 loses a code point.
SHORTEST, FEWEST, TIMES, DAMAGED = 7, 2, 10, 31
#: Bytes of a block (a word has at least `NARROW`, or the power of two that holds it), and words that splitters are sampled from, for each block.
BLOCK_BYTES, NARROW, SAMPLE = 1 << 20, 32, 8
POLYNOMIAL = 0xEDB88320


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


TABLE = crc_table()
LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)], bool)
LOWERED = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def crc_of_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of byte ranges that follow texts whose crc32 is `before`: a byte of all ranges at a time."""
    state = before ^ np.uint32(0xFFFFFFFF)
    live, at = np.arange(len(start)), start.copy()
    many = end - start
    for i in range(int(min(many.max(initial=0), 64))):
        live = live[many[live] > i]
        s = state[live]
        state[live] = TABLE[(s ^ data[at[live] + i]) & 0xFF] ^ (s >> np.uint32(8))
    for j in np.flatnonzero(many > 64).tolist():
        state[j] = zlib.crc32(data[start[j] + 64 : end[j]], int(state[j]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state ^ np.uint32(0xFFFFFFFF)


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal runs of letters; C3 and the byte after it are a letter of two bytes."""
    inside = LETTER[data]
    lead = np.flatnonzero(data == 0xC3)
    inside[lead] = True
    inside[lead + 1] = True
    edge = np.zeros(len(data) + 1, np.int8)
    edge[1:-1] = inside[1:].view(np.int8) - inside[:-1].view(np.int8)
    begin = edge[:-1] == 1
    stop = edge == -1
    if len(data):
        begin[0], stop[-1] = inside[0], inside[-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut - 1]]
    begin[cut], stop[cut] = True, True
    start = np.flatnonzero(begin)
    return np.searchsorted(off, start, "right") - 1, start, np.flatnonzero(stop)


def words_of(docs: DataFrame, id_col: str, text_col: str, shortest: int, damaged: int) -> DataFrame:
    """(word, n) of the runs of each Arrow batch, counted there; words of at least `shortest` code points."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in blocks(batch.column(1), 4 << 20):
                data = LOWERED[raw]
                text, start, end = letter_runs(data, off)
                points = np.zeros(len(data) + 1, np.int32)
                np.cumsum((data & 0xC0) != 0x80, out=points[1:])
                length = points[end] - points[start]
                keep = length >= shortest
                text, start, end, length = text[keep], start[keep], end[keep], length[keep]
                if not len(text):
                    continue
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
                h = crc_of_ranges(data, start, end, prefix[text])
                hit = h % damaged == 0
                column = word_array(data, start[~hit], end[~hit]).dictionary_encode()
                n = np.bincount(column.indices.to_numpy(), minlength=len(column.dictionary)) if len(column) else np.zeros(0, np.int64)
                out = dict(zip(column.dictionary.to_pylist(), n.tolist(), strict=True))
                for s, e, k in zip(start[hit].tolist(), end[hit].tolist(), (h[hit] % length[hit]).tolist(), strict=True):
                    word = data[s:e].tobytes().decode()
                    if len(word) > shortest:
                        word = (word[:k] + word[k + 1 :]).encode()
                        out[word] = out.get(word, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def latin(words: list[str], width: int) -> np.ndarray:
    """A row of bytes for each word, zeros after its end."""
    return np.array([w.encode("latin-1") for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)


def sort_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and, in that order, how many leading bytes each shares with the one before (the first none)."""
    width = rows.shape[1]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    s = rows[order]
    shared = np.zeros(len(s), np.int64)
    for lo in range(1, len(s), max(1, (1 << 24) // width)):
        hi = min(len(s), lo + max(1, (1 << 24) // width))
        differs = s[lo:hi] != s[lo - 1 : hi - 1]
        shared[lo:hi] = np.where(differs.any(1), differs.argmax(1), width)
    return order, shared


def reversed_rows(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    column = length[:, None] - 1 - np.arange(rows.shape[1])[None, :]
    return np.where(column >= 0, np.take_along_axis(rows, np.maximum(column, 0), 1), 0).astype(np.uint8)


class Order:
    """Words of a block and those that ask it, sorted together, with the words of the block counted along."""

    def __init__(self, rows: np.ndarray, own: np.ndarray):
        self.order, self.shared = sort_rows(rows)
        self.rank = np.empty(len(rows), np.int64)
        self.rank[self.order] = np.arange(len(rows))
        self.count = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(own[self.order], out=self.count[1:])

    def interval(self, who: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Of the block's words only: the interval of those that share the first `depth` bytes with each of these."""
        lo, hi = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
        depth = np.broadcast_to(depth, len(who))
        for d in np.unique(depth).tolist():
            at = np.flatnonzero(depth == d)
            edge = np.concatenate([[0], 1 + np.flatnonzero(self.shared[1:] < d), [len(self.shared)]])
            i = np.searchsorted(edge, self.rank[who[at]], "right")
            lo[at], hi[at] = self.count[edge[i - 1]], self.count[edge[i]]
        return lo, hi


def near_in_block(rows: np.ndarray, length: np.ndarray, own: np.ndarray, p0: np.ndarray, target: int, backward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asking word, near word) for the rows of one block, and each row's rank in code-point order. `own` marks the block's words, all of length `target`;
    rows with p0 >= 0 ask, for edits at their place p0 or later in the direction in which the block is sorted (backward: rows are the words read from
    their ends). The first place, read forward, where a word and a longer one differ is the pair's only place, so that it is told once."""
    first, other = Order(rows, own), Order(reversed_rows(rows, length), own)
    mine = np.flatnonzero(own)
    in_first = mine[np.argsort(first.rank[mine])]
    value = np.empty(len(rows), np.int64)
    value[mine[np.argsort(other.rank[mine])]] = np.arange(len(mine))
    tree = WaveletTree(value[in_first])
    inserted = target - length
    deepest = np.minimum(np.maximum(first.shared, np.append(first.shared[1:], 0))[first.rank], target - 1)
    askers = np.flatnonzero((p0 >= 0) & (deepest >= p0))
    left, right = [], []
    for depth in range(int(p0[askers].min(initial=1 << 40)), int(deepest[askers].max(initial=-1)) + 1):
        live = askers[(p0[askers] <= depth) & (deepest[askers] >= depth)]
        lo, hi = first.interval(live, depth)
        some = hi - lo > own[live]  # a word of the block always finds itself
        live, lo, hi = live[some], lo[some], hi[some]
        low, high = other.interval(live, target - 1 - depth)
        ask, place = tree.report(lo, hi, low, high)
        a, b = live[ask], in_first[place]
        at = depth - inserted[a] if backward else np.full(len(a), depth)
        end = (at < 0) | (at >= rows.shape[1])
        ok = end | (rows[a, np.where(end, 0, at)] != rows[b, depth])
        left.append(a[ok])
        right.append(b[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), (other if backward else first).rank


def width_of(length: int) -> int:
    return max(NARROW, 1 << (length - 1).bit_length())


def shares(rows: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, most leading bytes shared with a splitter beside it) of each row."""
    width = rows.shape[1]
    block = np.searchsorted(splits, np.ascontiguousarray(rows).view(f"S{width}").ravel(), "right")
    most = np.zeros(len(rows), np.int64)
    table = np.ascontiguousarray(splits).view(np.uint8).reshape(len(splits), width)
    for side in (block - 1, block):
        has = (side >= 0) & (side < len(splits))
        differs = rows[has] != table[side[has]]
        most[has] = np.maximum(most[has], np.where(differs.any(1), differs.argmax(1), width))
    return block, most


def spanned(splits: list[bytes], prefix: bytes) -> range:
    """Blocks that may hold words that begin so."""
    return range(bisect_right(splits, prefix), bisect_right(splits, prefix, key=lambda s: s[: len(prefix)]) + 1)


def routed(words: DataFrame, splits: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """A row for each block that holds a word or that it asks: target length, direction, block, word, n, whether the block holds it, first place it asks
    for (-1: none)."""
    lists = {t: (f.tolist(), r.tolist()) for t, (f, r) in splits.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            out = []
            for size in np.unique(lengths).tolist():
                who = np.flatnonzero(lengths == size)
                for target in (size, size + 1):
                    if target not in splits:
                        continue
                    ask_all(out, texts[who], who, size, target)
            if out:
                t, d, b, w, o, p = (np.concatenate([o[i] for o in out]) for i in range(6))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (t, d, b)] + [pa.array(texts[w], pa.string())] + [pa.array(c) for c in (n[w], o, p)], names=list(ROUTED))

    def ask_all(out: list, texts: np.ndarray, who: np.ndarray, size: int, target: int) -> None:
        inserted, own = target - size, target == size
        rows = latin(texts.tolist(), width_of(target))
        ends = reversed_rows(rows, np.full(len(rows), size))
        (front, shared), (back, shared_back) = shares(rows, splits[target][0]), shares(ends, splits[target][1])
        # places from `first` on have one block forward, those before `last` one backward
        first, last = shared + 1, size + inserted - shared_back - 1
        p0 = np.clip((size + 1) // 2, np.minimum(first, last), np.maximum(first, last))
        hot = np.flatnonzero(first > last)
        if target in lists and len(hot):
            f, r = lists[target]
            for i in hot.tolist():
                word, p = texts[i].encode("latin-1"), max(0, int(last[i]))
                while p < first[i] and p < size and len(spanned(f, word[:p])) > len(spanned(r, word[p + 1 - inserted :][::-1])):
                    p += 1
                p0[i] = p
        for d, block, start in ((0, front, p0), (1, back, size - p0 + inserted)):
            many = np.zeros(len(who), bool)
            for i in np.flatnonzero(start <= (shared, shared_back)[d]).tolist():
                word = texts[i].encode("latin-1")
                over = spanned(lists[target][d], (word, word[::-1])[d][: max(0, int(start[i]))])
                many[i] = True
                b = np.array(over)
                out.append((np.full(len(b), target), np.full(len(b), d), b, np.full(len(b), who[i]), (b == block[i]) & own, np.full(len(b), max(0, int(start[i])))))
            one = ~many
            k = int(one.sum())
            out.append((np.full(k, target), np.full(k, d), block[one], who[one], np.full(k, own), start[one]))

    return words.mapInArrow(route, ", ".join(f"{k} {v}" for k, v in ROUTED.items()))


ROUTED = {"target": "long", "dir": "long", "block": "long", "word": "string", "n": "long", "own": "boolean", "p0": "long"}
FOUND = "word string, n_near long, best_n long, best string"


def find(routes: DataFrame) -> DataFrame:
    """For each word and block, how many near words it has there and the most frequent of them."""

    def block(key: tuple, group: pa.Table) -> pa.Table:
        texts = group["word"].to_pylist()
        n, own = group["n"].to_numpy(), group["own"].to_numpy()
        target, backward = key[0].as_py(), key[1].as_py() == 1
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        rows = latin(texts, width_of(target))
        if backward:
            rows = reversed_rows(rows, length)
        a, b, rank = near_in_block(rows, length, own, group["p0"].to_numpy(), target, backward)
        longer = length[a] < target
        a, b = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else a
        count = np.diff(np.append(begin, len(a)))
        names = np.array(texts, object)
        return pa.table({"word": pa.array(names[a[begin]], pa.string()), "n_near": count, "best_n": n[b[begin]], "best": pa.array(names[b[begin]], pa.string())})

    return routes.groupBy("target", "dir", "block").applyInArrow(block, FOUND)


def splitters(words: DataFrame, block_bytes: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length that words have, what parts its blocks in both orders. The driver sees a row for each length, and `SAMPLE` words a block, picked by
    hash, of lengths that need more than one. Words that ask count as those that are asked, so both are spread."""
    rows = {r["size"]: r["count"] for r in words.groupBy(F.length("word").alias("size")).count().collect()}
    blocks_of = {t: -(-(rows[t] + rows.get(t - 1, 0)) * width_of(t) // block_bytes) for t in rows}
    empty = {t: (np.zeros(0, f"S{width_of(t)}"),) * 2 for t in rows}
    rate = {}
    for t, k in blocks_of.items():
        if k > 1:
            for size in (t, t - 1):
                if rows.get(size):
                    rate[size] = max(rate.get(size, 0), SAMPLE * k / (rows[t] + rows.get(t - 1, 0)))
    if not rate:
        return empty
    wanted = F.lit(False)
    for size, share in rate.items():
        wanted = wanted | ((F.length("word") == size) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))))
    sample: dict[int, list[bytes]] = {}
    for r in words.where(wanted).select("word").collect():
        sample.setdefault(len(r["word"]), []).append(r["word"].encode("latin-1"))
    out = dict(empty)
    for t, k in blocks_of.items():
        both = sample.get(t, []) + sample.get(t - 1, [])
        if k > 1 and both:
            at = np.linspace(0, len(both), k + 1)[1:-1].astype(int)
            out[t] = tuple(np.unique(np.array(sorted(o), f"S{width_of(t)}")[at]) for o in (both, [w[::-1] for w in both]))
    return out


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = SHORTEST,
    fewest: int = FEWEST,
    times: int = TIMES,
    damaged: int = DAMAGED,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each distinct word.

    A null text has no words; a null id is an empty string where runs are hashed; rows that repeat count as often as they stand; an empty table has no
    rows. Ties between near words go to the smaller in code-point order. Words of any length are compared whole. Other columns of `docs` aren't read.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(words_of(docs, id_col, text_col, shortest, damaged).where(F.col("n") >= fewest), "words")
    routes = routed(words, splitters(words, block_bytes))
    none = [F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")]
    rows = words.select("word", "n", *none).unionByName(find(routes).withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))))
    near = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    enough = -F.col("b.less") >= times * F.col("n")
    near = scratch.save(near.select("word", F.when(enough, F.col("b.form")).alias("form"), "n", "n_near", F.when(enough, -F.col("b.less")).alias("form_n")), "near")
    # a form is `times` as frequent as its word, so chains are short; each round doubles the step
    most = near.agg(F.max("n")).first()[0] or fewest
    longest = math.log(max(most / fewest, 1), times) if times > 1 else 64
    up = near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(longest, 1))))):
        up = scratch.save(up, "up")
        over = up.select(F.col("word").alias("root"), F.col("root").alias("over"))
        up = up.join(over, "root", "left").select("word", F.coalesce("over", "root").alias("root"))
    return near.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
