"""Suffix-array dedup: every byte covered by a 200-byte string that also starts anywhere else goes.

1. Suffixes are sampled by content (`repeats`), one for each span of windows with the same anchor. Splitters that Spark samples
   range-partition them by their leading bytes. Runs of equal heads are counted there: what stands alone is done with.
2. Suffixes of short runs fetch their bytes, are range-partitioned again and sorted in their bucket by a multikey quicksort, once by
   what follows the anchor and once by what precedes it, with the lengths of the prefixes that neighbours share. A window at
   distance d from its anchor is repeated if another suffix shares `width - d` bytes behind the anchor and d before it, which are
   runs of the two orders.
3. Runs that are long, or touch an end of their partition, aren't compared in one task. Their spans get a 128-bit digest of all their bytes; those of equal
   digest are repeated, and only one of them goes on. What is left is cut into smaller blocks of windows, whose heads are longer, and at
   last into single windows; the few at the ends of partitions are compared with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshwork.llm.repeats import Bytes, covered, distinct_texts, groups_of, key_of, lists, merged, packed, spans_of, unpacked
from meshwork.llm.scratch import Scratch, n_parts
from meshwork.llm.textbytes import U, blocks, signed

WIDTH = 200
#: Runs of more suffixes than this are cut finer instead of being compared in one task; suffixes that are compared at a time.
MOST, CHUNK = 4096, 16384
#: About so many suffixes share a bucket.
PER_BUCKET = 400_000
#: What a step says of a row: windows that are repeated (at: first window and count), suffix to compare, suffix to cut finer, window at a partition's end.
DONE, SHORT, FINER, END = 0, 1, 2, 3
SAID = "kind int, size int, lead long, head long, first long, second long, k long, at long"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _within_text(seq: Bytes, row, start, n, off):
    """Spans of one text with the same bytes are one suffix; their windows are repeated. Returns (spans that stay, repeated ones)."""
    code = seq.codes(start, start + n + seq.width - 1, 12)
    order = np.lexsort((start, code, row))
    r, c, s, m = row[order], code[order], start[order], n[order]
    same = np.zeros(len(order), bool)
    same[1:] = (r[1:] == r[:-1]) & (c[1:] == c[:-1]) & (m[1:] == m[:-1])
    if not same.any():
        return np.ones(len(row), bool), np.zeros(len(row), bool)
    raw, head = seq.data.tobytes(), 0
    for i in np.flatnonzero(same).tolist():
        if not same[i - 1]:
            head = i - 1
        a, b, size = int(s[head]), int(s[i]), int(m[i]) + seq.width - 1
        if raw[a : a + size] != raw[b : b + size]:
            same[i] = False
    more = same.copy()
    more[:-1] |= same[1:]
    stay, done = np.zeros(len(row), bool), np.zeros(len(row), bool)
    stay[order], done[order] = ~same, more
    return stay, done


def _done(k, pos, n) -> pa.RecordBatch:
    zero = np.zeros(len(k), np.int64)
    return _batch(SAID, np.full(len(k), DONE, np.int32), zero.astype(np.int32), n, zero, zero, zero, k, pos)


def _suffixes(size: int, digest: bool):
    """Rows of the spans, with a digest of all their bytes (first, second) if asked. Windows repeated in their own text are told at once."""

    def emit(seq: Bytes, batch, lo, row, start, n, off, shared):
        first, k = seq.first, np.asarray(batch.column("k"), np.int64)
        stay, done = _within_text(seq, row, start, n, off)
        if done.any():
            r, s, m = merged(row[done], start[done], n[done])
            yield _done(k[r + lo], s - first[r], m)
            row, start, n, off, shared = (x[stay] for x in (row, start, n, off, shared))
        all_of_it = np.zeros((len(row), 2), np.int64)
        if digest:
            raw = seq.data.tobytes()
            ends = (start + n + seq.width - 1).tolist()
            all_of_it = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), ends, strict=True)), np.int64).reshape(-1, 2)
        lead, head = seq.leads(shared, seq.width - size + 1), signed(seq.codes(shared, shared + seq.width - size + 1, 14))
        yield _batch(SAID, np.full(len(row), FINER, np.int32), np.full(len(row), size, np.int32), lead, head, all_of_it[:, 0], all_of_it[:, 1], k[row + lo], packed(start - first[row], n, off))

    return emit


def _sifted(size: int, digest: bool):
    """Of a sorted partition: suffixes of equal digest are repeated, and one of them goes on; what stands alone goes; suffixes of short runs are to be
    compared, others cut finer. Of a run of single windows at a partition's end one tells the other end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group, vague in groups_of(batches, ["lead", "head"], MOST):
            size_of = len(group)
            on = np.ones(size_of, bool)
            if digest:
                on[1:] = (group[1:] != group[:-1]) | (t["first"][1:] != t["first"][:-1]) | (t["second"][1:] != t["second"][:-1])
                cls = np.cumsum(on) - 1
                alike = np.bincount(cls)[cls] > 1
                pos, n, _ = unpacked(t["at"][alike])
                yield _done(t["k"][alike], pos, n)
            out = lambda kind, keep: _batch(SAID, np.full(int(keep.sum()), kind, np.int32), *(t[x][keep] for x in ("size", "lead", "head", "first", "second", "k", "at")))  # noqa: E731, B023
            if size > 1:
                yield out(FINER, vague & on)
                yield out(SHORT, ~vague & on & (np.bincount(group, on)[group] > 1))
            else:
                yield out(END, vague & on)

    return run


def _contexts(width: int):
    """Suffixes with their bytes: `after` from the shared place on and `before` it, backwards."""

    def of(size: int):
        def emit(seq, batch, lo, row, start, n, off, shared):
            k, raw = np.asarray(batch.column("k"), np.int64), seq.data.tobytes()
            left = shared - start  # of the first window
            after = [raw[a : b + seq.width] for a, b in zip(shared.tolist(), (start + n - 1).tolist(), strict=True)]
            before = [raw[a:b][::-1] for a, b in zip(start.tolist(), shared.tolist(), strict=True)]
            head = signed(seq.codes(shared, shared + seq.width - size + 1, 14))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), size, np.int32)), pa.array(seq.leads(shared, seq.width - size + 1)), pa.array(head), pa.array(k[row + lo]), pa.array(packed(start - seq.first[row], n, left)), pa.array(after, pa.binary()), pa.array(before, pa.binary())],
                names=["size", "lead", "head", "k", "at", "after", "before"],
            )

        return spans_of(Bytes, width, size, emit, True)

    steps = {size: of(size) for size in Bytes(width).blocks[:-1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, step in steps.items():
                yield from step(iter([pa.RecordBatch.from_arrays([b.column("k"), b.column("text"), b.column(f"spans{size}")], names=["k", "text", "spans"])]))

    return run


def as_words(texts: list[bytes], size: int) -> np.ndarray:
    """Byte strings as rows of big-endian 8-byte words, zeros behind them."""
    n = -(-size // 8) * 8
    return np.frombuffer(b"".join(t.ljust(n, b"\0") for t in texts), ">u8").reshape(len(texts), -1).astype(U)


def multikey_sort(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort with eight bytes for a character: rows are split by the first word, each part that is still equal by the
    next one, all parts of a depth together. Returns the order (by group, then text) and, for each row in it, the number of leading bytes it shares with the
    row before (0 for the first of a group)."""
    m, depth = x.shape
    order = np.argsort(group, kind="stable")
    tied = np.zeros(m, bool)  # equal so far to the row before
    tied[1:] = group[order][1:] == group[order][:-1]
    shared = np.zeros(m, np.int64)
    part = np.cumsum(~tied)
    open_ = np.arange(m)
    for d in range(depth):
        both = tied.copy()
        both[:-1] |= tied[1:]
        open_ = np.flatnonzero(both)
        if not len(open_):
            break
        own = order[open_]
        turn = np.lexsort((x[own, d], part[open_]))
        order[open_] = own[turn]
        word = x[order[open_], d]
        before = np.zeros(len(open_), U)
        before[1:] = word[:-1]
        at = tied[open_]
        diff = np.where(at, word ^ before, U(0))
        differs = at & (diff != 0)
        high, low = (diff >> U(32)).astype(np.float64), (diff & U(0xFFFFFFFF)).astype(np.float64)
        zeros = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])
        shared[open_] += np.where(at, np.where(differs, zeros // 8, 8), 0)
        tied[open_[differs]] = False
        part = np.cumsum(~tied)
    return order, shared


def repeated(group, after: np.ndarray, before: np.ndarray, n, left, width: int) -> np.ndarray:
    """Which windows (rows x distance from the shared place) stand in another row of the group too. A row's windows are at the distances left-n+1..left."""
    m, most = len(group), int(left.max()) + 1
    rank, run = [], []
    for x in (after, before):
        order, shared = multikey_sort(group, x)
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        rank.append(place)
        run.append((shared, group[order]))
    (a_shared, a_group), (b_shared, b_group) = run
    edge = lambda g: np.concatenate([[True], g[1:] != g[:-1]])
    a_edge, b_edge = edge(a_group), edge(b_group)
    out = np.zeros((m, most), bool)
    for d in range(most):
        own = np.flatnonzero((left >= d) & (left - n + 1 <= d))
        if len(own) < 2:
            continue
        a = np.cumsum(a_edge | (a_shared < width - d))[rank[0][own]]
        key = a * np.int64(m + 1) + (np.cumsum(b_edge | (b_shared < d))[rank[1][own]] if d else 0)
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        same = np.zeros(len(own), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:].copy()
        out[own[turn[same]], d] = True
    return out


def _compared(width: int):
    """Of a sorted bucket, the windows that are repeated."""

    def done(t, group):
        x, n, left = unpacked(t["at"])
        after = as_words([bytes(b) for b in t["after"]], width)
        before = as_words([bytes(b) for b in t["before"]], max(1, int(left.max())))
        out = repeated(group, after, before, n, left, width)
        if not out.any():
            return None
        # distance d is the window that begins left - d behind the first
        row, d = np.nonzero(out)
        r, s, m = merged(row, x[row] + left[row] - d, np.ones(len(row), np.int64))
        return _done(t["k"][r], s, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0

        def flush():
            t = {x: np.concatenate([p[0][x] for p in parts]) for x in parts[0][0]}
            base = np.cumsum([0] + [int(p[1][-1]) + 1 for p in parts[:-1]])
            group = np.concatenate([p[1] + b for p, b in zip(parts, base, strict=True)])
            many = np.bincount(group)[group] > 1
            if many.any():
                got = done({x: c[many] for x, c in t.items()}, group[many])
                if got is not None:
                    yield got

        for t, group, _ in groups_of(batches, ["lead", "size", "head"], 1 << 62):
            parts.append((t, group))
            rows += len(group)
            if rows >= CHUNK:
                yield from flush()
                parts, rows = [], 0
        if parts:
            yield from flush()

    return run


def repeated_strings(texts: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(k, spans: packed first window and count) of the windows that also start elsewhere. texts: (k, text), all different."""
    spark, parts = texts.sparkSession, n_parts(texts.sparkSession)
    sizes = Bytes(width).blocks
    done: list[DataFrame] = []
    short: list[DataFrame] = []
    told = lambda t: t.where(F.col("kind") == DONE).select("k", F.col("at").alias("pos"), F.col("lead").alias("n"))
    spans: DataFrame | None = None
    levels = [(size, True) for size in sizes]
    if sizes[0] > 1:
        levels = [(sizes[0], False), *levels]
    for size, digest in levels:
        if spans is not None:
            source = texts.select("k", "text").join(spans.hint("merge"), "k")
        else:
            source = texts.select("k", "text")
        rows = scratch.save(source.mapInArrow(spans_of(Bytes, width, size, _suffixes(size, digest), spans is not None), SAID), "suffixes", [] if spans is None else [spans])
        sort = ["lead", "head", "first", "second", "k", "at"]
        ordered = rows.where(F.col("kind") == FINER).select("size", *sort).repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
        out = scratch.save(ordered.mapInArrow(_sifted(size, digest), SAID), "sifted")
        kept = scratch.save(rows.where(F.col("kind") == DONE).unionByName(out.where(F.col("kind").isin(DONE, SHORT))), "kept", [rows])
        done.append(told(kept))
        if size > 1:
            short.append(kept.where(F.col("kind") == SHORT).select("size", "k", "at"))
            finer = out.where(F.col("kind") == FINER).groupBy("k").agg(F.collect_list("at").alias("spans"))
            spans = scratch.save(finer, "finer", [out])
        else:
            ends = out.where(F.col("kind") == END)
            same = ["first", "second"]
            met = ends.groupBy(*same).agg(F.count("*").alias("many")).where("many > 1")
            # at most two runs for each partition, so the list is short whatever the corpus
            met = ends.join(F.broadcast(met), same)
            done.append(met.select("k", F.shiftright("at", 16).alias("pos"), F.lit(1).cast("long").alias("n")))
    if short:
        by = lambda size: F.collect_list(F.when(F.col("size") == size, F.col("at"))).alias(f"spans{size}")
        each = short[0]
        for s in short[1:]:
            each = each.unionByName(s)
        compare = scratch.save(each.groupBy("k").agg(*[by(size) for size in sizes[:-1]], F.count("*").alias("rows")), "short")
        buckets = max(parts, (compare.agg(F.sum("rows")).first()[0] or 0) // PER_BUCKET)
        names = "size int, lead long, head long, k long, at long, after binary, before binary"
        full = texts.select("k", "text").join(compare.drop("rows").hint("merge"), "k").mapInArrow(_contexts(width), names)
        ordered = full.repartitionByRange(buckets, "lead", "size", "head").sortWithinPartitions("lead", "size", "head")
        done.append(told(scratch.save(ordered.mapInArrow(_compared(width), SAID), "compared")))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return every.groupBy("k").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))


OUT = "c binary, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, pos, n = lists(batch.column("spans"), "pos", "n")
            copies = np.asarray(batch.column("copies"))
            for lo, hi, data, off in blocks(batch.column("text")):
                own = slice(cut[lo], cut[hi])
                gone = covered(off, len(data), cut[lo : hi + 1] - cut[lo], pos[own], n[own], width)
                removed, kept, count = [], [], []
                for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    g = gone[a:b]
                    if copies[lo + i] > 1 and b - a >= width:  # each string also starts in the copies
                        g = np.ones(b - a, bool)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], g, [0]]).astype(np.int8))) if g.any() else np.zeros(0, int)
                    removed.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                    kept.append(data[a:b][~g].tobytes())
                    count.append(int(g.sum()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("c").slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(count, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["c", "n_bytes", "n_removed", "removed", "kept"],
                )

    return run


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Removes each byte that lies in a `width`-byte string which also starts elsewhere, in another text or the same.

    Returns (doc_id, n_bytes, n_removed, spans of removed bytes, kept bytes), a row for each row of `docs`. A null text is
    empty; texts shorter than `width` lose nothing; strings overlap and are judged on the input; a text that several rows hold, of
    the same id or others, goes whole (if long enough), as each copy occurs elsewhere; null ids stay null; other columns, whatever their names, play no part.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    texts = distinct_texts(docs, text, doc_id, scratch)
    found = repeated_strings(texts.select("k", "text"), width, scratch)
    each = texts.select("k", "c", "text", "copies").join(found, "k", "left").select("c", "text", "copies", "spans")
    result = scratch.save(each.mapInArrow(_cut(width), OUT), "result", [texts])
    rows = docs.select(F.col(doc_id).alias(doc_id), key_of(F.col(text)).alias("c"))
    return rows.join(result, "c").select(doc_id, "n_bytes", "n_removed", F.col("removed").alias("spans"), "kept")
