"""Substring dedup by relative Lempel-Ziv parsing: texts are factored against what texts of smaller id hold.

1. Which reference does a text need? Spans of windows around sampled anchors (`repeats`) are sorted by code; each span found whole in a
   text of smaller id names that text, others are cut into single windows, which name the smallest text that holds them. So each text asks for few
   references, however many hold the same passage.
2. The texts that are named are dealt to reference blocks. A block that many ask is held several times, each time for a share of
   those that ask, so it is no hot key.
3. A block indexes its 13-word windows. Each text that asks is factored greedily: at a place the longest match with a reference of
   smaller id is taken, words compared byte by byte. The next factor is sought from the first window that crosses the factor's
   end, so windows at factor boundaries are judged like all others. Factors of `width` words or more are what goes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshwork.llm.repeats import Words, covered, distinct_texts, key_of, key_of_table, lists, merged, order_of, packed, spans_of, unpacked
from meshwork.llm.scratch import Scratch, n_parts
from meshwork.llm.textbytes import BLOCK, NOT_SPACE, blocks, range_codes, run_codes, signed, words

WIDTH = 13
#: References in a block, and spans that ask one reference before it is held once more.
PER_BLOCK, PER_SALT = 256, 2_000
COLUMNS = ["n_words", "n_removed", "factors", "kept"]
ROWS = "head long, full long, ord long, k long, at long"
SAID = "kind int, head long, ord long, k long, at long, src long, src_at long"
#: A span found in a text of smaller id, a span to cut finer, a window at a partition's end.
FOUND, FINER, END = 0, 1, 2


def _suffixes(size: int):
    def emit(seq: Words, batch, lo, row, start, n, off, shared):
        head = signed(seq.runs(seq.width - size + 1)[shared])
        # a span is told by what its windows share and by all of it, a single window by both codes of its words
        full = signed(seq.codes(start, start + n + seq.width - 1, 0) if size > 1 else seq.runs(seq.width, 1)[start])
        order, k = (np.asarray(batch.column(x), np.int64)[row + lo] for x in ("ord", "k"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (head, full, order, k, packed(start - seq.first[row], n, off))], names=["head", "full", "ord", "k", "at"])

    return emit


def _looked_up(single: bool):
    """Of a sorted partition of the index, what is found in a text of smaller id, with the first place of the same code. Of spans that aren't, those that
    may hold windows of others are to be cut finer."""

    def said(kind, t, keep, src=None, src_at=None):
        zero = np.zeros(int(keep.sum()), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(zero), kind, np.int32))] + [pa.array(t[x][keep]) for x in ("head", "ord", "k", "at")] + [pa.array(zero if src is None else src[keep]), pa.array(zero if src is None else src_at[keep])],
            names=[x.split()[0] for x in SAID.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = opening = None  # the first row of the class that a batch ends in; the first class of the partition
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {x: batch.column(x).to_numpy() for x in batch.schema.names}
            size = batch.num_rows
            key = lambda i: (t["head"][i], t["full"][i])  # noqa: E731, B023
            new_head, new = np.ones(size, bool), np.ones(size, bool)
            new_head[1:] = t["head"][1:] != t["head"][:-1]
            new[1:] = new_head[1:] | (t["full"][1:] != t["full"][:-1])
            begin = np.flatnonzero(new)
            cls = np.cumsum(new) - 1
            first = {x: t[x][begin] for x in ("ord", "k", "at")}
            if last is not None and last[0] == key(0):
                for x in first:
                    first[x][0] = last[1][x]
            if opening is None:
                opening = key(0)
            found = t["ord"] > first["ord"][cls]
            yield said(FOUND, t, found, first["k"][cls], first["at"][cls])
            if single:
                yield said(END, t, ~found & (cls == 0) & (key(0) == opening))
            else:
                group = np.cumsum(new_head) - 1
                mates = np.bincount(group[begin])[group] > 1
                yield said(FINER, t, ~found & (mates | (group == 0) | (group == group[-1])))
            last = (key(-1), {x: first[x][-1] for x in first})
        if single and last is not None and last[0] != opening:
            t = {"head": np.array([last[0][0]])} | {x: np.array([v]) for x, v in last[1].items()}
            yield said(END, t, np.ones(1, bool))

    return run


def _found(texts: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(k, at, src): spans of windows whose words also stand in the text `src`, which has a smaller id."""
    parts = n_parts(texts.sparkSession)
    found = []
    kind = partial(Words, key=key_of_table(texts))
    for size in Words(width).blocks:
        if found:
            source = texts.select("k", "ord", "text").join(spans.hint("merge"), "k")
        else:
            source = texts.select("k", "ord", "text")
        rows = scratch.save(source.mapInArrow(spans_of(kind, width, size, _suffixes(size), bool(found)), ROWS), "suffixes")
        sort = ["head", "full", "ord", "k", "at"]
        ordered = rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
        out = scratch.save(ordered.mapInArrow(_looked_up(size == 1), SAID), "looked-up", [rows])
        found.append(out.where(F.col("kind") == FOUND).select("k", "at", "src"))
        if size > 1:
            spans = scratch.save(out.where(F.col("kind") == FINER).groupBy("k").agg(F.collect_list("at").alias("spans")), "finer")
    ends = out.where(F.col("kind") == END)
    # two classes of each partition at most, so the list is short whatever the corpus
    met = ends.groupBy("head").agg(F.min(F.struct("ord", "k")).alias("least"), F.count("*").alias("many")).where("many > 1")
    met = ends.join(F.broadcast(met.select("head", "least")), "head").where(F.col("ord") > F.col("least.ord"))
    found.append(met.select("k", "at", F.col("least.k").alias("src")))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every


def joined_words(raw: bytes) -> bytes:
    return b" ".join(raw.split())  # bytes.split() takes just the contract's white space


PARTS = "block int, salt int, kind int, k long, ord long, start int, words binary"


def _dealt(width: int):
    """What goes to the blocks: references whole (kind 0), and of texts that ask the words of the spans found there (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, at, block, salt = lists(batch.column("spans"), "at", "block", "salt")
            k, order, own, copies = (batch.column(x).to_pylist() for x in ("k", "ord", "block", "salts"))
            for lo, hi, data, off in blocks(batch.column("text")):
                start, end, first = words(data, off, NOT_SPACE)
                raw, out = data.tobytes(), []
                for i in range(lo, hi):
                    if own[i] is not None:
                        whole = joined_words(raw[off[i - lo] : off[i - lo + 1]])
                        out.extend((own[i], s, 0, k[i], order[i], 0, whole) for s in range(copies[i]))
                flat = slice(cut[lo], cut[hi])
                if cut[hi] > cut[lo]:
                    row = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1]))
                    pos, n, _ = unpacked(at[flat])
                    place, which = np.unique(np.stack([row, block[flat], salt[flat]]), axis=1, return_inverse=True)
                    which, pos, n = merged(which.ravel(), pos, n + width - 1)
                    r, b, s = place[:, which]
                    a = first[r] + pos
                    for i, j, x, y, p, m in zip(r.tolist(), b.tolist(), s.tolist(), a.tolist(), pos.tolist(), n.tolist(), strict=True):
                        out.append((j, x, 1, k[lo + i], order[lo + i], p, joined_words(raw[start[y] : end[y + m - 1]])))
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PARTS.split(", ")])

    return run


class Reference:
    """The texts of a block with an index of their windows: codes in order, for equal ones by the text's id."""

    def __init__(self, texts: list[tuple[int, int, bytes]], width: int):
        self.width = width
        self.raw = b"\n".join(t for _, _, t in texts)
        data = np.frombuffer(self.raw, np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) + 1 for _, _, t in texts])])
        off[-1] -= 1
        self.start, self.end, first = words(data, off, NOT_SPACE)
        self.first = first[:-1]
        self.codes = range_codes(data, self.start, self.end, 13)
        count = np.diff(first)
        self.ord = np.array([o for _, o, _ in texts], np.int64)
        text = np.repeat(np.arange(len(texts)), count)
        self.stop = first[1:][text] if len(text) else text  # where each word's text ends
        grams = run_codes(self.codes, width)
        fits = np.flatnonzero(np.arange(len(grams)) + width <= self.stop[: len(grams)])
        order = np.lexsort((fits, self.ord[text[fits]], grams[fits]))
        self.at, self.gram = fits[order], grams[fits][order]
        self.of, self.text = self.ord[text[self.at]], text

    def _match(self, codes, i: int, p: int, stop: int) -> int:
        """How many words from place i of the text, which ends at `stop`, and from place p of the block on have the same codes."""
        most = min(stop - i, int(self.stop[p]) - p)
        step, done = 64, 0
        while done < most:
            m = min(step, most - done)
            differ = codes[i + done : i + done + m] != self.codes[p + done : p + done + m]
            if differ.any():
                return done + int(differ.argmax())
            done, step = done + m, step * 4
        return done

    def factors(self, asked: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(k, start, words, id of the reference, place in it) of the factors of texts (k, id, place of the first word, words) against references of smaller id."""
        raw = b"\n".join(t for *_, t in asked)
        off = np.concatenate([[0], np.cumsum([len(t) + 1 for *_, t in asked])])
        off[-1] -= 1
        data = np.frombuffer(raw, np.uint8)
        start, end, first = words(data, off, NOT_SPACE)
        codes = range_codes(data, start, end, 13)
        grams = run_codes(codes, self.width)
        lo = np.searchsorted(self.gram, grams)
        known = np.flatnonzero((lo < len(self.gram)) & (self.gram[np.minimum(lo, max(0, len(self.gram) - 1))] == grams)) if len(self.gram) else np.zeros(0, np.int64)
        row = np.searchsorted(first, known, "right") - 1
        fits = known + self.width <= first[row + 1]
        own = np.array([o for _, o, _, _ in asked], np.int64)
        fits &= self.of[lo[known]] < own[row]  # the first of equal windows has the smallest id
        known, row = known[fits], row[fits]
        hi = np.searchsorted(self.gram, grams[known], "right").tolist()
        lo, cut = lo[known].tolist(), np.searchsorted(row, np.arange(len(asked) + 1)).tolist()
        at, known = first.tolist(), known.tolist()
        for r, (k, order, place, _) in enumerate(asked):
            j, last, stop = cut[r], cut[r + 1], at[r + 1]
            while j < last:
                i = known[j]
                a, b = lo[j], hi[j]
                if b - a > 1:
                    b = a + int(np.searchsorted(self.of[a:b], order))
                tried = sorted(((self._match(codes, i, p, stop), -p) for p in self.at[a:b].tolist()), reverse=True)
                for n, p in tried:
                    p = -p
                    if raw[start[i] : end[i + n - 1]] != self.raw[self.start[p] : self.end[p + n - 1]]:  # the codes lied: word by word
                        n = next((x for x in range(n) if raw[start[i + x] : end[i + x]] != self.raw[self.start[p + x] : self.end[p + x]]), n)
                    if n >= self.width:
                        text = int(self.text[p])
                        yield k, place + i - at[r], n, int(self.ord[text]), p - int(self.first[text])
                        # the next factor may begin at the first window that crosses this one's end
                        j = bisect.bisect_left(known, i + n - self.width + 1, j, last)
                        break
                else:
                    j += 1


FACTORS = "k long, start int, n int, ref long, ref_start int"


def _parsed(width: int):
    """Streams a partition sorted by block and salt: references first, then the texts that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, texts, asked, size, index = None, [], [], 0, None

        def answered():
            nonlocal index, asked, size
            if index is None:
                index = Reference(texts, width)
            out = list(index.factors(asked))
            asked, size = [], 0
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            cols = zip(*out, strict=True) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in FACTORS.split(", ")])

        for batch in batches:
            for block, salt, kind, k, order, start, text in zip(*(batch.column(x).to_pylist() for x in ("block", "salt", "kind", "k", "ord", "start", "words")), strict=True):
                if (block, salt) != key:
                    if asked:
                        yield answered()
                    key, texts, index = (block, salt), [], None
                if kind == 0:
                    texts.append((k, order, text))
                    continue
                asked.append((k, order, start, text))
                size += len(text)
                if size > BLOCK:
                    yield answered()
        if asked:
            yield answered()

    return run


def parsed(texts: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(k, spans: start, n, ref, ref_start): the factors of `width` words or more of each text that has some. texts: (k, ord, text), all different."""
    parts = n_parts(texts.sparkSession)
    found = scratch.save(_found(texts, width, scratch), "found")
    uses = found.groupBy(F.col("src").alias("ref")).agg(F.count("*").alias("uses"))
    uses = scratch.save(uses.withColumn("salts", F.ceil(F.col("uses") / PER_SALT).cast("int")), "uses")
    n_blocks = max(parts, uses.count() // PER_BLOCK)
    block = lambda k: F.pmod(F.xxhash64(k), F.lit(n_blocks)).cast("int")
    often = uses.where("salts > 1").select(F.col("ref").alias("src"), "salts")
    asked = found.join(often, "src", "left").select("k", "at", block("src").alias("block"), F.coalesce(F.pmod(F.xxhash64(F.lit(1), "k"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
    asked = asked.groupBy("k").agg(F.collect_list(F.struct("at", "block", "salt")).alias("spans"))
    held = uses.select(F.col("ref").alias("k"), block("ref").alias("block"), "salts")
    plan = scratch.save(asked.join(held, "k", "full"), "plan", [found])
    dealt = texts.select("k", "ord", "text").join(plan.hint("merge"), "k").mapInArrow(_dealt(width), PARTS)
    ordered = dealt.repartition(n_blocks, "block", "salt").sortWithinPartitions("block", "salt", "kind", "k", "start")
    factors = scratch.save(ordered.mapInArrow(_parsed(width), FACTORS), "factors")
    return factors.groupBy("k").agg(F.collect_list(F.struct("start", "n", "ref", "ref_start")).alias("spans"))


FACTOR = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ref", pa.int64()), ("ref_start", pa.int64())])
OUT = "c binary, ord long, n_words long, n_removed long, factors array<struct<start:long,end:long,ref:long,ref_start:long>>, kept string"


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, pos, n, ref, ref_at = lists(batch.column("spans"), "start", "n", "ref", "ref_start")
            for lo, hi, data, off in blocks(batch.column("text")):
                start, end, first = words(data, off, NOT_SPACE)
                own = slice(cut[lo], cut[hi])
                gone = covered(first, len(start), cut[lo : hi + 1] - cut[lo], pos[own], n[own] - width + 1, width)
                raw, factors, kept, removed = data.tobytes(), [], [], []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    mine = range(cut[lo + i], cut[lo + i + 1])
                    factors.append(sorted(({"start": int(pos[j]), "end": int(pos[j] + n[j]), "ref": int(ref[j]), "ref_start": int(ref_at[j])} for j in mine), key=lambda x: (x["start"], x["end"])))
                    if mine:
                        edge = (np.flatnonzero(np.diff(np.concatenate([[1], gone[a:b], [1]]).astype(np.int8))) + a).tolist()
                        kept.append(b" ".join([joined_words(raw[start[x] : end[y - 1]]) for x, y in zip(edge[::2], edge[1::2], strict=True)]).decode())
                    else:
                        kept.append(joined_words(raw[off[i] : off[i + 1]]).decode())
                    removed.append(int(gone[a:b].sum()) if mine else 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("c").slice(lo, hi - lo), batch.column("ord").slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(factors, pa.list_(FACTOR)), pa.array(kept, pa.string())],
                    names=["c", "ord", *COLUMNS],
                )

    return run


def rlz_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Removes each word covered by `width` consecutive words that also stand, in this order, in a text of smaller id.

    Returns the columns of `docs` and n_words, n_removed, factors (start and end in words, the reference's id, place in it), kept (the words left,
    joined by one space); columns of these names are replaced, all others are kept, whatever their names. A null text has no words; a null id counts as the largest
    (so a reference's id is never null); rows of equal id don't count as earlier than each other, so repeated rows keep what one of them keeps; of one
    text under several ids all but the smallest lose all their words, if they have `width`; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "rlz")
    texts = distinct_texts(docs, text, doc_id, scratch)
    spans = parsed(texts, width, scratch)
    each = texts.select("k", "c", "ord", "text").join(spans, "k", "left").select("c", "ord", "text", "spans")
    result = scratch.save(each.mapInArrow(_cut(width), OUT), "result", [texts])
    carried = [c for c in docs.columns if c not in COLUMNS]
    # carried columns get names of their own, so that none can clash with the operator's
    whole = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carried)], key_of(F.col(f"`{text}`")).alias("c"), order_of(F.col(f"`{doc_id}`")).alias("own"))
    copy = (F.col("own") > F.col("ord")) & (F.col("n_words") >= width)
    at = lambda x: F.lit(x).cast("long")
    all_of_it = F.array(F.struct(at(0).alias("start"), F.col("n_words").alias("end"), F.col("ord").alias("ref"), at(0).alias("ref_start")))
    out = whole.join(result, "c").withColumns({"n_removed": F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")), "factors": F.when(copy, all_of_it).otherwise(F.col("factors")), "kept": F.when(copy, "").otherwise(F.col("kept"))})
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carried)], *COLUMNS)
