"""Best-fit packing with certified bin counts.

Every document becomes token ids and an end id; only documents longer than a sequence are cut. Pieces that fill a sequence are one by themselves. The
others are dealt at random to partitions of about `PART` sequences. Each partition packs its pieces by best fit in decreasing length and holds the number of
its sequences against a lower bound from dual feasible functions (no packing of these pieces has fewer). A partition that meets its bound is certified: it
gives away only its emptiest sequences, those that hold all but a tenth of a sequence of its slack, as slack of less than a sequence in each of many
partitions adds up. One that doesn't meet it has a gap: it gives
away all its pieces in the first rounds and, once partitions no longer grow, those of its sequences that aren't full. What was given away is dealt anew, to
partitions `GROWTH` times as large, and packed again, until the sum of all is the lower bound of the whole table, or one partition held all that was left, or
a round saved nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from meshwork.llm.scratch import Scratch
from meshwork.llm.textbytes import BLOCK, text_bytes
from meshwork.llm.tokens import token_ids

CAPACITY, TOKENIZER, END = 2048, "word_bpe_49k.json", 0
#: Sequences and pieces of a partition, about, and rounds of exchange at most (each is at most the size of the one before; the result is whole after any).
PART, PART_ROWS, ROUNDS = 2048, 200_000, 6
#: Partitions grow by this much in each of the first rounds, never beyond `PART_ROWS` pieces.
GROWTH, GROWING = 8, 2
#: Rows of one task have numbers of their own from here on.
ROWS_OF_TASK = 1 << 36

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, number long"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, number long, bin long, offset long, kept boolean, part long, bins long, bound long"


@lru_cache(maxsize=4)
def dual_feasible(capacity: int) -> np.ndarray:
    """Dual feasible functions at every length 0..capacity, a row each, in units of the row's own capacity (its last entry). Of any lengths that fit one
    sequence the values sum to no more than that entry, so the values of all pieces over it bound the number of sequences from below. Three kinds: volume;
    pieces that leave less than e count whole and pieces below e not at all; lengths rounded to multiples of a share 1/k."""
    x = np.arange(capacity + 1)
    rows = [x]
    for e in range(1, capacity // 2 + 1):
        rows.append(np.where(x > capacity - e, capacity, np.where(x < e, 0, x)))
    for k in range(1, 101):
        whole = (k + 1) * x % capacity == 0
        rows.append(np.where(whole, x * k, (k + 1) * x // capacity * capacity))
    return np.array(rows, np.int64)


def bin_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best of these lower bounds for so many pieces of each length."""
    f = dual_feasible(capacity)
    used = f[:, lengths] @ counts.astype(np.int64)
    return int((-(-used // f[:, capacity])).max(initial=0))


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the room left in each bin; the longest pieces first, each to the fullest bin that has room. Open bins stand under
    their room; a bit for each room that some bin has finds the smallest that is enough."""
    order = np.argsort(-length, kind="stable")
    at, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, room = 0, []
    for i, n in zip(order.tolist(), length[order].tolist(), strict=True):
        enough = bits >> n
        if enough:
            r = n + (enough & -enough).bit_length() - 1
            b = open_by_room[r].pop()
            if not open_by_room[r]:
                bits ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        at[i], offset[i] = b, capacity - r
        room[b] = left = r - n
        if left:
            open_by_room[left].append(b)
            bits |= 1 << left
    return at, offset, np.array(room, np.int64)


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * ROWS_OF_TASK
        for batch in batches:
            texts = batch.column(1)
            size = text_bytes(texts)[1]
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + 16 * BLOCK, "right")) - 1)
                ids, off = token_ids(texts.slice(lo, hi - lo), path)
                out = []
                for doc, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        out.append((doc, p, s, len(part), zlib.crc32(part), number))
                        number += 1
                lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), FIELDS, strict=True)], names=NAMES)

    FIELDS, NAMES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()], ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def packed_parts(items: DataFrame, capacity: int, growing: bool) -> DataFrame:
    """Packs each partition (`part`) and says which pieces stay where they are."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        length = group["length"].to_numpy()
        at, offset, room = best_fit_decreasing(length, capacity)
        sizes, counts = np.unique(length, return_counts=True)
        bound = bin_bound(sizes, counts, capacity)
        if len(room) == bound:
            by_room = np.argsort(-room, kind="stable")
            slack = int(room.sum()) - np.cumsum(room[by_room])  # what is left after giving away so many
            given = int(np.argmax(slack <= capacity // 10)) + 1 if room.sum() < capacity else 1
            stays = np.ones(len(room), bool)
            stays[by_room[:given]] = room[by_room[:given]] == 0
        else:
            stays = (room == 0) & (not growing)
        out = group.drop(columns="part").assign(bin=at, offset=offset, kept=stays[at], part=group["part"], bins=len(room), bound=bound)
        return out.sort_values(["bin", "offset"])

    return items.groupBy("part").applyInPandas(pack, PLACES)


def fit_pack(
    docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", part_bins: int = PART, rounds: int = ROUNDS, report: list | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each document.

    A null or empty text is a document of the end id alone. Rows that repeat are documents of their own. A null id stays null. An empty table has no rows.
    Other columns of `docs` aren't read, whatever their names. `report` gets (round, partitions, sequences, lower bound of all pieces) of each round.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fit_packing")
    cut = scratch.save(pieces(docs, id_col, text_col, path, capacity), "pieces")
    rows = cut.groupBy("length").count().collect()  # a row for each length, so at most `capacity`
    count = np.zeros(capacity + 1, np.int64)
    for r in rows:
        count[r["length"]] = r["count"]
    whole = cut.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("number"), "offset": F.lit(0).cast("long")})
    results = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = [whole.select(results)]
    least = bin_bound(np.arange(capacity), count[:capacity], capacity)
    items, kept_bins, last = cut.where(F.col("length") < capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "number"), 0, None
    tokens, n_rows = int((np.arange(capacity) * count[:capacity]).sum()), int(count[:capacity].sum())
    for turn in range(rounds):
        if not tokens:
            break
        n = max(1, -(-tokens // (part_bins * GROWTH ** min(turn, GROWING) * capacity)), -(-n_rows // PART_ROWS))
        dealt = items.withColumn("part", F.pmod(F.xxhash64("number", F.lit(turn)), F.lit(n)))
        packed = scratch.save(packed_parts(dealt, capacity, turn < GROWING), "packed")
        own = F.first("bins")
        left = F.when(~F.col("kept"), F.col("length"))
        parts = packed.groupBy("part").agg(own.alias("bins"), F.countDistinct(F.when(F.col("kept"), F.col("bin"))).alias("kept"), F.sum(left).alias("left"), F.count(left).alias("rows"))
        s = parts.agg(F.sum("bins").alias("bins"), F.sum("kept").alias("kept"), F.sum("left").alias("left"), F.sum("rows").alias("rows")).first()
        total = kept_bins + s["bins"]
        if report is not None:
            report.append((turn, n, total, least))
        final = n == 1 or total == least or turn == rounds - 1 or (last is not None and total >= last)
        stay = packed if final else packed.where("kept")
        # numbers of sequences: round, then partition, then bin
        number = F.lit(turn << 58) + F.col("part") * F.lit(1 << 24) + F.col("bin")
        done.append(stay.withColumn("sequence_id", number).select(results))
        if final:
            break
        kept_bins, last, tokens, n_rows = kept_bins + s["kept"], total, s["left"] or 0, s["rows"]
        items = packed.where(~F.col("kept")).select(items.columns)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
