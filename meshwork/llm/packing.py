"""Packing: optimal length buckets by dynamic programming over the global histogram, token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from meshwork.llm.mixing import n_words
from meshwork.llm.scratch import Scratch

LONGEST, BUCKETS, BUDGET, PER_GROUP = 2048, 16, 32768, 4096


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets over the given lengths that minimise the sum of (bound - length). For k buckets and
    lengths up to j: cost[k][j] = min over i of cost[k-1][i] + padding of the lengths i+1..j to length j."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    m = len(x)
    if not m:
        return []
    rows, words = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    cost = np.concatenate([[0], np.full(m, np.inf)])
    picks = []
    for _ in range(min(buckets, m)):
        new, pick = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        new[0] = 0
        for j in range(1, m + 1):
            option = cost[:j] + x[j - 1] * (rows[j] - rows[:j]) - (words[j] - words[:j])
            i = int(option.argmin())
            new[j], pick[j] = option[i], i
        picks.append(pick)
        cost = new
    bounds, j = [], m
    for pick in reversed(picks):
        if j == 0:
            break
        bounds.append(int(x[j - 1]))
        j = int(pick[j])
    return sorted(bounds)


def pieces(docs: DataFrame, length: Column, doc_id: str, longest: int, text: str | None = None) -> DataFrame:
    """(doc_id, part, start, length, h): texts cut into pieces of at most `longest` words; an empty one is a piece of length 0. h: a hash that scatters
    them, of the text too, so that rows without an id are scattered."""
    own = docs.select(F.col(doc_id).alias("doc_id"), length.alias("n"), (F.xxhash64(F.col(text)) if text else F.lit(0).cast("long")).alias("h"))
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("long"))
    own = own.select("doc_id", "n", "h", F.explode(parts).alias("part"))
    size = F.least(F.col("n") - F.col("part") * longest, F.lit(longest)).cast("long")
    return own.select("doc_id", "part", (F.col("part") * longest).alias("start"), size.alias("length"), F.xxhash64("doc_id", "part", size, "h").alias("h"))


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """(doc_id, part, start, length, bucket, batch, slot): each piece of at most `longest` words in a bucket, padded to the
    bucket's bound, and in a batch of budget // bound pieces (one at least) of that bucket.

    All batches of a bucket are full but the last. The histogram has at most `longest` rows and is all the driver sees. Pieces are numbered in the order
    of a hash: counted by groups of about PER_GROUP, groups by prefix sums, then inside their group. A null or empty text is one
    piece of length 0 without bucket, batch and slot (null); null ids are kept; repeated rows are packed each; other columns play no part. `length`
    may give the number of tokens instead of words.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    got = pieces(docs, n_words(F.col(text)) if length is None else F.coalesce(length, F.lit(0)).cast("long"), doc_id, longest, text if text in docs.columns else None)
    all_ = scratch.save(got, "pieces")
    histogram = all_.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()
    bounds = best_bounds([r["length"] for r in histogram], [r["n"] for r in histogram], buckets)
    if not bounds:
        none = {x: F.lit(None).cast("long") for x in ("bucket", "batch", "slot")}
        return all_.drop("h").withColumns(none)
    groups = max(1, sum(r["n"] for r in histogram) // PER_GROUP)
    bucket = F.when(F.col("length") == 0, None)
    for b in bounds:
        bucket = bucket.when(F.col("length") <= b, F.lit(b).cast("long"))
    own = all_.withColumns({"bucket": bucket, "__hash": F.col("h")}).withColumn("__group", F.pmod("__hash", F.lit(groups)))
    ahead = Window.partitionBy("bucket").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = own.where("length > 0").groupBy("bucket", "__group").agg(F.count("*").alias("n")).select("bucket", "__group", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("bucket", "__group").orderBy("__hash", "doc_id", "part"))
    placed = own.join(firsts, ["bucket", "__group"]).withColumn("__place", F.col("__first") + inside - 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))).cast("long")
    placed = placed.select("doc_id", "part", "start", "length", "bucket", F.floor(F.col("__place") / room).cast("long").alias("batch"), (F.col("__place") % room).alias("slot"))
    none = own.where("length = 0").select("doc_id", "part", "start", "length", "bucket", *[F.lit(None).cast("long").alias(x) for x in ("batch", "slot")])
    return placed.unionByName(none)
