"""Approximate nearest neighbours over shifted Hilbert orderings.

Each ordering projects the vectors to a few random directions of its own, shifts them and numbers the cells along a Hilbert
curve; Spark range-partitions and sorts it, which gives each vector its rank. A query looks at the vectors within a window of ranks
around its own place, in each ordering; the windows are scored exactly, merged and reranked. How wide a window must be depends on the
vectors (uniform ones need much of an ordering, clustered ones little): the true neighbours of a bounded number of probes, found
among all vectors, tell the window that reaches the target recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from meshwork.llm.scratch import Scratch, n_parts
from meshwork.llm.vectors import finite, matrix, top_rows

K, CURVES, AXES, BITS = 20, 8, 4, 10
#: Vectors whose true neighbours are found to fit the window, and vectors that the scale of the cells is taken from.
PROBES, SAMPLE = 256, 8192
RECALL = 0.97
#: Ranks in a block; a window takes what it covers of as many blocks as it needs.
BLOCK = 4096
#: A window reaches so many ranks to each side at least.
LEAST_WINDOW = 1024


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer cells (rows x axes): the Gray code of the cells is undone from the highest bit
    on, exchanging and inverting axes as the curve turns, and the bits of the axes are interleaved."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(axes):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> b) & 1 == 1, turn ^ ((1 << b) - 1), turn)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


class Curves:
    def __init__(self, dim: int, scale: float, curves: int = CURVES, axes: int = AXES, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        turned = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-curves * axes // dim))]
        every = np.concatenate(turned, 1)[:, : curves * axes]
        self.axes, self.scale = axes, scale
        self.directions = every.T.reshape(curves, -1, dim)
        self.shift = rng.uniform(0, 1, (curves, self.directions.shape[1]))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """curves x rows: places along the orderings. A cell is the share of a normal distribution below the projection, plus the curve's shift."""
        out = []
        for d, s in zip(self.directions, self.shift, strict=True):
            z = x @ d.T / self.scale
            share = 0.5 * (1 + np.tanh(0.8 * z))
            cell = ((share + s) / 2 * (1 << BITS)).astype(np.int64)
            out.append(hilbert(np.clip(cell, 0, (1 << BITS) - 1), BITS))
        return np.array(out)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row: the same sum for a pair wherever it is met."""
    return np.einsum("ij,ij->i", q, x)


def _near(score: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray | None, k: int):
    """(row, column, exact score) of each row's k best by exact score, ties to the smaller id. `score` may be off in its last bits; what is outside a
    row's window has none (-inf)."""
    row, col = top_rows(score, ids, own, k, 1e-9)
    inside = score[row, col] > -np.inf
    row, col = row[inside], col[inside]
    exact = _exact(q[row], x[col])
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first], exact[first]


def _true_neighbours(classes: DataFrame, probes: np.ndarray, numbers: np.ndarray, k: int) -> DataFrame:
    """(probe, c): the k classes nearest to each of a bounded number of probes, among all. Each task returns k for each probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full((len(probes), k), -np.inf), np.full((len(probes), k), -1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                c = np.asarray(part.column("c"))
                score = np.where(c[None, :] == numbers[:, None], -np.inf, probes @ matrix(part.column("x")).T)
                score, c = np.concatenate([held[0], score], 1), np.concatenate([held[1], np.broadcast_to(c, score.shape)], 1)
                near = np.argpartition(-score, k - 1, axis=1)[:, :k]
                held = np.take_along_axis(score, near, 1), np.take_along_axis(c, near, 1)
        row, col = np.nonzero(held[1] >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[row]), pa.array(held[1][row, col]), pa.array(held[0][row, col])], names=["probe", "c", "score"])

    found = classes.select("c", "x").mapInArrow(run, "probe long, c long, score double").where(F.col("score") > float("-inf"))
    return found.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "c"))).where(F.col("n") <= k).select("probe", "c")


def _ranked(classes: DataFrame, asked: DataFrame, curves: Curves, scratch: Scratch) -> DataFrame:
    """(curve, kind, c, rank): the place of each class (kind 0) in each ordering, and for queries (kind 1) how many classes come before."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                for i, key in enumerate(curves.keys(matrix(part.column("x")))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, i, np.int32)), pa.array(key), part.column("kind"), part.column("c")], names=["curve", "key", "kind", "c"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve, kind = (batch.column(x).to_numpy() for x in ("curve", "kind"))
            at = np.zeros(len(curve), np.int64)
            for i in np.unique(curve).tolist():
                own = np.flatnonzero(curve == i)
                data = kind[own] == 0
                at[own] = np.cumsum(data) - data + before.get(i, 0)
                before[i] = before.get(i, 0) + int(data.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(curve), part, np.int32)), *(batch.column(x) for x in ("curve", "kind", "c")), pa.array(at)], names=["part", "curve", "kind", "c", "at"])

    both = classes.select("x", F.lit(0).alias("kind"), "c").unionByName(asked.select("x", F.lit(1).alias("kind"), "c"))
    rows = scratch.save(both.mapInArrow(keyed, "curve int, key long, kind int, c long"), "keys")
    sort = ["curve", "key", "kind", "c"]
    ordered = rows.repartitionByRange(n_parts(classes.sparkSession), *sort).sortWithinPartitions(*sort)
    placed = scratch.save(ordered.mapInArrow(counted, "part int, curve int, kind int, c long, at long"), "places", [rows])
    sizes = placed.where("kind = 0").groupBy("curve", "part").agg(F.count("*").alias("n"))
    every = placed.select("curve", "part").distinct().join(sizes, ["curve", "part"], "left").fillna(0, ["n"])
    ahead = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = every.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    firsts = F.broadcast(scratch.save(firsts, "firsts"))  # a row for each partition and curve that it touches
    return scratch.save(placed.join(firsts, ["curve", "part"]).select("curve", "kind", "c", (F.col("first") + F.col("at")).alias("rank")), "ranks", [placed])


def _window(classes: DataFrame, ranks: DataFrame, k: int, recall: float) -> int:
    """The least distance of ranks within which, in one ordering at least, the share `recall` of the probes' true neighbours lies."""
    probes = classes.orderBy(F.xxhash64(F.lit(4), "c"), "c").limit(PROBES).select("c", "x").toArrow()
    near = _true_neighbours(classes, matrix(probes["x"]), np.asarray(probes["c"]), k)
    places = ranks.where("kind = 0").select("curve", "c", "rank")
    met = near.join(places, "c").join(places.select("curve", F.col("c").alias("probe"), F.col("rank").alias("own")), ["curve", "probe"])
    away = met.groupBy("probe", "c").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("away")).select("away").toArrow()["away"].to_numpy()
    return max(k + 1, LEAST_WINDOW, int(np.quantile(away, recall, method="higher")) if len(away) else 0)


def ann(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest vectors found (largest inner product in double precision, ties to the
    smaller id), the query's own row left out.

    Equal vectors are indexed once, with their k + 1 smallest ids, which is all that an answer can hold; so a vector that fills a third of
    the table is one entry, and queries of equal vectors are one. A window holds at least k + 1 entries on each side, so no query finds fewer than k where the table has them. Of entries with equal scores those
    of the smallest ids stay. Vectors null, empty, zero, or with null or non-finite components take no part, nor do null ids; vectors of different lengths are
    indexed and searched by length; rows repeated with the same id count once. An empty table or query set gives an empty result. Other columns, whatever their names, play no part.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(embedding), lambda v: v.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0

    def usable(df):
        return df.where(F.col(vec_id).isNotNull() & finite(F.col(embedding), True)).select(F.col(vec_id).cast("long").alias("id"), x.alias("x"))

    rows, who = usable(vectors), usable(queries)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = rows.select(F.size("x").alias("dim")).distinct().join(who.select(F.size("x").alias("dim")).distinct(), "dim").collect()  # a row for each length
    for dim in sorted(r["dim"] for r in lengths):
        alike = F.size("x") == dim
        out = out.unionByName(_of_length(rows.where(alike), who.where(alike), dim, k, recall))
    return out


def _of_length(rows: DataFrame, who: DataFrame, dim: int, k: int, recall: float) -> DataFrame:
    """The search among vectors of one length. rows, who: (id, x) of the vectors and of the queries."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    # Spark keeps the first k + 1 of a vector in each task before the shuffle
    few = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("n") <= k + 1)
    one = few.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = scratch.save(one.select(F.monotonically_increasing_id().alias("c"), "x", "ids", F.col("ids")[0].alias("least")), "classes")
    asked = scratch.save(who.select("x").distinct().select(F.monotonically_increasing_id().alias("c"), "x"), "asked")
    sample = matrix(classes.orderBy(F.xxhash64(F.lit(3), "c"), "c").limit(SAMPLE).select("x").toArrow()["x"])
    curves = Curves(dim, float(np.sqrt((sample**2).mean()) or 1.0))
    ranks = _ranked(classes, asked, curves, scratch)
    width = _window(classes, ranks, k, recall)
    block = lambda rank: F.floor(rank / BLOCK).cast("int")

    def dealt(kind: int, table: DataFrame, blocks) -> DataFrame:
        """Vectors with the blocks that they go to, in each ordering."""
        own = ranks.where(F.col("kind") == kind).groupBy("c").agg(F.collect_list(F.struct("curve", "rank")).alias("places"))
        each = table.join(own, "c").withColumn("place", F.explode("places")).drop("places")
        return each.withColumns({"curve": F.col("place.curve"), "rank": F.col("place.rank"), "block": blocks(F.col("place.rank"))}).drop("place")

    data = dealt(0, classes.select("c", "least", "x"), block)
    near = dealt(1, asked, block).withColumn("floor", F.lit(float("-inf")))
    around = F.filter(F.sequence(block(F.greatest(F.col("place.rank") - width, F.lit(0))), block(F.col("place.rank") + width)), lambda b: b != block(F.col("place.rank")))
    far = dealt(1, asked, lambda rank: F.explode(around))

    def search(key, a: pa.Table, b: pa.Table) -> pa.Table:
        names, types = ["q", "c", "least", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        a, b = a.sort_by("rank"), b.sort_by("rank")
        c, least, xs, at = np.asarray(a["c"]), np.asarray(a["least"]), matrix(a["x"]), np.asarray(a["rank"])
        qc, qs, floor, own = np.asarray(b["c"]), matrix(b["x"]), np.asarray(b["floor"]), np.asarray(b["rank"])
        out = []
        for lo in range(0, len(qs), 64):  # queries of neighbouring ranks look at almost the same entries
            q, mid = qs[lo : lo + 64], own[lo : lo + 64]
            i, j = np.searchsorted(at, mid[0] - width), np.searchsorted(at, mid[-1] + width, "right")
            score = np.where(np.abs(at[None, i:j] - mid[:, None]) <= width, q @ xs[i:j].T, -np.inf)
            # k + 1 entries by score, then smallest id: each holds an id that comes before any of the entries left out
            row, col, score = _near(score, q, xs[i:j], least[i:j], None, k + 1)
            above = score >= floor[lo:][row]
            out.append((qc[lo:][row][above], c[i:j][col][above], least[i:j][col][above], score[above]))
        return pa.table([pa.array(np.concatenate(v), t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    keys = ["curve", "block"]
    deal = lambda df: df.repartition(n_parts(spark), *keys).groupBy(*keys)
    by_entry = Window.partitionBy("q").orderBy(F.desc("score"), "least", "c")

    def scored(ask: DataFrame, before: DataFrame | None) -> DataFrame:
        """The k + 1 best entries of each query, of the blocks asked and those found before."""
        found = deal(data).cogroup(deal(ask)).applyInArrow(search, "q long, c long, least long, score double")
        every = found if before is None else found.unionByName(before)
        merged = every.groupBy("q", "c", "least").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(by_entry)).where(F.col("n") <= k + 1)
        return scratch.save(merged.drop("n"), "merged")

    # first the blocks that a query lies in; the others return only what isn't below the last entry found there
    first = scored(near, None)
    floors = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") > k).select(F.col("q").alias("c"), "floor")
    merged = scored(far.join(floors, "c", "left").fillna(float("-inf"), ["floor"]), first)
    listed = merged.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    listed = scratch.save(listed.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).drop("n"), "listed")
    named = who.select(F.col("id").alias("query_id"), "x").distinct().join(asked.withColumnRenamed("c", "q"), "x").select("query_id", "q")
    met = named.join(listed, "q").where("query_id <> id")
    out = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
