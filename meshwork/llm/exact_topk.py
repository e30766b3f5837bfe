"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

The lists of all dimensions are read from both ends (the top for positive weights of a query, the bottom for negative ones) in steps of growing depth. A
vector is met at the first step that reaches it in any list, and belongs to that step's blocks. After a step each query's kth score, over all blocks, is
held against its bound, the score of a vector made of the values at which the lists now stand: no vector that hasn't been met can score more. A query whose
kth score is above its bound stops and isn't sent to the blocks of later steps; what is left after the last step is scored for the others. Steps at which no
query can stop, as the longest vector shows, are read together with the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshwork.llm.scratch import Scratch, n_parts
from meshwork.llm.vectors import best, finite, matrix, top_rows

K, SCALE, DATA_BLOCK, QUERY_BLOCK = 5, 256, 4096, 2048
#: Depths of the steps, as shares of a list, and the accuracy (one in so many rows) with which the values there are found. The bound holds at any accuracy.
DEPTHS = (1 / 1024, 1 / 128, 1 / 16)
ACCURACY = 5000


def list_values(data: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, the values at the steps' depths of every list: (from the top, from the bottom), steps x dimensions. A row
    for each dimension comes to the driver, whatever the number of vectors."""
    shares = [1 - d for d in DEPTHS] + list(DEPTHS)
    rows = data.select("dim", F.posexplode("x").alias("j", "v")).groupBy("dim", "j").agg(F.percentile_approx("v", shares, ACCURACY).alias("at")).collect()
    out: dict = {}
    for r in rows:
        top, bottom = out.setdefault(r["dim"], (np.zeros((len(DEPTHS), r["dim"])), np.zeros((len(DEPTHS), r["dim"]))))
        top[:, r["j"]], bottom[:, r["j"]] = r["at"][: len(DEPTHS)], r["at"][len(DEPTHS) :]
    return out


def met_at(x: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """The step at which each vector is met: the first at which a component is beyond the value where its list stands (the number of steps: none)."""
    step = np.full(len(x), len(top), np.int32)
    for s in range(len(top) - 1, -1, -1):
        step[((x > top[s]) | (x < bottom[s])).any(1)] = s
    return step


def bounds(q: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """The largest score of a vector that lies between the lists' values."""
    return np.maximum(q, 0) @ top + np.minimum(q, 0) @ bottom


def scores(q: np.ndarray, x: np.ndarray, whole: bool, allowed: np.ndarray | None = None) -> np.ndarray:
    """All inner products; of whole numbers exactly. Of pairs whose products could pass 64 bits, those that are `allowed` are added up in Python's
    integers: a sum above 64 bits is an error, one below stands for the smallest number."""
    if not (whole and len(q) and len(x)):
        return q @ x.T
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if most < 2**53:
        return q @ x.T
    if most < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    far = np.abs(q) @ np.abs(x).T >= 2.0**62
    small = lambda m: np.where(np.abs(m) < 2.0**62, m, 0).astype(np.int64)
    with np.errstate(over="ignore"):
        out = small(q) @ small(x).T  # pairs that aren't near hold no component that is cut here, or only against zeros
    low = np.iinfo(np.int64).min
    for i, j in zip(*np.nonzero(far), strict=True):
        if allowed is None or allowed[i, j]:
            out[i, j] = max(low, _fits(sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True))))
        else:
            out[i, j] = low
    return out


def _fits(score: int) -> int:
    if score >= 2**63:
        raise ArithmeticError("a score passes 64 bits")
    return score


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int | None = SCALE, report: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k largest inner products with all vectors but its own, ties to the smaller id.

    With `scale`, components become floor(scale * x) and scores are exact integers (an error says if a wanted one passes 64 bits). The vectors met at a step are dealt to blocks of about
    DATA_BLOCK by a hash, the queries still open to blocks of QUERY_BLOCK; a pair of blocks returns k rows a query. Vectors
    that are null, empty, or hold null or non-finite components take no part, nor do null ids; vectors of different length aren't compared; rows repeated with
    the same id are each a candidate, for queries of another id. Other columns, whatever their names, play no part; an empty table or query set gives an empty result. `report`
    gets (step, vectors met, queries that scored them) of each step.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")

    def numbers(df):
        x = F.transform(F.col(embedding), lambda v: F.floor(v.cast("double") * scale).cast("double") if scale else v.cast("double"))
        return df.where(F.col(vec_id).isNotNull() & finite(F.col(embedding))).select(F.col(vec_id).cast("long").alias("id"), x.alias("x"), F.size(embedding).alias("dim"))

    values = list_values(numbers(vectors))

    def with_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            step = np.zeros(len(dims), np.int32)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                step[own] = met_at(matrix(batch.column("x").take(pa.array(own))), *values[d])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "x", "dim")), pa.array(step)], names=["id", "x", "dim", "step"])

    data = scratch.save(numbers(vectors).mapInArrow(with_step, "id long, x array<double>, dim int, step int"), "data")
    met = {r["step"]: r["n"] for r in data.groupBy("step").agg(F.count("*").alias("n")).collect()}
    open_ = scratch.save(numbers(queries).where(F.col("dim").isin(*values) if values else F.lit(False)), "queries")
    norms = data.groupBy("dim").agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).alias("n")).collect()
    useful = _useful(open_, values, {r["dim"]: r["n"] for r in norms})
    found: DataFrame | None = None
    before = -1
    for step in [*useful, len(DEPTHS)]:
        asked = open_.count()
        reached, before = range(before + 1, step + 1), step
        n_met = sum(met.get(s, 0) for s in reached)
        if report is not None:
            report.append((step, n_met, asked))
        if not asked:
            break
        if n_met:
            new = _scored(data.where(F.col("step").between(reached[0], step)), open_, n_met, asked, k, bool(scale))
            both = new if found is None else new.unionByName(found)
            found = scratch.save(best(both, k, F.col("score").desc(), F.col("vec_id")).drop("rank"), "best")
        if step < len(DEPTHS) and found is not None:
            kth = found.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k)
            left = open_.mapInArrow(_bounded(values, step), "id long, x array<double>, dim int, bound double").join(kth, F.col("id") == F.col("query_id"), "left")
            open_ = scratch.save(left.where("kth is null or kth <= bound + 1e-9 * abs(bound)").select("id", "x", "dim"), "queries", [open_])
    if found is None:
        found = spark.createDataFrame([], _shape(bool(scale)))
    out = best(found, k, F.col("score").desc(), F.col("vec_id"))
    return out.select("query_id", "rank", "vec_id", F.col("score").cast("long") if scale else "score")


def _useful(asked: DataFrame, values: dict, longest: dict[int, float]) -> list[int]:
    """The steps at which some query may stop: no score passes the product of its norm and the longest vector's, so where that is no more than the bound,
    for all queries, reading that far alone ends nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(DEPTHS), bool)
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims).tolist():
                q = matrix(batch.column("x").take(pa.array(np.flatnonzero(dims == d))))
                top, bottom = values[d]
                for s in range(len(DEPTHS)):
                    found[s] |= bool((np.linalg.norm(q, axis=1) * longest[d] * (1 + 1e-9) > bounds(q, top[s], bottom[s])).any())
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found).astype(np.int32))], names=["step"])

    return sorted(r["step"] for r in asked.mapInArrow(run, "step int").distinct().collect())


def _bounded(values: dict, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            out = np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                top, bottom = values[d]
                out[own] = bounds(matrix(batch.column("x").take(pa.array(own))), top[step], bottom[step])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "x", "dim")), pa.array(out)], names=["id", "x", "dim", "bound"])

    return run


def _shape(whole: bool) -> str:
    return f"query_id long, vec_id long, score {'long' if whole else 'double'}"


def _scored(data: DataFrame, asked: DataFrame, n_data: int, n_asked: int, k: int, whole: bool) -> DataFrame:
    """The k best of each pair of blocks for each query."""
    d_blocks, q_blocks = max(1, -(-n_data // DATA_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    of = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = data.select("id", "x", "dim", of(1, d_blocks).alias("d"), every(q_blocks).alias("q"))
    right = asked.select("id", "x", "dim", of(2, q_blocks).alias("q"), every(d_blocks).alias("d"))

    def search(key, a: pa.Table, b: pa.Table) -> pa.Table:
        names, types = ["query_id", "vec_id", "score"], (pa.int64(), pa.int64(), pa.int64() if whole else pa.float64())
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        ids, x, asked_ids, q = np.asarray(a["id"]), matrix(a["x"]), np.asarray(b["id"]), matrix(b["x"])
        out = []
        for lo in range(0, len(q), 256):
            s = scores(q[lo : lo + 256], x, whole, ids[None, :] != asked_ids[lo : lo + 256][:, None])
            row, col = top_rows(s, ids, asked_ids[lo : lo + 256], k)
            if whole and (s[row, col] == np.iinfo(np.int64).min).any():
                raise ArithmeticError("a score passes 64 bits")
            out.append((asked_ids[lo:][row], ids[col], s[row, col].astype(np.int64) if whole else s[row, col]))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    keys = ["dim", "d", "q"]
    deal = lambda df: df.repartition(n_parts(data.sparkSession), *keys).groupBy(*keys)
    return deal(left).cogroup(deal(right)).applyInArrow(search, _shape(whole))
