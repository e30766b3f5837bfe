"""Whitening of embeddings by block Lanczos on their covariance, which is never formed.

Each pass over the vectors multiplies the covariance with a block of directions: every task centres its vectors, adds up XᵀXv of its rows, and Spark adds the
sums of the tasks. The driver keeps the basis (vectors of the embeddings' length, as many as that length at most), orthogonalises each new block fully, twice, against all
before it, replaces directions that break down by fresh random ones, and stops when the residuals of the wanted eigenvectors are small or the basis spans the whole
space. The trace comes from the rows' deviations, so shares of variance need no other eigenvalues.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from meshwork.llm.scratch import Scratch
from meshwork.llm.vectors import finite, matrix

#: Fixed values of the contract: entries become floor(SCALE * c) + SHIFT; components at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Directions in a block, the residual at which an eigenvector counts as found (a share of the largest eigenvalue), rows that a task multiplies at once.
BLOCK, RESIDUAL, ROWS = 16, 1e-13, 8192
#: Eigenvalues below this share of the largest are rounding: such components have no unit variance and aren't returned.
RANK = 1e-12


def whole(c: np.ndarray) -> np.ndarray:
    """floor(64c) + 1000000; what a 64-bit integer can't hold is held at its limits."""
    y = np.floor(np.asarray(c, np.float64) * SCALE)
    return np.clip(y, -(2.0**62), 2.0**62).astype(np.int64) + SHIFT


def sums_by_entry(parts: DataFrame) -> dict[int, float]:
    """Adds (i, value) rows of all tasks, on Spark."""
    return {r["i"]: r["v"] for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect()}


class Centre:
    """The exact sums of the fit list, for vectors of one length; tasks hold a copy."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.d = n, len(sums)
        self.sums = np.array(sums, object)
        #: whether n*x - S and its square sum stay far from 64 bits is told row by row, from the largest entry of a batch
        self.small = n < 2**40 and all(abs(s) < 2**61 for s in sums)
        self.exact = self.sums.astype(np.int64) if self.small else self.sums

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: int64 where that is sure to hold it, Python's integers else."""
        if self.small and int(np.abs(x).max(initial=0)) * self.n < 2**61:
            return x * self.n - self.exact
        return x.astype(object) * self.n - self.sums

    def values(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision, one rounding each."""
        return (self.deviations(x) / self.n).astype(np.float64)

    def square_sums(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2; null where 64 bits don't hold one."""
        y = self.deviations(x)
        if y.dtype == np.int64:
            top = int(np.abs(y).max(initial=0))
            if top * top * self.d < 2**63:
                return (y * y).sum(1).tolist()
        return [t if t < 2**63 else None for t in (sum(int(v) ** 2 for v in r) for r in y.tolist())]


class Passes:
    """What is summed over all vectors, a pass over them each."""

    def __init__(self, rows: DataFrame, centre: Centre):
        self.rows, self.centre, self.n = rows, centre, centre.n

    def add_up(self, of) -> dict[int, float]:
        """Sums over all rows of the arrays that `of` makes of a block of centred rows."""
        centre = self.centre

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = matrix(batch.column(0), np.int64)
                for lo in range(0, len(x), ROWS):
                    part = of(centre.values(x[lo : lo + ROWS])).ravel()
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

        return sums_by_entry(self.rows.select("x").mapInArrow(add, "i long, v double"))

    def multiply(self, v: np.ndarray) -> np.ndarray:
        """The covariance times a block of directions: one pass."""
        out = self.add_up(lambda y: y.T @ (y @ v))
        return np.array([out[i] for i in range(v.size)]).reshape(v.shape) / self.n

    def trace(self) -> float:
        """The mean of the rows' deviations, in units of x."""
        return self.add_up(lambda y: np.array([(y * y).sum()]))[0] / self.n

    def identity_error(self, w: np.ndarray) -> float:
        """Largest entry of the whitened vectors' covariance minus the identity."""
        k = w.shape[1]

        def moments(y: np.ndarray) -> np.ndarray:
            z = y @ w
            return np.concatenate([z.sum(0), (z.T @ z).ravel()])

        s = self.add_up(moments)
        mean = np.array([s[i] for i in range(k)]) / self.n
        cov = np.array([s[i] for i in range(k, k + k * k)]).reshape(k, k) / self.n - np.outer(mean, mean)
        return float(np.abs(cov - np.eye(k)).max())


def orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, least: float) -> np.ndarray:
    """Orthonormal directions for a new block, full against the basis, twice; directions that vanish (breakdown) are replaced by random ones as long as the
    space has room."""
    d = len(basis)
    out = np.zeros((d, 0))
    for v in block.T:
        if basis.shape[1] + out.shape[1] == d:
            break
        limit = least
        while True:
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > limit:
                v = v / size
                v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            v, limit = rng.standard_normal(d), 1e-8
    return out


def lanczos(multiply, d: int, wanted: int, block: int = BLOCK, residual: float = RESIDUAL, report: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest `wanted` eigenvalues, falling, and their unit eigenvectors (columns). `multiply` is one pass; `report` gets (basis, worst residual)."""
    rng = np.random.default_rng(0)
    wanted = min(wanted, d)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    new = orthogonal(rng.standard_normal((d, min(block, d))), basis, rng, 1e-8)
    while True:
        product = multiply(new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product])
        t = basis.T @ image
        e, s = np.linalg.eigh((t + t.T) / 2)
        e, s = e[::-1][:wanted], s[:, ::-1][:, :wanted]
        ritz = basis @ s
        worst = float(np.linalg.norm(image @ s - ritz * e, axis=0).max(initial=0))
        top = max(abs(float(e[0])), 0.0)
        if report is not None:
            report.append((basis.shape[1], worst))
        if basis.shape[1] == d or (basis.shape[1] >= wanted and worst <= residual * top):
            return e, ritz / np.linalg.norm(ritz, axis=0)
        new = orthogonal(product, basis, rng, 1e-12 * max(top, 1e-300))


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, report: list | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component.

    Vectors that are null, empty or hold null or non-finite entries are left out. Vectors of different lengths are fitted and whitened by length, each with an
    n of its own. Repeated rows and ids count as often as they stand; null ids stay null. A component whose eigenvalue is zero (equal vectors, fewer vectors
    than components) has no variance to bring to one and isn't returned; an empty table has no rows. Entries are held at 2**62 in size, a deviation beyond
    64 bits is null. Other columns aren't read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")

    def to_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1)
            flat = whole(np.asarray(c.flatten()))
            size = pc.list_value_length(c).to_numpy().astype(np.int32)
            offsets = np.append(0, np.cumsum(size, dtype=np.int32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["vec_id", "d", "x"])

    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("c")).where(finite(F.col("c")))
    rows = scratch.save(good.mapInArrow(to_whole, "vec_id long, d int, x array<long>"), "whole")

    # a row for each length and place, whatever the number of vectors; 38 digits hold the sums
    sums = rows.select("d", F.posexplode("x").alias("j", "v")).groupBy("d", "j").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()
    by_length: dict[int, dict[int, tuple[int, int]]] = {}
    for r in sums:
        by_length.setdefault(r["d"], {})[r["j"]] = (r["n"], int(r["s"]))
    out = spark.createDataFrame([], RESULT)
    for d, per in sorted(by_length.items()):
        n = per[0][0]
        data = Passes(rows.where(F.col("d") == d), Centre(n, [per[j][1] for j in range(d)]))
        trace = data.trace()
        if trace <= 0:
            continue
        e, u = lanczos(data.multiply, d, components, block, report=report)
        kept = e > RANK * e[0]
        e, u = e[kept], u[:, kept]
        w = u / np.sqrt(e)
        error = data.identity_error(w)
        out = out.unionByName(projected(data.rows, data.centre, w, e / trace, error))
    return out


def projected(rows: DataFrame, centre: Centre, w: np.ndarray, explained: np.ndarray, error: float) -> DataFrame:
    k = w.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                x = matrix(batch.column(1).slice(lo, ROWS), np.int64)
                m = len(x)
                ids = batch.column(0).slice(lo, ROWS).take(pa.array(np.repeat(np.arange(m), k)))
                deviation = pa.array(centre.square_sums(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), m)
                columns = [component, np.full(m * k, centre.n), deviation, (centre.values(x) @ w).ravel(), np.tile(explained, m), np.full(m * k, error)]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=[f.split()[0] for f in RESULT.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(project, RESULT)
