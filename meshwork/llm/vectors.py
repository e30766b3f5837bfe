"""Vectors as numpy matrices: Arrow columns, blocks of rows, and top-k merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def matrix(column, dtype=np.float64) -> np.ndarray:
    """Rows of equal length."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(a.flatten(), dtype)
    return flat.reshape(len(a), -1) if len(a) else flat.reshape(0, 0)


def finite(vector: Column, zero_too: bool = False) -> Column:
    """Whether a vector has components, none of them null or not finite (and, with zero_too, one that isn't 0)."""
    inf = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    ok = vector.isNotNull() & (F.size(vector) > 0) & ~bad
    return ok & F.exists(vector, lambda x: x != 0) if zero_too else ok


def best(found: DataFrame, k: int, *by: Column) -> DataFrame:
    """The first k rows of each query in the given order, with rank. Spark keeps k of each query in each task before the shuffle."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)


def top_rows(score: np.ndarray, ids: np.ndarray, own: np.ndarray | None, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores, ties to the smaller id; with `own`, columns of the row's own id are left out. With `slack`, all
    that come within this share of the kth score, for scores that are computed again."""
    n = score.shape[1]
    allowed = np.ones(score.shape, bool) if own is None else ids[None, :] != own[:, None]
    if n > k:
        low = -np.inf if score.dtype.kind == "f" else np.iinfo(score.dtype).min
        masked = np.where(allowed, score, low)
        kth = np.partition(masked, n - k, axis=1)[:, n - k]
        allowed &= score >= (kth - slack * (np.abs(kth) + 1) if slack else kth)[:, None]
    row, col = np.nonzero(allowed)
    if slack:
        return row, col
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]
