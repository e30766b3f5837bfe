"""Scalar functions of the engine: edge ratings, imbalance rules, small arithmetic and string helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RATINGS = ("weight", "expansion", "expansion_star", "expansion_star2", "inner_outer")


def rating(kind: str, w: Column, cu: Column, cv: Column, out_u: Column | None = None, out_v: Column | None = None) -> Column:
    """How much contracting an edge of weight w between vertices of weight cu and cv helps; out: weighted degrees."""
    w = w.cast("double")
    if kind == "weight":
        return w
    if kind == "expansion":
        return w / (cu + cv)
    if kind == "expansion_star":
        return w / (cu * cv)
    if kind == "expansion_star2":
        return w * w / (cu * cv)
    if kind == "inner_outer":
        rest = out_u + out_v - 2 * w
        return F.when(rest > 0, w / rest).otherwise(F.lit(float("inf")))
    raise ValueError(f"unknown rating {kind}; one of {', '.join(RATINGS)}")


def lmax(total: int | Column, k: int, eps: float, rule: str = "ceil"):
    """The largest allowed block weight: ceil((1+eps) * W/k), or the greedy partitioners' rule, truncated after an integer W/k."""
    import math

    if rule == "ceil":
        return math.ceil((1 + eps) * (total / k)) if not isinstance(total, Column) else F.ceil((1 + eps) * (total / k))
    if rule == "trunc":
        return int((1 + eps) * (total // k)) if not isinstance(total, Column) else F.floor((1 + eps) * F.floor(total / k))
    raise ValueError(f"unknown rule {rule}")


def adaptive_imbalance(eps, weight, k, local_weight, local_k, depth, floor: float | None = 0.0):
    """The imbalance that one of `depth` further splits of a part may use, so that the leaves keep the global bound. Columns or numbers."""
    base = (1 + eps) * local_k * weight / (k * local_weight)
    if isinstance(base, Column) or isinstance(depth, Column):
        out = F.pow(base, 1 / depth) - 1
        return F.greatest(out, F.lit(floor)) if floor is not None else out
    out = base ** (1 / depth) - 1
    return max(out, floor) if floor is not None else out


def unhash(x: Column, seed: int = 0) -> Column:
    """A cheap hash of ids below 2^31 that other engines can reproduce: a multiplication modulo 2^31."""
    return (x * F.lit(2654435761) + F.lit(seed)) % F.lit(2147483648)


def product(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(1).cast("long"), lambda a, x: a * x.cast("long"))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def largest(xs: Column) -> Column:
    return F.array_max(xs)


def ints(text: Column, sep: str = ":") -> Column:
    """`4:8:6` as an array of longs; empty parts are dropped."""
    return F.transform(F.filter(F.split(F.trim(text), sep, -1), lambda x: x != ""), lambda x: x.cast("long"))


def floor_log2(x: Column) -> Column:
    return F.length(F.bin(x)) - 1


def bits_needed(x: Column) -> Column:
    """At least 1."""
    return F.length(F.bin(x))


def round_up_64(x: Column) -> Column:
    return F.floor((x + 63) / 64) * 64


def to_binary(x: Column) -> Column:
    return F.bin(x)
