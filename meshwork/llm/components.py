"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshwork.llm.scratch import Scratch


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: links a node's larger neighbours to its least neighbour; small: the node itself and its
    smaller neighbours. The result is distinct, u > v."""
    way = edges.select("u", "v")
    if large:
        way = way.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = way.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = way.join(least, F.col("u") == F.col("w"))
    if large:
        new = met.where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("w > m").select(F.col("w").alias("u"), F.col("m").alias("v")))
    return scratch.save(new.distinct(), "edges")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes that have an edge, root being the smallest node of the component. edges: (u, v) in any order;
    loops, nulls and repeated rows don't matter. Rounds grow with the logarithm of the nodes; each is written, so lost executors
    cost tasks only."""
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _print(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        wide = _star(now, scratch, True)
        new = _star(wide, scratch, False)
        scratch.drop(now, wide)
        now, before = new, seen
        seen = _print(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
