"""A k-way partitioner of its own: matching with shared neighbours, bisections at the coarsest level, and moves between all blocks between a smallest and a largest weight."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.operators import bisection, coarsen, gains, metrics, refine
from meshwork.operators.rounds import Rounds, ranked
from meshwork.sources.graph import Graph

#: Steps by shared neighbours are taken while more than UNMATCHED of the vertices are free; each is a kind and the degree that a vertex must stay below (None: any).
UNMATCHED = 0.1
STEPS = (("any", 2), ("twins", 64), ("any", 3), ("any", None))
#: A level that keeps more than SHRINK of the vertices is the last.
SHRINK = 0.85


def sharing(edges: DataFrame, free: DataFrame, below: int | None = None) -> DataFrame:
    """(u, v), u < v: free vertices with fewer than `below` neighbours are paired with others that share any neighbour, until no two are left that do.

    In a round each vertex goes to the one of its neighbours that has most free neighbours, and those that meet there are paired in order; the neighbour with most of all gets all of its
    own, so every round pairs some. A neighbour may have all vertices on it: they are numbered over range partitions.
    """
    state = Rounds(edges.sparkSession)
    few = edges if below is None else edges.join(edges.groupBy("u").agg(F.count("*").alias("d")).where(F.col("d") < below).select("u"), "u", "left_semi")
    open_ = state.keep(few.join(free.select("u"), "u", "left_semi").select("u", F.col("v").alias("mid")))
    out = state.keep(open_.select("u", F.col("mid").alias("v")).limit(0))
    while True:
        sizes = open_.groupBy("mid").agg(F.count("*").alias("n")).where("n > 1")
        goes = open_.join(sizes, "mid").groupBy("u").agg(F.max(F.struct("n", (-F.col("mid")).alias("neg"))).alias("x")).select("u", (-F.col("x.neg")).alias("mid"))
        pairs = state.keep(coarsen._paired(goes, ["mid"]))
        if not pairs.head(1):
            return out
        out = state.keep(out.unionByName(pairs))
        open_ = state.keep(open_.join(coarsen.ends(pairs), "u", "left_anti"))


def match(graph: Graph, cap: int, seed: int = 0, report: list | None = None) -> DataFrame:
    """(u, v), u < v: heavy edges by handshakes, vertices without edges in twos, then those that share neighbours. Pairs weigh `cap` at most. `report` gets the steps taken."""
    state = Rounds(graph.edges.sparkSession)
    n = graph.vertices.count()
    pairs = state.keep(coarsen.matching(graph.vertices, graph.edges, "weight", cap, seed=seed))
    lone = graph.vertices.join(graph.edges.select("u"), "u", "left_anti")
    pairs = state.keep(pairs.unionByName(coarsen.pair_any(lone, pairs.limit(0), cap)))
    for kind, below in STEPS:
        free = state.keep(graph.vertices.join(coarsen.ends(pairs), "u", "left_anti"))
        if free.count() <= UNMATCHED * n:
            break
        if report is not None:
            report.append((kind, below))
        if kind == "twins":
            own = graph.edges.join(free.select("u"), "u", "left_semi")
            few = own.groupBy("u").agg(F.count("*").alias("d")).where(F.col("d") < below)
            more = coarsen.twins(own.join(few.select("u"), "u", "left_semi"))
        else:
            more = sharing(graph.edges, free, below)
        pairs = state.keep(pairs.unionByName(coarsen.allowed(more, graph.vertices, cap).select("u", "v")))
    return pairs


def keys(conn: DataFrame, assign: DataFrame) -> DataFrame:
    """(u, old_id, own, ext, n_blocks, key) of the boundary: the weights of a vertex's edges inside and to other blocks, and in what order it is tried: by ext over the root
    of the number of other blocks, less own."""
    met = conn.join(assign, "u")
    other = F.col("id") != F.col("pid")
    row = met.groupBy("u", F.col("pid").alias("old_id")).agg(
        F.sum(F.when(other, 0).otherwise(F.col("w"))).cast("long").alias("own"), F.sum(F.when(other, F.col("w")).otherwise(0)).cast("long").alias("ext"), F.sum(F.when(other, 1).otherwise(0)).cast("long").alias("n_blocks"))
    return row.where("n_blocks > 0").withColumn("key", F.col("ext") / F.sqrt("n_blocks") - F.col("own"))


def wanted(conn: DataFrame, assign: DataFrame, vertices: DataFrame, weights: DataFrame, low: int, high: int, balance: bool = False) -> DataFrame:
    """(u, old_id, new_id, gain, key, vw): each boundary vertex's best block. A move gains, or goes to a block that is lighter by more than the vertex; it leaves
    `low` behind and fills up to `high`, unless the target stays lighter than the source. In balance mode it must leave a block above `high` or enter one below `low`, at any price.

    weights: (pid, bweight). Of like gains the lighter block counts, then the smaller number."""
    old, new = (weights.select(F.col("pid").alias(f"{x}_id"), F.col("bweight").alias(f"{x}_w")) for x in ("old", "new"))
    to = conn.select("u", F.col("id").alias("new_id"), F.col("w").alias("to_w"))
    met = keys(conn, assign).join(to, "u").where("new_id <> old_id").join(vertices, "u").join(old, "old_id").join(new, "new_id")
    met = met.withColumn("gain", (F.col("to_w") - F.col("own")).cast("long"))
    left = F.col("old_w") - F.col("vw")
    lighter = F.col("new_w") < left
    fits = (F.col("new_w") + F.col("vw") <= high) & (left >= low)
    if balance:
        may = ((F.col("old_w") > high) & (F.col("new_w") + F.col("vw") <= high)) | ((F.col("new_w") < low) & (left >= low))
    else:
        may = ((F.col("gain") > 0) & (fits | lighter)) | ((F.col("gain") == 0) & lighter)
    first = Window.partitionBy("u").orderBy(F.desc("gain"), "new_w", "new_id")
    return met.where(may).withColumn("r", F.row_number().over(first)).where("r = 1").select("u", "old_id", "new_id", "gain", "key", "vw")


def taken(moves: DataFrame, weights: DataFrame, low: int, high: int, state: Rounds, balance: bool = False) -> DataFrame:
    """Of the moves, by falling key, those after which no target is above `high` and no source below `low`, whichever others are made. In balance mode only as many as the
    overload of the source or the lack of the target asks for. A block may have all moves: the sums run over range partitions."""
    order = F.col("key")
    rows = moves.withColumn("__neg", -order)
    into = ranked(rows, ["new_id"], ["__neg", "u"], state, "vw").withColumnsRenamed({"ahead": "__in"}).drop("rank")
    both = ranked(into, ["old_id"], ["__neg", "u"], state, "vw").withColumnsRenamed({"ahead": "__out"}).drop("rank")
    old, new = (weights.select(F.col("pid").alias(f"{x}_id"), F.col("bweight").alias(f"{x}_w")) for x in ("old", "new"))
    met = both.join(F.broadcast(old), "old_id").join(F.broadcast(new), "new_id")
    ok = F.col("new_w") + F.col("__in") + F.col("vw") <= high
    leaves = F.col("old_w") - F.col("__out") - F.col("vw") >= low
    if balance:
        ok &= leaves & ((F.col("old_w") - F.col("__out") > high) | (F.col("new_w") + F.col("__in") < low))
    else:
        ok &= leaves
    return met.where(ok).select("u", "old_id", "new_id", "gain")


def optimise(graph: Graph, assign: DataFrame, k: int, low: int, high: int, rounds: int = 8, balance: bool = False, seed: int = 0) -> DataFrame:
    """(u, pid) after rounds of moves. Movers of a round aren't adjacent, so the cut falls by exactly the sum of their gains. Weights and connections are kept from the moves."""
    state = Rounds(graph.edges.sparkSession)
    assign = state.keep(assign)
    conn = state.keep(metrics.block_conn(metrics.placed(graph.edges, assign)))
    weights = state.keep(refine.blocks_of(graph, assign, k, high))
    for i in range(rounds):
        asked = state.keep(wanted(conn, assign, graph.vertices, weights, low, high, balance))
        alone = gains.independent(asked.select("u", "gain"), graph.edges, seed + i)
        moves = state.keep(taken(asked.join(alone.select("u"), "u", "left_semi"), weights, low, high, state, balance))
        if not moves.head(1):
            break
        before, assign = assign, state.keep(gains.apply_moves(assign, moves))
        conn = state.keep(gains.moved_conn(conn, graph.edges, moves))
        weights = state.keep(gains.moved_weights(weights, graph.vertices, moves))
        state.drop(before, asked)
    return assign


def partition(graph: Graph, k: int, eps: float = 0.03, seed: int = 0, tries: int = 2) -> DataFrame:
    """(u, pid): k blocks of at most ceil((1 + eps) * W / k), if the vertices allow it. Coarsened to max(n / (40 log2 k), 30 k) vertices, or until a level keeps most of them;
    the best of some multisections by weight, then cut."""
    state = Rounds(graph.edges.sparkSession)
    if k < 2:
        return graph.vertices.select("u", F.lit(0).cast("long").alias("pid"))
    weight, n = graph.vertices.agg(F.coalesce(F.sum("vw"), F.lit(0)), F.count("*")).first()
    high, low = math.ceil((1 + eps) * weight / k), int(weight / k / (1 + eps))
    least, stack = max(n / (40 * math.log2(k)), 30 * k), []
    now = Graph(state.keep(graph.vertices), state.keep(graph.edges))
    while n > least:
        mapping = state.keep(coarsen.mapping_of(now.vertices, match(now, max(1, int(1.5 * weight / least)), seed + len(stack))))
        small = coarsen.contract(now, mapping)
        small = Graph(state.keep(small.vertices), state.keep(small.edges))
        stack.append((now, mapping))
        count = small.vertices.count()
        now, shrunk, n = small, count <= SHRINK * n, count
        if not shrunk:
            break
    best = None
    for i in range(tries):
        a = state.keep(refine.rebalance(now, bisection.multisection(now, Machine.flat(k), high, n_seeds=3, pool=3, salt=seed + i), Machine.flat(k), high))
        over = metrics.balance(metrics.block_weights(now.vertices, a, k), high).first()["overload"]
        key = (over, metrics.edge_cut(metrics.placed(now.edges, a)).first()["edge_cut"])
        if best is None or key < best[0]:
            best = (key, a)
    assign = best[1] if best else None
    while True:
        assign = optimise(now, assign, k, low, high, 4, True, seed)
        assign = optimise(now, assign, k, low, high, 8, False, seed)
        if not stack:
            return assign
        now, mapping = stack.pop()
        assign = state.keep(coarsen.project(assign, mapping))
