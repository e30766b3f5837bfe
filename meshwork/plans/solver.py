"""Multilevel solvers: coarsen, place the coarsest graph, project and refine level by level."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.functions.scalars import adaptive_imbalance, lmax as limit
from meshwork.kernels import multilevel
from meshwork.kernels.local import Local
from meshwork.kernels.split import split
from meshwork.operators import bisection, coarsen, metrics, refine
from meshwork.operators.paths import global_paths
from meshwork.operators.rounds import Rounds
from meshwork.sources.files import write_metis
from meshwork.sources.graph import Graph


@dataclass(frozen=True)
class Profile:
    """c: the coarsest graph has about k * c vertices; trials: seeds of the initial placement; lp, pairs, flow: rounds of each refiner;
    again: how often a pair's cut is replaced in a round of flows; cycles: how often the solve is repeated inside the blocks."""

    c: int = 8
    coarsening: str = "matching"
    rating: str = "expansion_star"
    initial: str = "flow"
    trials: int = 6
    lp: int = 5
    pairs: int = 2
    flow: int = 0
    again: int = 5
    alpha: float = 2.0
    swaps: int = 0
    cycles: int = 0


PROFILES = {
    "fast": Profile(),
    "eco": Profile(trials=8, flow=5),
    "strong": Profile(c=64, trials=16, flow=5),
    "super-strong": Profile(c=64, trials=16, flow=5, again=10, alpha=8.0, cycles=2),
    "experimental": Profile(coarsening="clustering", flow=1, swaps=1),
}


def _weight(graph: Graph) -> int:
    return graph.vertices.agg(F.coalesce(F.sum("vw"), F.lit(0))).first()[0]


#: A cluster weighs at most the block limit over SHARE at first; where a level leaves more than STALL of the vertices that is halved, down to LEAST_SHARE.
SHARE, LEAST_SHARE, STALL = 18.0, 4.0, 0.95
#: Graphs of so many arcs at most are solved in one task (each trial in its own); a parameter of the solvers. 0: all levels run in Spark.
LOCAL_ARCS = 200_000
#: A bisection by jobs gets so many vertices at most: larger graphs are coarsened in Spark first, as a job's search takes time in the square of its item. Fixed value.
JOBS_AT = 1_000


def _trial_kernel(m: Machine, lmax: int, weight: int, eps: float, p: Profile, method: str, seed: int):
    def run(key, vs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        vs = vs.sort_values("u")
        trial = int(key[0])
        g = Local(vs["u"], vs["vw"], es[["u", "v", "w"]].itertuples(index=False, name=None))
        pid = multilevel.solve(g, m, lmax, weight, eps, p.c, method, p.lp, p.pairs, p.flow, p.alpha, seed * 1000 + trial, p.again)
        loads = [0] * m.k
        for w, b in zip(g.vw, pid, strict=True):
            loads[b] += w
        return pd.DataFrame({"trial": trial, "u": g.ids, "pid": pid, "overload": sum(max(0, x - lmax) for x in loads), "qap": g.cost(pid, m.between)})

    return run


def initial(graph: Graph, m: Machine, lmax: int, method: str = "flow", trials: int = 3, seed: int = 0, weight: int | None = None, eps: float = 0.03, profile: Profile | None = None) -> DataFrame:
    """Places a graph of bounded size (LOCAL_ARCS, or k * c vertices): multilevel multisection, outermost level first, in one task for each of `trials` seeds; the
    best counts, balanced ones first. method: "flow", "ggg" (growing) or "greedy"; "jobs" bisects all parts of a level together, a task for each pair of seeds, after
    graphs of more than JOBS_AT vertices were coarsened to so many; label propagation follows on each level on the way back."""
    weight = _weight(graph) if weight is None else weight
    p = profile or Profile()
    if method == "jobs":
        stack = coarse_levels(graph, JOBS_AT, max(1, weight // (m.k * 2)), p, seed=seed)
        coarsest = stack[-1][0]
        assign = refine.rebalance(coarsest, bisection.multisection(coarsest, m, lmax, pool=1 if trials == 1 else 4, salt=seed), m, lmax)
        for depth in range(len(stack) - 2, -1, -1):
            g, mapping = stack[depth]
            assign = improve(g, Rounds(g.edges.sparkSession).keep(coarsen.project(assign, mapping)), m, lmax, replace(p, pairs=0, swaps=0, flow=0), seed + depth)
        return assign
    seeds = F.explode(F.sequence(F.lit(0), F.lit(max(1, trials) - 1))).alias("trial")
    vertices, edges = graph.vertices.select(seeds, "u", "vw"), graph.edges.select(seeds, "u", "v", "w")
    run = _trial_kernel(m, lmax, weight, eps, p, method, seed)
    tried = vertices.groupBy("trial").cogroup(edges.groupBy("trial")).applyInPandas(run, "trial int, u long, pid long, overload long, qap long")
    tried = Rounds(graph.edges.sparkSession).keep(tried)
    best = refine.better(tried.groupBy("trial").agg(F.first("overload").alias("overload"), F.first("qap").alias("qap")))
    return tried.join(F.broadcast(best), "trial").select("u", "pid")


def coarse_levels(graph: Graph, target: int, cap: int, p: Profile, assign: DataFrame | None = None, seed: int = 0, most: int = 60, local_arcs: int = 0) -> list[tuple[Graph, DataFrame]]:
    """[(graph, mapping to the next coarser)], finest first, until `target` vertices, or `local_arcs` arcs. Where matching leaves more than
    a quarter of the vertices, those with common neighbours are paired; where clustering stalls, clusters may become heavier and those of one vertex are merged; where
    that isn't enough either, any two vertices. So only the cap ends it: below twice the weight / cap, a bounded number, vertices are left."""
    state = Rounds(graph.edges.sparkSession)
    out, n, share = [], graph.vertices.count(), SHARE
    for level in range(most):
        if n <= target or (local_arcs and graph.edges.count() <= local_arcs):
            break
        if p.coarsening == "clustering":
            while True:  # where clustering stalls, clusters may weigh twice as much
                room = max(1, -int(-2 * cap // share))
                clusters = coarsen.cluster(graph, room, 3, seed=seed + level, assign=assign)
                if assign is None and clusters.select("c").distinct().count() > 0.5 * n:
                    clusters = coarsen.merge_singletons(graph, clusters, room)
                if share <= LEAST_SHARE or clusters.select("c").distinct().count() <= STALL * n:
                    break
                share = max(LEAST_SHARE, share / 2)
            mapping = state.keep(clusters)
            count = mapping.select("c").distinct().count()
        else:
            if p.coarsening == "paths":
                pairs = global_paths(coarsen.rated(graph.vertices, graph.edges, p.rating, cap, assign), seed + level)
            else:
                pairs = state.keep(coarsen.matching(graph.vertices, graph.edges, p.rating, cap, assign, seed + level, target=0.8))
            pairs = coarsen.two_hop(graph.vertices, graph.edges, pairs, cap, assign)
            count = n - pairs.count()
            if count <= 0.95 * n:
                mapping = state.keep(coarsen.mapping_of(graph.vertices, pairs))
        if count > 0.95 * n:
            pairs = state.keep(coarsen.pair_any(graph.vertices, pairs if p.coarsening != "clustering" else graph.edges.select("u", "v").limit(0), cap, assign))
            count = n - pairs.count()
            mapping = state.keep(coarsen.mapping_of(graph.vertices, pairs))
        if count > 0.95 * n:
            break
        small = coarsen.contract(graph, mapping)
        small = state.graph(small)
        out.append((graph, mapping))
        if assign is not None:
            assign = state.keep(coarsen.contract_assign(assign, mapping))
        graph, n = small, count
    out.append((graph, None))
    return out


def filled(graph: Graph, assign: DataFrame, m: Machine, lmax: int) -> DataFrame:
    """No block stays empty while others hold several vertices."""
    if metrics.balance(metrics.block_weights(graph.vertices, assign, m.k), lmax).first()["n_empty"]:
        assign = Rounds(graph.edges.sparkSession).keep(refine.fill_empty(graph, assign, m, lmax))
    return assign


def improve(graph: Graph, assign: DataFrame, m: Machine, lmax: int, p: Profile, seed: int = 0) -> DataFrame:
    assign = refine.rebalance(graph, assign, m, lmax)
    assign = refine.label_propagation(graph, assign, m, lmax, p.lp, seed)
    if p.pairs:
        assign = refine.refine_pairs(graph, assign, m, lmax, "fm", p.pairs)
    if p.swaps:
        assign = refine.refine_pairs(graph, assign, m, lmax, "swap", p.swaps)
    if p.flow:
        assign = refine.refine_pairs(graph, assign, m, lmax, "flow", p.flow, p.alpha, again=p.again)
    return assign


def solve(graph: Graph, m: Machine, eps: float = 0.03, profile: str | Profile = "fast", seed: int = 0, levels: list | None = None, local_arcs: int | None = None, dump: str | None = None) -> DataFrame:
    """(u, pid): a placement on the machine with block weights up to ceil((1 + eps) * W / k). `levels` collects a row of figures for each
    level; `dump` names a folder for the coarsest graph, as a METIS graph."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    state = Rounds(graph.edges.sparkSession)
    graph = state.graph(graph)
    weight = _weight(graph)
    most = limit(weight, m.k, eps)
    if not weight:
        return graph.vertices.select("u", F.lit(0).cast("long").alias("pid"))
    stack = coarse_levels(graph, m.k * p.c, max(1, weight // (m.k * 2)), p, seed=seed, local_arcs=LOCAL_ARCS if local_arcs is None else local_arcs)
    coarsest = stack[-1][0]
    if dump is not None:
        write_metis(coarsest, dump)
    assign = state.keep(initial(coarsest, m, most, p.initial, p.trials, seed, weight, eps, p))
    if levels is not None:
        levels.append(_figures(coarsest, assign, m, most, len(stack) - 1))
    for depth in range(len(stack) - 2, -1, -1):
        g, mapping = stack[depth]
        assign = state.keep(coarsen.project(assign, mapping))
        assign = improve(g, assign, m, most, p, seed + depth)
        if levels is not None:
            levels.append(_figures(g, assign, m, most, depth))
    for cycle in range(p.cycles if len(stack) > 1 else 0):  # again inside the blocks: coarsening keeps the placement, refinement can only improve it
        stack = coarse_levels(graph, m.k * p.c, max(1, weight // (m.k * 2)), p, assign, seed + 77 + cycle)
        for g, mapping in stack[:-1]:
            assign = coarsen.contract_assign(assign, mapping)
        assign = improve(stack[-1][0], state.keep(assign), m, most, p, seed)
        for g, mapping in reversed(stack[:-1]):
            assign = improve(g, state.keep(coarsen.project(assign, mapping)), m, most, p, seed)
    return filled(graph, state.keep(assign), m, most)


def _figures(graph: Graph, assign: DataFrame, m: Machine, lmax: int, level: int) -> dict:
    row = metrics.balance(metrics.block_weights(graph.vertices, assign, m.k), lmax).first()
    return {"level": level, "n": graph.vertices.count(), "m": graph.edges.count(), "qap": refine.cost(graph, assign, m), "max_weight": row["max_weight"], "lmax": lmax, "n_empty": row["n_empty"], "n_overloaded": row["n_overloaded"]}


def level_table(spark: SparkSession, levels: list[dict]) -> DataFrame:
    return spark.createDataFrame(levels, "level int, n long, m long, qap long, max_weight long, lmax long, n_empty long, n_overloaded long")


def partition(graph: Graph, k: int, eps: float = 0.03, profile: str | Profile = "fast", seed: int = 0, local_arcs: int | None = None) -> DataFrame:
    """(u, pid): k blocks with a small edge cut; a mapping onto a flat machine."""
    return solve(graph, Machine.flat(k), eps, profile, seed, local_arcs=local_arcs)


def solve_by_levels(graph: Graph, m: Machine, eps: float = 0.03, profile: str | Profile = "fast", seed: int = 0, top: int = 1) -> DataFrame:
    """Splits the `top` outermost levels first, then solves each part on its own for the rest of the machine with what imbalance is left."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    if top <= 0 or len(m.sizes) == 1:
        return solve(graph, m, eps, p, seed)
    state = Rounds(graph.edges.sparkSession)
    weight = _weight(graph)
    outer, inner = m.sizes[-1], Machine(m.sizes[:-1], m.distances[:-1])
    depth = len(m.sizes)
    free = max(0.001, adaptive_imbalance(eps, weight, m.k, weight, m.k, depth, None))
    parts = state.keep(partition(graph, outer, free, p, seed))
    ea = state.keep(metrics.induced(metrics.placed(graph.edges, parts)))
    out = None
    for i in range(outer):
        own = Graph(graph.vertices.join(parts.where(F.col("pid") == i).select("u"), "u", "left_semi"), ea.where(F.col("pid") == i).select("u", "v", "w"))
        local = _weight(own)
        if not local:
            continue
        rest = max(0.001, adaptive_imbalance(eps, weight, m.k, local, inner.k, 1, None))
        got = solve_by_levels(own, inner, rest, p, seed + i, top - 1).select("u", (F.col("pid") + i * inner.k).alias("pid"))
        out = got if out is None else out.unionByName(got)
    return refine.rebalance(graph, state.keep(out), m, limit(weight, m.k, eps))


def solve_deep(graph: Graph, m: Machine, eps: float = 0.03, profile: str | Profile = "fast", seed: int = 0, local_arcs: int | None = None) -> DataFrame:
    """For very many PEs: only the outermost level is split on the coarsest graph; blocks are split further while uncoarsening, as soon as
    the level's graph is large enough for them. Child i of a block has the id block + stride * i. Coarsening ends at `local_arcs` arcs; where that graph is
    large enough for all blocks, the kernel goes level by level in one task and what follows is refinement."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    state = Rounds(graph.edges.sparkSession)
    graph = state.graph(graph)
    weight = _weight(graph)
    final, local_arcs = limit(weight, m.k, eps), LOCAL_ARCS if local_arcs is None else local_arcs
    if weight and graph.edges.count() <= local_arcs:
        return initial(graph, m, final, p.initial, p.trials, seed, weight, eps, p)
    stack = coarse_levels(graph, m.sizes[-1] * p.c, max(1, weight // (m.sizes[-1] * 4)), p, seed=seed, local_arcs=local_arcs)
    coarsest, split_to = stack[-1][0], 0
    size = coarsest.vertices.agg(F.count("*").alias("n"), F.coalesce(F.max("vw"), F.lit(0)).alias("heaviest")).first()
    if size["n"] >= m.k * p.c and 2 * size["heaviest"] <= final and coarsest.edges.count() <= local_arcs:
        assign, split_to = state.keep(initial(coarsest, m, final, p.initial, p.trials, seed, weight, eps, p)), len(m.sizes)
    else:
        assign = state.keep(coarsest.vertices.select("u", F.lit(0).cast("long").alias("pid")))
    for depth in range(len(stack) - 1, -1, -1):
        g, mapping = stack[depth]
        if mapping is not None:
            assign = state.keep(coarsen.project(assign, mapping))
        n = g.vertices.count()
        levels = len(m.sizes)
        while split_to < levels:
            blocks_next = _blocks(m, split_to + 1)
            if depth and split_to and n < blocks_next * p.c:
                break
            assign = state.keep(_split_blocks(g, assign, m, levels - 1 - split_to, final, p, seed, weight, eps))
            split_to += 1
        # the machine as far as it is split: outer levels only, ids are multiples of the stride
        stride = m.strides[levels - 1 - split_to] if split_to < levels else 1
        outer = Machine(m.sizes[levels - split_to :], m.distances[levels - split_to :])
        own = assign.select("u", F.floor(F.col("pid") / stride).cast("long").alias("pid"))
        own = improve(g, own, outer, final * stride, p, seed + depth)
        assign = state.keep(own.select("u", (F.col("pid") * stride).alias("pid")))
    return assign


def _blocks(m: Machine, outer_levels: int) -> int:
    out = 1
    for s in m.sizes[len(m.sizes) - outer_levels :]:
        out *= s
    return out


def _split_blocks(g: Graph, assign: DataFrame, m: Machine, level: int, lmax: int, p: Profile, seed: int, weight: int, eps: float) -> DataFrame:
    """Splits each block by one level of the machine."""
    one = Machine((m.sizes[level],), (1,))
    stride = m.strides[level - 1] if level else 1
    inner = metrics.induced(metrics.placed(g.edges, assign)).select("u", "v", "w")

    def run(key, vs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        vs = vs.sort_values("u")
        local = Local(vs["u"], vs["vw"], es[["u", "v", "w"]].itertuples(index=False, name=None))
        most = max(lmax * stride, -(-local.total // one.k))
        part = split(local, one.k, most, "flow" if p.initial == "flow" else "ggg", 2, seed + int(key[0]))
        return pd.DataFrame({"u": local.ids, "pid": [int(key[0]) + stride * x for x in part]})

    tagged = inner.join(assign, "u").withColumn("pid", F.col("pid") + 0)  # a column of its own for the cogroup
    return assign.join(g.vertices, "u").groupBy("pid").cogroup(tagged.groupBy("pid")).applyInPandas(run, "u long, pid long")


def profile_with(name: str, **changes) -> Profile:
    return replace(PROFILES[name], **changes)
