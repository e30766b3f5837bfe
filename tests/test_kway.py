"""The k-way partitioner: pairs by shared neighbours, keys, moves between both limits, and whole partitions."""

import math
import random

from pyspark.sql import functions as F

from meshwork.operators import gains, kway, metrics, refine
from meshwork.operators.rounds import Rounds
from meshwork.plans.solver import partition
from meshwork.sources.graph import Graph


def grid(spark, h, w):
    return Graph.from_lists(spark, h * w, [(u, u + 1, 1 + u % 2) for u in range(h * w) if u % w != w - 1] + [(u, u + w, 1) for u in range(h * w - w)])


def test_no_two_free_vertices_share_a_neighbour_afterwards(spark):
    rng = random.Random(3)
    arcs = {(min(e), max(e)) for e in (rng.sample(range(40), 2) for _ in range(60))}
    g = Graph.from_lists(spark, 40, [(u, v, 1) for u, v in arcs])
    near = {u: {b if a == u else a for a, b in arcs if u in (a, b)} for u in range(40)}
    free = g.vertices.where("u % 3 <> 0")
    for below in (None, 3):
        able = {u for u in range(40) if u % 3 and near[u] and (below is None or len(near[u]) < below)}
        got = [(r["u"], r["v"]) for r in kway.sharing(g.edges, free, below).collect()]
        used = [x for p in got for x in p]
        assert len(used) == len(set(used)) and set(used) <= able and all(near[u] & near[v] for u, v in got)
        rest = sorted(able - set(used))
        assert not any(near[u] & near[v] for u in rest for v in rest if u < v)


def test_star_and_vertices_without_edges_are_matched(spark):
    g = Graph.from_lists(spark, 30, [(0, u, 1) for u in range(1, 20)])
    steps = []
    pairs = kway.match(g, 10, report=steps).collect()
    used = [x for r in pairs for x in (r["u"], r["v"])]
    assert len(used) == len(set(used)) == 30 and steps == [("any", 2)]


def test_moves_keep_both_limits_and_the_cut_falls_by_the_gains(spark):
    g = grid(spark, 10, 12)
    a = g.vertices.select("u", F.floor(F.col("u") * 7 % 120 / 30).cast("long").alias("pid"))
    cut = lambda x: metrics.edge_cut(metrics.placed(g.edges, x)).first()["edge_cut"]
    state = Rounds(spark)
    weights = state.keep(refine.blocks_of(g, a, 4, 36))
    conn = state.keep(metrics.block_conn(metrics.placed(g.edges, a)))
    for r in kway.keys(conn, a).collect():
        assert r["n_blocks"] > 0 and math.isclose(r["key"], r["ext"] / math.sqrt(r["n_blocks"]) - r["own"])
    b = kway.optimise(g, a, 4, 26, 36, 3)
    loads = [r["bweight"] for r in refine.blocks_of(g, b, 4, 36).collect()]
    assert b.count() == 120 and all(26 <= x <= 36 for x in loads) and cut(b) < cut(a)
    skew = g.vertices.select("u", F.when(F.col("u") < 90, 0).otherwise(F.col("u") % 3 + 1).cast("long").alias("pid"))
    c = kway.optimise(g, skew, 4, 26, 36, 5, True)
    assert max(r["bweight"] for r in refine.blocks_of(g, c, 4, 36).collect()) < 90
    asked = state.keep(kway.wanted(conn, a, g.vertices, weights, 26, 36))
    alone = asked.join(gains.independent(asked.select("u", "gain"), g.edges, 0).select("u"), "u", "left_semi")
    moves = state.keep(kway.taken(alone, weights, 26, 36, state))
    gained = [r["gain"] for r in moves.collect()]
    assert gained and min(gained) >= 0 and cut(a) - cut(gains.apply_moves(a, moves)) == sum(gained)


def test_partition_is_balanced_and_near_the_other_one(spark):
    """Cut at most 1.5 times that of the kernel's multilevel partition, and both within the limit."""
    g = grid(spark, 14, 14)
    most = math.ceil(1.1 * 196 / 4)
    cut = lambda x: metrics.edge_cut(metrics.placed(g.edges, x)).first()["edge_cut"]
    own, other = (x.cache() for x in (kway.partition(g, 4, 0.1, tries=1), partition(g, 4, 0.1)))
    assert own.count() == 196 and metrics.balance(metrics.block_weights(g.vertices, own, 4), most).first()["n_overloaded"] == 0
    assert cut(own) <= 1.5 * cut(other)
    assert kway.partition(g, 1).select("pid").distinct().count() == 1
