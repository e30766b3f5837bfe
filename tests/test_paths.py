"""Global paths on Spark against the kernel on one graph, numbering in order, and what coarsening leaves."""

import random

from pyspark.sql import functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.functions.scalars import lmax
from meshwork.kernels import paths as kernel
from meshwork.operators import coarsen
from meshwork.operators.paths import chosen, global_paths, path_scores
from meshwork.operators.rounds import Rounds, ranked
from meshwork.plans import solver
from meshwork.sources.graph import Graph
from meshwork.streaming import dynamic

EDGES = "u long, v long, r double"


def pairs_of(spark, rows):
    return [(r["u"], r["v"]) for r in global_paths(spark.createDataFrame(rows, EDGES)).collect()]


def test_paths_are_those_of_the_kernel(spark):
    """With ratings that all differ, up to odd cycles; in total rating never below."""
    rng = random.Random(1)
    for n, m in ((7, 9), (40, 150)):
        es = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        rows = [(u, v, float(r)) for (u, v), r in zip(es, rng.sample(range(1, 10**6), len(es)), strict=True)]
        weight = {(u, v): r for u, v, r in rows}
        got, want = pairs_of(spark, rows), kernel.global_paths([(r, u, v) for u, v, r in rows])
        used = [x for p in got for x in p]
        assert len(used) == len(set(used)) and sum(weight[p] for p in got) >= sum(weight[p] for p in want)


def test_cycles(spark):
    """An even cycle whose best edges alternate, and an odd one, which loses its lightest edge."""
    even = [(10, 11, 5.0), (11, 12, 9.0), (12, 13, 5.0), (13, 14, 9.0), (14, 15, 5.0), (10, 15, 9.0)]
    odd = [(20, 21, 3.0), (21, 22, 2.0), (20, 22, 1.0)]
    assert sorted(pairs_of(spark, even + odd)) == [(10, 15), (11, 12), (13, 14), (20, 21)]
    assert pairs_of(spark, []) == []


def test_long_paths_are_scored_in_chunks(spark):
    rng = random.Random(2)
    rows = [(p, 0, i, i, i + 1, float(rng.randint(1, 9))) for p in range(3) for i in range((40, 1, 17)[p])]
    line, state = spark.createDataFrame(rows, "path long, variant int, pos long, u long, v long, r double"), Rounds(spark)
    scored = state.keep(path_scores(line, state, chunk=4))
    got = {(r["path"], r["pos"]): r["keep"] for r in scored.collect()}
    picked = {}
    for r in chosen(scored, state, chunk=4).collect():
        picked.setdefault(r["path"], []).append(r)
    for p in range(3):
        walk = [(u, v, r) for q, _, _, u, v, r in rows if q == p]
        keep = [0.0]
        for i in range(len(walk)):
            keep.append(max(keep[i], (keep[i - 1] if i else 0.0) + walk[i][2]))
        assert [got[p, i] for i in range(len(walk))] == keep[1:]
        assert sum(r["r"] for r in picked[p]) == keep[-1] == kernel.match_path(walk)[0]
        at = sorted(r["pos"] for r in picked[p])
        assert all(b - a > 1 for a, b in zip(at, at[1:], strict=False))


def test_ranked(spark):
    rows = [(i % 2 if i < 90 else 0, i * 7919 % 1000, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, o long, w long")
    got = {(r["g"], r["o"]): (r["rank"], r["ahead"]) for r in ranked(df, ["g"], ["o"], Rounds(spark), "w").collect()}
    for g in (0, 1):
        mine = sorted((o, w) for h, o, w in rows if h == g)
        assert [got[g, o] for o, _ in mine] == [(i, sum(w for _, w in mine[:i])) for i in range(len(mine))]


def test_levels_by_paths(spark):
    """All levels of a graph are matched by paths on Spark."""
    edges = [(u, u + 1, 1 + u % 3) for u in range(63)] + [(u, u + 8, 2) for u in range(56)]
    light = solver.profile_with("fast", trials=1, lp=1, pairs=0, c=2, coarsening="paths")
    g = Graph.from_lists(spark, 64, edges)
    levels = solver.coarse_levels(g, 16, 8, light)
    sizes = [x.vertices.count() for x, _ in levels]
    assert sizes[0] == 64 and sizes[-1] <= 20 and all(b <= 0.7 * a for a, b in zip(sizes, sizes[1:], strict=False))


def test_sparse_ids_without_edges(spark):
    """Pairs of any two vertices don't go by ranges of ids, so a bounded graph is left."""
    for step in (1, 5000):
        g = Graph(spark.range(600).select((F.col("id") * step).alias("u"), F.lit(1).cast("long").alias("vw")), spark.createDataFrame([], "u long, v long, w long"))
        light = solver.profile_with("fast", trials=1, lp=1, pairs=0)
        assert solver.coarse_levels(g, 50, 40, light)[-1][0].vertices.count() <= 50


def test_two_hop_steps_stop_when_enough_is_matched(spark):
    star = [(0, u, 1) for u in range(1, 9)]
    path = [(20 + i, 21 + i, 1) for i in range(0, 40, 2)]
    none = spark.createDataFrame([], "u long, v long")
    for extra, pairs, want in (([], none, ["degree one"]), (path, spark.createDataFrame([(u, v) for u, v, _ in path], "u long, v long"), [])):
        ids = sorted({x for e in star + extra for x in e[:2]})
        g = Graph.from_lists(spark, max(ids) + 1, star + extra)
        vertices = spark.createDataFrame([(i, 1) for i in ids], "u long, vw long")
        report: list = []
        coarsen.two_hop(vertices, g.edges, pairs, 9, report=report)
        assert report == want


def test_clusters_may_grow_where_they_stall(spark):
    """Vertices too heavy for the first limit of a cluster: the limit is doubled until they pair."""
    n = 40
    g = Graph.from_lists(spark, n, [(u, u + 1, 1) for u in range(n - 1)], [10] * n)
    p = solver.profile_with("experimental", trials=1, lp=1)
    levels = solver.coarse_levels(g, 25, 100, p)
    assert len(levels) == 2 and levels[1][0].vertices.agg(F.max("vw")).first()[0] <= 50


def test_exec_keeps_later_edits(spark, tmp_path):
    """An inner file with more commands than follow: nothing that follows is taken for a replay."""
    inner = tmp_path / "inner"
    inner.write_text("".join(f"+v {i} 1\n" for i in range(10, 16)))
    session = dynamic.Session(spark, Machine.parse("2", "1"))
    from meshwork.sources.files import command_list

    session.run(command_list(spark, ["+v 1 1", f"exec {inner}", "+v 2 1", "+v 3 1", "+e 1 2 4"]))
    session.run(command_list(spark, ["-v 10", "+v 4 2"]))
    assert {r["u"]: r["vw"] for r in session.graph.vertices.collect()} == {1: 1, 2: 1, 3: 1, 4: 2} | {i: 1 for i in range(11, 16)}
    assert [(r["u"], r["v"], r["w"]) for r in session.graph.edges.where("u < v").collect()] == [(1, 2, 4)]
    assert lmax(10, 2, 0.03) == 6
