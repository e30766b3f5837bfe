"""Bisections as tables of jobs, against exhaustive search and against all jobs run."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.kernels.local import Local
from meshwork.kernels.split import Piercing
from meshwork.operators import bisection, metrics
from meshwork.plans.solver import initial
from meshwork.sources.graph import Graph


def random_graph(n, m, seed):
    rng = random.Random(seed)
    edges = {(i, rng.randrange(i)): rng.randint(1, 9) for i in range(1, n)}
    while len(edges) < min(m, n * (n - 1) // 2):
        u, v = rng.sample(range(n), 2)
        edges.setdefault((max(u, v), min(u, v)), rng.randint(1, 9))
    return [rng.randint(1, 4) for _ in range(n)], [(u, v, w) for (a, b), w in edges.items() for u, v in ((a, b), (b, a))]


def tables(spark, made):
    vs = [(item, u, w) for item, (vw, _) in made.items() for u, w in enumerate(vw)]
    es = [(item, *e) for item, (_, edges) in made.items() for e in edges]
    return spark.createDataFrame(vs, "item long, u long, vw long"), spark.createDataFrame(es, "item long, u long, v long, w long")


def smallest(g, left, right):
    """The smallest cut between two sets of vertices, all sides tried."""
    free = [i for i in range(len(g)) if i not in left and i not in right]
    return min(g.cut([i in left or i in taken for i in range(len(g))]) for r in range(len(free) + 1) for taken in map(set, itertools.combinations(free, r)))


@pytest.mark.parametrize("seed", range(8))
def test_first_flows_are_smallest_cuts(seed):
    vw, edges = random_graph(9, 16, seed)
    g = Local(range(9), vw, edges)
    a, b = random.Random(seed).sample(range(9), 2)
    p = Piercing(g, a, b)
    assert p.flow() == smallest(g, {a}, {b})
    p.grow(int(0.3 * g.total))
    left, right = ({u for u, x in p.held.items() if x == s} for s in (0, 1))
    for ball, end in ((left, a), (right, b)):
        assert end in ball and (len(ball) == 1 or sum(vw[u] for u in ball) <= int(0.3 * g.total))
    lower = p.flow()
    assert lower == smallest(g, left, right)
    assert Piercing(g, a, b).flow(limit=1) >= 1
    half = p.run(g.total // 2 - 4, g.total // 2 + 4)
    if half is not None:
        assert g.cut(half) >= lower and abs(sum(w for w, x in zip(vw, half, strict=True) if x) - g.total // 2) <= 4


def test_seeds_and_pairs(spark):
    made = {i: random_graph(n, n + 6, i) for i, n in enumerate((1, 2, 7, 12))}
    vs, es = tables(spark, made)
    got = {}
    for r in bisection.seeds(vs, es, 4).collect():
        got.setdefault(r["item"], {})[r["place"]] = (r["u"], list(r["hops"]))
    for item, (vw, edges) in made.items():
        g = Local(range(len(vw)), vw, edges)
        far = g.hops([0])
        taken = []
        while len(taken) < min(4, len(g)):
            u = min((i for i in range(len(g)) if i not in taken), key=lambda i: (-(min(g.hops([i])[t] for t in taken) if taken else far[i]), i))
            assert got[item][len(taken)] == (u, [g.hops([u])[t] for t in taken])
            taken.append(u)
    rows = bisection.pairs(bisection.seeds(vs, es, 4), 0.3).collect()
    assert {r["item"]: sum(x["item"] == r["item"] for x in rows) for r in rows} == {1: 1, 2: 6, 3: 6}
    for item in (2, 3):
        others = sorted((r["hops"] for r in rows if r["item"] == item and r["i"] > 0), reverse=True)
        assert all(r["kept"] for r in rows if r["i"] == 0) and {r["hops"] for r in rows if r["item"] == item and r["i"] > 0 and r["kept"]} == {others[0]}
    random_ones = [{(r["item"], r["u"]) for r in bisection.seeds(vs, es, 4, pool=3, salt=s).collect()} for s in (5, 5, 6)]
    assert random_ones[0] == random_ones[1] and len(random_ones[2]) == len(random_ones[0])


def test_transitive_bounds_hold(spark):
    made = {i: random_graph(8, 13, 40 + i) for i in range(3)}
    vs, es = tables(spark, made)
    all_pairs = bisection.pairs(bisection.seeds(vs, es, 5)).withColumn("best", F.lit(bisection.NONE))
    flows = bisection.prepared(all_pairs, vs, es).cache()
    for r in flows.collect():
        g = Local(range(8), *made[r["item"]])
        assert r["lam"] == r["lower"] == smallest(g, {r["a"]}, {r["b"]})
    asked = bisection.transitive(flows.where("i = 0"), flows.where("i > 0")).collect()
    assert len(asked) == 3 * 6 and all(0 < r["bound"] <= r["lam"] for r in asked)


@pytest.mark.parametrize("share", [1, 2])
def test_same_cuts_as_all_jobs_with_fewer_flows(spark, share):
    """Items: random graphs, two cliques with a bridge, two components, one vertex, two without edges."""
    clique = [(u, v, 5) for c in (range(6), range(6, 12)) for u in c for v in c if u != v]
    made = {i: random_graph(14, 24, i) for i in range(3)}
    made[3] = ([1] * 12, clique + [(0, 6, 1), (6, 0, 1)])
    made[4] = ([1] * 12, clique)
    made[5], made[6] = ([3], []), ([1, 1], [])
    vs, es = tables(spark, made)
    lim = {i: (share * sum(vw) // (share + 1) + 3, sum(vw) // (share + 1) + 3) for i, (vw, _) in made.items()}
    if share == 1:
        lim = {i: (max(x),) * 2 for i, x in lim.items()}
    limits = spark.createDataFrame([(i, *x) for i, x in lim.items()], "item long, most0 long, most1 long")
    jobs = bisection.pairs(bisection.seeds(vs, es, 4)).join(limits, "item")
    every = {r["item"]: r["cut"] for r in bisection.cuts(jobs, vs, es).groupBy("item").agg(F.min("cut").alias("cut")).collect()}
    report = []
    sides = bisection.bisect(vs, es, limits, report=report).collect()
    assert len(sides) == sum(len(vw) for vw, _ in made.values())
    for i, (vw, edges) in made.items():
        g, side = Local(range(len(vw)), vw, edges), {r["u"]: r["side"] for r in sides if r["item"] == i}
        load = [sum(w for u, w in enumerate(vw) if side[u] == s) for s in (0, 1)]
        assert load[0] <= lim[i][0] and load[1] <= lim[i][1]
        if i in every:
            assert g.cut([side[u] for u in range(len(vw))]) <= every[i]
    done = {r["item"]: r for r in report[0].collect()}
    assert all(r["solved"] <= r["jobs"] and r["ran"] <= r["jobs"] for r in done.values())
    assert done[3]["solved"] < 6 and (share == 2 or done[3]["ran"] == 1)


def test_unbounded_jobs_equal_bounded_ones(spark):
    """Before refinement the best cut of the kept jobs is that of all pairs, with and without balls."""
    made = {i: random_graph(16, 28, 70 + i) for i in range(4)}
    vs, es = tables(spark, made)
    limits = vs.groupBy("item").agg((F.sum("vw") / 2 + 4).cast("long").alias("most0")).withColumn("most1", F.col("most0"))
    for ball in (0.0, 0.1):
        every = bisection.cuts(bisection.pairs(bisection.seeds(vs, es, 4)).join(limits, "item"), vs, es, ball)
        best = {r["item"]: r["cut"] for r in every.groupBy("item").agg(F.min("cut").alias("cut")).collect()}
        seen = []
        held, bisection.finished = bisection.finished, lambda v, e, lim, won: seen.append({r["item"]: r["cut"] for r in won.collect()}) or held(v, e, lim, won)
        try:
            bisection.bisect(vs, es, limits, ball=ball)
        finally:
            bisection.finished = held
        assert seen == [best]


@pytest.mark.parametrize("levels", ["2:2", "3:2"])
def test_multisection_by_jobs(spark, levels):
    m = Machine.parse(levels, "1:10")
    h, w = 8, 9
    g = Graph.from_lists(spark, h * w, [(u, u + 1, 1) for u in range(h * w) if u % w != w - 1] + [(u, u + w, 1) for u in range(h * w - w)])
    lmax = -(-h * w * 11 // (10 * m.k))
    a = initial(g, m, lmax, "jobs", 1).cache()
    assert a.count() == h * w and metrics.balance(metrics.block_weights(g.vertices, a, m.k), lmax).first()["n_overloaded"] == 0
    striped = g.vertices.select("u", (F.col("u") % m.k).alias("pid"))
    cut = lambda x: metrics.edge_cut(metrics.placed(g.edges, x)).first()["edge_cut"]
    assert 3 * cut(a) < cut(striped)
