"""What must hold beyond the limits of one task, where matching stalls, and over a log with automatic refinement."""

import random

import pytest
from pyspark.sql import functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.functions.scalars import lmax
from meshwork.kernels.local import Local
from meshwork.kernels.split import FLOW_AT, bisect
from meshwork.operators import coarsen, metrics, refine
from meshwork.plans import solver
from meshwork.sources import files
from meshwork.sources.graph import Graph
from meshwork.streaming import dynamic

M = Machine.parse("2:2", "1:10")
LIGHT = solver.profile_with("fast", trials=1, lp=1, pairs=0, c=8)


def loads(assign, k):
    pid = [r["pid"] for r in assign.collect()]
    return [pid.count(b) for b in range(k)]


def test_star_is_coarsened_and_balanced(spark):
    """Matching takes one edge of a star; its leaves are paired with each other, so one task gets a bounded graph."""
    n = 300
    g = Graph.from_lists(spark, n, [(0, u, 1) for u in range(1, n)])
    levels = solver.coarse_levels(g, 32, max(1, n // 8), LIGHT)
    assert levels[-1][0].vertices.count() <= 32
    a = solver.solve(g, M, 0.1, LIGHT, local_arcs=0)
    got = loads(a, 4)
    assert sum(got) == n and max(got) <= lmax(n, 4, 0.1) and min(got) > 0


def test_graph_without_edges(spark):
    n = 200
    g = Graph(spark.createDataFrame([(u, 1) for u in range(n)], "u long, vw long"), spark.createDataFrame([], "u long, v long, w long"))
    assert solver.coarse_levels(g, 16, 25, LIGHT)[-1][0].vertices.count() <= 16
    got = loads(solver.solve(g, M, 0.1, LIGHT, local_arcs=0), 4)
    assert sum(got) == n and max(got) <= lmax(n, 4, 0.1) and min(got) > 0


def test_two_hop_pairs_keep_the_cap(spark):
    g = Graph.from_lists(spark, 9, [(0, u, 1) for u in range(1, 9)])
    weights = spark.createDataFrame([(u, u % 3 + 1) for u in range(9)], "u long, vw long")
    pairs = coarsen.two_hop(weights, g.edges, g.edges.select("u", "v").limit(0), 3).collect()
    used = [x for p in pairs for x in p]
    assert pairs and len(used) == len(set(used)) and all(p["u"] < p["v"] and p["u"] % 3 + p["v"] % 3 + 2 <= 3 for p in pairs)


def test_flow_bisection_of_a_large_graph():
    """Above FLOW_AT vertices the cut comes from flows by levels; a grid of 20 x 60 is cut across its short side."""
    h, w = 20, 60
    assert h * w > FLOW_AT
    edges = [(u, u + 1, 1) for u in range(h * w) if u % w != w - 1] + [(u, u + w, 1) for u in range(h * w - w)]
    g = Local(range(h * w), [1] * (h * w), edges + [(v, u, x) for u, v, x in edges])
    side = bisect(g, 0.5, (630, 630), "flow", 2, 1)
    assert max(side.count(0), side.count(1)) <= 630 and g.cut(side) <= 2 * h


def test_fill_empty(spark):
    g = Graph.from_lists(spark, 12, [(u, u + 1, 1) for u in range(11)])
    a = spark.createDataFrame([(u, u % 2) for u in range(12)], "u long, pid long")
    got = loads(refine.fill_empty(g, a, M, 12), 4)
    assert min(got) > 0 and sum(got) == 12


def test_only_given_vertices_move(spark):
    rng = random.Random(2)
    g = Graph.from_lists(spark, 20, [(u, v, rng.randint(1, 3)) for u in range(20) for v in range(u + 1, 20) if rng.random() < 0.2])
    a = spark.createDataFrame([(u, u % 4) for u in range(20)], "u long, pid long")
    may = spark.createDataFrame([(u,) for u in range(6)], "u long")
    new = refine.label_propagation(g, a, M, 8, 5, 0, may)
    moved = [r["u"] for r in new.join(a.withColumnRenamed("pid", "old"), "u").where("pid <> old").collect()]
    assert moved and set(moved) <= set(range(6)) and refine.cost(g, new, M) < refine.cost(g, a, M)


def test_autorefine_goes_by_what_was_touched_since_the_last_partition(spark):
    """20 vertices, one more touched before each call: a refinement doesn't empty the list, a partition does."""
    solver.PROFILES["light"] = LIGHT
    lines = [f"+e {u} {(u + 1) % 20}" for u in range(20)] + ["partition light"]
    for u in range(6):
        lines += [f"vw {u} 2", "autorefine 20 light"]
    s = dynamic.Session(spark, M, 0.5, "light")
    s.run(files.command_list(spark, lines))
    assert s.choices == ["refine"] * 3 + ["partition"] + ["refine"] * 2
    assert s.unsettled.count() == 2 and s.touched.count() == 0


def test_refinement_around_what_was_touched(spark):
    s = dynamic.Session(spark, M, 0.5, "light")
    solver.PROFILES["light"] = LIGHT
    s.run(files.command_list(spark, [f"+e {u} {u + 1}" for u in range(30)] + ["partition light", "+e 0 29 9"]))
    before = {r["u"]: r["pid"] for r in s.assign.collect()}
    s.refine_fast(3, only_touched=True)
    after = {r["u"]: r["pid"] for r in s.assign.collect()}
    assert {u for u in after if after[u] != before[u]} <= {0, 1, 28, 29, 30}


def test_coarsest_graph_is_written(spark, tmp_path):
    pairs = [(p, p + 1, 1) for p in range(80) if p % 10 != 9] + [(p, p + 10, 1) for p in range(70)]
    g = Graph.from_lists(spark, 80, pairs)
    solver.solve(g, Machine.flat(2), 0.1, LIGHT, local_arcs=100, dump=f"{tmp_path}/coarsest")
    back = files.read_metis(spark, f"{tmp_path}/coarsest")
    assert back.vertices.agg(F.sum("vw")).first()[0] == 80 and back.vertices.count() < 80


@pytest.mark.parametrize("n", [5, 40])
def test_items_of_a_multisection(spark, tmp_path, n):
    g = Graph.from_lists(spark, n, [(u, u + 1, 1) for u in range(n - 1)])
    a = spark.createDataFrame([(u, u % 4) for u in range(n)], "u long, pid long")
    rows = metrics.multisection_items(g, a, M).collect()
    assert sum(r["n"] for r in rows if r["depth"] == 0) == n == sum(r["n"] for r in rows if r["depth"] == 1)
    files.write_items(metrics.multisection_items(g, a, M), f"{tmp_path}/items")
    assert spark.read.option("header", True).csv(f"{tmp_path}/items").count() == len(rows)
