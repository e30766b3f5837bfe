"""Bisections by jobs get graphs of a bounded size: larger ones are coarsened first."""

from meshwork.functions.hierarchy import Machine
from meshwork.operators import bisection, metrics, refine
from meshwork.operators.rounds import Rounds
from meshwork.plans import solver
from meshwork.sources.graph import Graph


def test_larger_graphs_are_coarsened(spark, monkeypatch):
    g = Rounds(spark).graph(Graph.from_lists(spark, 120, [(u, u + 1, 1 + u % 3) for u in range(119)]))
    m, lmax, sizes = Machine.flat(2), 70, []

    def halves(graph, *_, **__):
        sizes.append(graph.vertices.count())
        return Rounds(spark).keep(graph.vertices.selectExpr("u", "cast(u >= 60 as long) pid"))

    monkeypatch.setattr(bisection, "multisection", halves)
    monkeypatch.setattr(solver, "JOBS_AT", 70, raising=False)
    a = Rounds(spark).keep(solver.initial(g, m, lmax, "jobs", 1))
    assert sizes[0] <= 70
    assert a.count() == a.select("u").distinct().count() == 120
    assert metrics.balance(metrics.block_weights(g.vertices, a, 2), lmax).first()["overload"] == 0
    assert refine.cost(g, a, m) <= 2 * 3 * 3
