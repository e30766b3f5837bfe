"""Deep solves stop coarsening where one task can go on."""

from meshwork.functions.hierarchy import Machine
from meshwork.plans import solver
from meshwork.sources.graph import Graph


def test_a_deep_solve_ends_coarsening_where_one_task_can_go_on(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a block was split by a task of its own")

    monkeypatch.setattr(solver, "_split_blocks", never)
    g = Graph.from_lists(spark, 256, [(u, u + 1, 1) for u in range(256) if u % 16 != 15] + [(u, u + 16, 2) for u in range(240)])
    m = Machine.parse("2:2", "1:10")
    got = solver.solve_deep(g, m, 0.1, solver.profile_with("fast", lp=1, trials=1, pairs=0), local_arcs=700)
    rows = {r["u"]: r["pid"] for r in got.collect()}
    loads = [list(rows.values()).count(b) for b in range(4)]
    assert len(rows) == 256 and min(loads) > 0 and max(loads) <= 71
