"""Tables that grow with the graph stay on the cluster: none is sent to the driver to be broadcast."""

from meshwork.functions.hierarchy import Machine
from meshwork.operators import gains, metrics, refine, rounds
from meshwork.operators.rounds import Rounds
from meshwork.sources.graph import Graph


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_tables_are_joined_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(rounds, "SMALL", 100)
    state = Rounds(spark)
    g = state.graph(Graph.from_lists(spark, 400, [(u, u + 1, 1 + u % 3) for u in range(399)]))
    assert g.kept and state.graph(g) is g
    a = state.keep(g.vertices.selectExpr("u", "floor(u / 100) pid"))
    ea = metrics.placed(g.edges, a)
    assert "BroadcastHashJoin" not in plan(ea) and ea.count() == 798
    # the blocks, k rows, still are broadcast, so that no task gets all movers to a block
    m, blocks = Machine.flat(4), state.keep(refine.blocks_of(g, a, 4, 150))
    best = gains.best_block(state.keep(metrics.block_conn(ea)), a, m, blocks, g.vertices)
    assert plan(best).count("BroadcastHashJoin") == 1 and best.count() == 6
