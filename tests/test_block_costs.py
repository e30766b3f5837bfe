"""The cost for each layer pairs the blocks of order lines: no pair of parts is shuffled."""

import __spark_entry__
from meshwork.operators import metrics
from meshwork.sources import graph as guests

D = "/root/testdata/sf0.001"


def test_blocks_of_lines(spark):
    g = guests.copurchase(spark, D)
    a = g.vertices.selectExpr("u", "u % 7 pid")
    want = sorted(map(tuple, metrics.block_pairs(metrics.placed(g.edges, a)).collect()))
    assert sorted(map(tuple, metrics.block_pairs(guests.copurchase_blocks(spark, D, a)).collect())) == want
    plan = __spark_entry__.queries()["qap_per_layer"](spark, D)._jdf.queryExecution().executedPlan().toString()
    # pairs of parts were dealt by both ids
    assert "hashpartitioning(pu" in plan and not any(f"hashpartitioning({x}#" in line and f", {y}#" in line for line in plan.splitlines() for x, y in (("u", "v"),))
