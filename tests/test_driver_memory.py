"""The comparison of the distance oracles sends no table through the driver."""

import __spark_entry__


def test_oracle_equivalence_broadcasts_nothing(spark):
    got = __spark_entry__.queries()["oracle_equivalence"](spark, "/root/testdata/sf0.001")
    row = got.first()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and row["n_pairs"] > 0 and (row["n_binary"], row["n_stored"], row["n_level"]) == (0, 0, 0)
