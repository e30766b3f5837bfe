"""Pairs of parts that share orders are made by tasks whose number grows with the order lines."""

from meshwork.sources import graph as guests

D = "/root/testdata/sf0.001"


def test_tasks_of_a_bounded_number_of_rows(spark, monkeypatch):
    want = sorted(map(tuple, guests.copurchase(spark, D).edges.collect()))
    lines = spark.read.parquet(f"{D}/lineitem.parquet").count()
    monkeypatch.setattr(guests, "ROWS_A_TASK", 50, raising=False)
    g = guests.copurchase(spark, D)
    assert g.edges.rdd.getNumPartitions() == -(-lines // 50) > 4
    assert sorted(map(tuple, g.edges.collect())) == want and g.vertices.count() == len({u for u, *_ in want})
