"""Where items are many, all jobs of an item are one group, with the same rows as a group for each job."""

from pyspark.sql import functions as F

from meshwork.operators import bisection
from test_bisection import random_graph, tables


def test_jobs_of_an_item_share_a_group(spark, monkeypatch):
    made = {i: random_graph(12, 20, i) for i in range(5)}
    vs, es = (t.cache() for t in tables(spark, made))
    limits = vs.groupBy("item").agg((F.sum("vw") / 2 + 4).cast("long").alias("most0")).withColumn("most1", F.col("most0")).cache()
    rows = []
    for least in (64, 5):
        monkeypatch.setattr(bisection, "TOGETHER", least)
        rows.append(sorted(map(tuple, bisection.bisect(vs, es, limits, ball=0.1).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 60
