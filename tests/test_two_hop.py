from pyspark.sql import functions as F

from meshwork.operators import coarsen
from meshwork.sources.graph import Graph


def pairs_of(ids):
    ids = sorted(ids)
    return {(ids[i], ids[i + 1]) for i in range(0, len(ids) - 1, 2)}


def test_leaves_far_apart_are_paired(spark):
    """Leaves of two hubs, a few in each range of 1024 ids, odd numbers in a range among them."""
    mids = {u: 1 if u % 3 else 2 for u in range(700, 40_000, 700)}
    mids |= {u: 1 for u in range(50_000, 50_011)}
    one = spark.createDataFrame([(u, m, 1) for u, m in mids.items()], "u long, v long, w long")
    edges = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    want = set().union(*(pairs_of(u for u, m in mids.items() if m == mid) for mid in (1, 2)))
    for got in (coarsen.two_hop_degree_one(edges), coarsen.two_hop_matchmaker(edges, one.select("u")), coarsen.twins(edges).where("u > 2")):
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_singletons_far_apart_are_merged(spark):
    lone = list(range(5_000, 105_000, 5_000))
    one = spark.createDataFrame([(u, 1, 1) for u in lone], "u long, v long, w long")
    edges = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    vertices = spark.createDataFrame([(u, 1) for u in [1, 2, *lone]], "u long, vw long")
    clusters = vertices.select("u", F.when(F.col("u") == 2, 1).otherwise(F.col("u")).cast("long").alias("c"))
    sizes = [r["n"] for r in coarsen.merge_singletons(Graph(vertices, edges), clusters, 10).where("u > 2").groupBy("c").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20 and sizes == [5] * 4
