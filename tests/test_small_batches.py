"""A small batch of edits folds what it names, not the whole snapshot, and gives what the whole log gives."""

import random

from meshwork.functions.hierarchy import Machine
from meshwork.streaming import dynamic
from test_keyed_edits import random_edits


def test_a_batch_folds_what_it_names(spark, monkeypatch):
    log = [e for e in random_edits(random.Random(11), 240, 14) if e[4] != 0]
    s = dynamic.Session(spark, Machine.parse("2:2", "1:10"))
    seen, fold = [], dynamic.edge_weights
    monkeypatch.setattr(dynamic, "edge_weights", lambda events: seen.append(events.count()) or fold(events))
    s.apply(spark.createDataFrame(log[:220], dynamic.EVENTS))
    s.apply(spark.createDataFrame([(500, "+e", 1, 2, 3), (501, "vw", 20, None, 4)], dynamic.EVENTS))
    assert seen[1] <= 3  # the two edits and the edge as it was
    s.apply(spark.createDataFrame([(600 + i, *e[1:]) for i, e in enumerate(log[220:])] + [(700, "-v", 3, None, None)], dynamic.EVENTS))
    whole = log[:220] + [(500, "+e", 1, 2, 3), (501, "vw", 20, None, 4)] + [(600 + i, *e[1:]) for i, e in enumerate(log[220:])] + [(700, "-v", 3, None, None)]
    want = dynamic.snapshot(spark.createDataFrame(whole, dynamic.EVENTS))
    assert sorted(map(tuple, s.graph.vertices.collect())) == sorted(map(tuple, want.vertices.collect()))
    assert sorted(map(tuple, s.graph.edges.select("u", "v", "w").collect())) == sorted(map(tuple, want.edges.select("u", "v", "w").collect()))
