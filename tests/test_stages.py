"""Stages of a chain of blocks, and arcs kept from moves."""

import random

from pyspark.sql import functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.operators import corridors, refine
from meshwork.operators.rounds import Rounds
from meshwork.sources.graph import Graph


def grid(spark, h, w):
    return Graph.from_lists(spark, h * w, [(u, u + 1, 1) for u in range(h * w) if u % w != w - 1] + [(u, u + w, 2) for u in range(h * w - w)])


def test_a_chain_of_blocks_has_few_stages(spark, monkeypatch):
    runs, kernel = [], refine._pair_kernel
    monkeypatch.setattr(refine, "_pair_kernel", lambda *a: runs.append(1) or kernel(*a))
    g = grid(spark, 16, 2)
    a = g.vertices.select("u", F.floor(F.col("u") / 4).cast("long").alias("pid"))
    refine.refine_pairs(g, a, Machine.flat(8), 5, "fm", 1)
    assert 0 < len(runs) <= 3


def test_all_pairs_are_dealt(spark):
    static = lambda a, b, k: 2 * a % (k - 1) if b == k - 1 else (a + b) % (k - 1)
    rng = random.Random(1)
    for pairs in ([(i, i + 1) for i in range(7)], [(a, b) for b in range(8) for a in range(b)], rng.sample([(a, b) for b in range(8) for a in range(b)], 11)):
        for active in (None, {0, 3}):
            want = sorted(p for p in pairs if active is None or set(p) & active)
            got = refine.stages_of([(a, b, rng.randrange(9), static(a, b, 8)) for a, b in pairs], active)
            assert sorted(p for s in got for p in s) == want and all(len({x for p in s for x in p}) == 2 * len(s) for s in got)
            assert len(got) <= len({static(a, b, 8) for a, b in want})


def test_arcs_after_moves_are_those_placed_anew(spark):
    state, g = Rounds(spark), grid(spark, 5, 6)
    a = state.keep(g.vertices.select("u", (F.col("u") % 3).alias("pid")))
    moves = state.keep(g.vertices.where("u % 4 = 1").select("u", ((F.col("u") + 1) % 3).alias("new_id")))
    arcs = corridors.arcs_of(g, [7, 20])
    new = a.join(moves, "u", "left").select("u", F.coalesce("new_id", "pid").alias("pid"))
    got = corridors.moved_arcs(state.keep(corridors.placed_arcs(arcs, a)), moves)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, corridors.placed_arcs(arcs, new).collect()))
