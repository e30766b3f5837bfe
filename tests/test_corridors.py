"""Corridors, colours of block pairs, costs kept from moves, and when a search gives up."""

import random

import pytest
from pyspark.sql import functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.kernels.local import Local
from meshwork.kernels.split import Steps, refine_pair
from meshwork.operators import corridors, gains, metrics, refine
from meshwork.sources.graph import Graph

M = Machine.parse("2:2", "1:10")


def grid(spark, h, w):
    return Graph.from_lists(spark, h * w, [(u, u + 1, 1 + u % 3) for u in range(h * w) if u % w != w - 1] + [(u, u + w, 2) for u in range(h * w - w)])


@pytest.mark.parametrize("k", [1, 2, 3, 8, 9])
def test_pairs_of_a_colour_share_no_block(spark, k):
    pairs = spark.createDataFrame([(a, b) for b in range(k) for a in range(b)] or [(0, 0)], "a long, b long").where("a < b")
    got = pairs.select("a", "b", corridors.colour(F.col("a"), F.col("b"), k).alias("c")).collect()
    assert len(got) == k * (k - 1) // 2 and len({r["c"] for r in got}) <= (k if k % 2 else k - 1)
    for c in {r["c"] for r in got}:
        blocks = [x for r in got if r["c"] == c for x in (r["a"], r["b"])]
        assert len(blocks) == len(set(blocks))


def test_corridors_are_bounded_by_the_room(spark):
    """A wide grid in two halves: the corridor is a band around the border, nearest vertices first, and no heavier than alpha times the room."""
    h, w = 6, 12
    g = grid(spark, h, w)
    a = g.vertices.select("u", F.when(F.col("u") % w < 6, 0).otherwise(1).cast("long").alias("pid"))
    blocks = refine.blocks_of(g, a, 2, 42)
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    for alpha in (2.0, 100.0):
        got = corridors.corridors(g, a, pairs, blocks, alpha).collect()
        for side in (0, 1):
            mine = sorted((r["hop"], r["u"]) for r in got if r["side"] == side)
            away = {u: (5 - u % w) if side == 0 else u % w - 6 for u in range(h * w) if (u % w < 6) == (side == 0)}
            want = sorted((d, u) for u, d in away.items())[: int(alpha * 6)]
            assert mine == want


@pytest.mark.parametrize("kernel", ["fm", "flow", "swap"])
def test_refinement_of_corridors_keeps_balance_and_lowers_the_cost(spark, kernel):
    g = grid(spark, 6, 8)
    a = g.vertices.select("u", (F.col("u") * 7 % 3).cast("long").alias("pid") if kernel == "swap" else F.floor(F.col("u") / 16).cast("long").alias("pid"))
    new = refine.refine_pairs(g, a, Machine.flat(3), 18, kernel, 1)
    rows = {r["u"]: r["pid"] for r in new.collect()}
    loads = [list(rows.values()).count(b) for b in range(3)]
    before, after = (refine.cost(g, x, Machine.flat(3)) for x in (a, new))
    assert len(rows) == 48 and max(loads) <= 18 and after <= before and (after < before or kernel != "swap")


def test_spaced_stages(spark):
    g = grid(spark, 4, 8)
    a = g.vertices.select("u", (F.col("u") % 8 / 4).cast("long").alias("pid"))
    new = refine.refine_pairs(g, a, Machine.flat(2), 20, "fm", 1, spaced=True)
    assert refine.cost(g, new, Machine.flat(2)) <= refine.cost(g, a, Machine.flat(2))


def test_label_propagation_by_pairs(spark):
    rng = random.Random(3)
    g = grid(spark, 8, 10)
    a = spark.createDataFrame([(u, rng.randrange(4)) for u in range(80)], "u long, pid long")
    new = refine.label_propagation_by_pairs(g, a, M, 26, 1)
    loads = [r["bweight"] for r in metrics.block_weights(g.vertices, new, 4).collect()]
    assert refine.cost(g, new, M) < refine.cost(g, a, M) and sum(loads) == 80 and max(loads) <= 26


def test_cost_is_kept_from_the_edges_of_moved_vertices(spark):
    rng = random.Random(4)
    g = grid(spark, 6, 7)
    a = spark.createDataFrame([(u, rng.randrange(4)) for u in range(42)], "u long, pid long")
    moves = spark.createDataFrame([(u, rng.randrange(4)) for u in rng.sample(range(42), 15)], "u long, new_id long")
    assert refine.cost_change(g, a, moves, M) == refine.cost(g, gains.apply_moves(a, moves), M) - refine.cost(g, a, M)


def test_steps_give_up_on_what_falls_for_good():
    """Steady losses end soon after the least number of steps; losses that chance could undo go on."""
    steady, noisy = Steps(least=5), Steps(least=5)
    assert next(i for i in range(100) if steady.add(-3.0)) == 5
    rng = random.Random(0)
    trace = [rng.choice([-100.0, 99.0]) for _ in range(400)]
    assert not any(noisy.add(x) for x in trace[:50])
    steady.reset()
    assert steady.n == 0 and not any(Steps(least=0).add(1.0) for _ in range(50))
    mean, var = sum(trace[:50]) / 50, sum((x - sum(trace[:50]) / 50) ** 2 for x in trace[:50]) / 50
    assert abs(noisy.mean - mean) < 1e-9 and abs(noisy.spread / 50 - var) < 1e-6


def test_refine_pair_escapes_small_hills():
    """A cut that only falls after a few losing moves is still found."""
    n = 40
    edges = [(u, u + 1, 1 if u == 20 else 3) for u in range(n - 1)]
    g = Local(range(n), [1] * n, edges + [(v, u, w) for u, v, w in edges])
    side = [0 if u < 18 else 1 for u in range(n)]
    assert refine_pair(g, side, (24, 24)) == 2 and g.cut(side) == 1


@pytest.mark.parametrize("chunk", [7, 20_000])
def test_a_long_corridor_takes_a_round_a_chunk_not_a_round_a_hop(spark, monkeypatch, chunk):
    monkeypatch.setattr(corridors, "CHUNK", chunk)
    kept, keep = [], corridors.Rounds.keep
    monkeypatch.setattr(corridors.Rounds, "keep", lambda self, df: kept.append(1) or keep(self, df))
    g = grid(spark, 60, 1)
    a = g.vertices.select("u", (F.col("u") >= 30).cast("long").alias("pid"))
    got = corridors.corridors(g, a, spark.createDataFrame([(0, 1)], "a long, b long"), refine.blocks_of(g, a, 2, 55), 1.0, 64)
    assert sorted(r["u"] for r in got.collect()) == list(range(5, 55)) and len(kept) < 15
