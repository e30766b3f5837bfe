"""Handshakes go over short lists: what a matching writes grows with the vertices, not with the edges of each round."""

import random

from meshwork.operators import coarsen
from meshwork.operators.rounds import Rounds
from meshwork.sources.graph import Graph


def test_matching_of_a_dense_graph_writes_no_round_of_all_edges(spark, monkeypatch):
    n, rng = 80, random.Random(3)
    g = Graph.from_lists(spark, n, [(u, v, rng.randint(1, 9)) for u in range(n) for v in range(u)], [rng.randint(1, 5) for _ in range(n)])
    g = Graph(g.vertices.cache(), g.edges.cache())
    sizes, keep = [], Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, df: (kept := keep(self, df), sizes.append(kept.count()))[0])
    pairs = [tuple(r) for r in coarsen.matching(g.vertices, g.edges, seed=1).collect()]
    assert len(pairs) == n // 2 and len({u for p in pairs for u in p}) == n and all(u < v for u, v in pairs)
    assert max(sizes) <= 2 * n * 16 < n * (n - 1)


def test_heavy_pairs_stay_apart(spark):
    """With a cap the matching is maximal among the pairs that fit, over several passes of lists."""
    n, rng = 60, random.Random(5)
    weights = [rng.randint(1, 30) for _ in range(n)]
    g = Graph.from_lists(spark, n, [(u, v, rng.randint(1, 9)) for u in range(n) for v in range(u)], weights)
    pairs = [tuple(r) for r in coarsen.matching(g.vertices, g.edges, cap=30, seed=2).collect()]
    used = [u for p in pairs for u in p]
    free = [u for u in range(n) if u not in used]
    assert len(used) == len(set(used)) and all(weights[u] + weights[v] <= 30 for u, v in pairs)
    assert not any(weights[u] + weights[v] <= 30 for u in free for v in free if u < v)
