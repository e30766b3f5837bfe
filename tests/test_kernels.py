import random
from itertools import permutations, product

import pytest

from meshwork.functions.hierarchy import Machine
from meshwork.kernels import multilevel
from meshwork.kernels.assignment import assign
from meshwork.kernels.flow import Network, balanced_min_cut
from meshwork.kernels.local import Local
from meshwork.kernels.paths import global_paths, grow, match_path
from meshwork.kernels.split import bisect, greedy, hill_climb, refine_flow, refine_pair, split


def graph(n, edges, weights=None):
    both = [(u, v, w) for u, v, w in edges] + [(v, u, w) for u, v, w in edges]
    return Local(range(n), weights or [1] * n, both)


def random_graph(rng, n, p=0.4):
    return graph(n, [(u, v, rng.randint(1, 5)) for u in range(n) for v in range(u + 1, n) if rng.random() < p], [rng.randint(1, 3) for _ in range(n)])


def grid(w, h):
    at = lambda x, y: y * w + x
    return graph(w * h, [(at(x, y), at(x + 1, y), 1) for y in range(h) for x in range(w - 1)] + [(at(x, y), at(x, y + 1), 1) for y in range(h - 1) for x in range(w)])


def test_max_flow_is_min_cut():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(2, 7)
        arcs = [(u, v, rng.randint(0, 6)) for u in range(n) for v in range(n) if u != v and rng.random() < 0.5]
        net = Network(n)
        for a in arcs:
            net.add(*a)
        cut = min(sum(c for u, v, c in arcs if u in s and v not in s) for bits in product((0, 1), repeat=n - 2) for s in [{0} | {i + 2 for i, b in enumerate(bits) if b}])
        flow = net.max_flow(0, 1)
        assert flow == cut
        side = net.source_side(0)
        assert side[0] and not side[1] and sum(c for u, v, c in arcs if side[u] and not side[v]) == cut


def test_balanced_min_cut_is_minimal_and_balanced():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(3, 8)
        arcs = [(u, v, rng.randint(1, 2)) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.5]
        weight = [rng.randint(1, 3) for _ in range(n)]
        cost = lambda s: sum(c for u, v, c in arcs if (u in s) != (v in s))
        sets = [{0} | {i + 2 for i, b in enumerate(bits) if b} for bits in product((0, 1), repeat=n - 2)]
        best = min(map(cost, sets))
        low, high = sum(weight) // 3, 2 * sum(weight) // 3
        fits = [s for s in sets if cost(s) == best and low <= sum(weight[i] for i in s) <= high]
        net = Network(n)
        for u, v, c in arcs:
            net.add(u, v, c, c)
        net.max_flow(0, 1)
        got = balanced_min_cut(net, 0, 1, weight, low, high)
        assert (got is None) == (not fits)
        if got:
            s = {i for i, x in enumerate(got) if x}
            assert cost(s) == best and low <= sum(weight[i] for i in s) <= high


def test_assignment_is_optimal():
    rng = random.Random(3)
    for n in (1, 2, 3, 5, 6):
        cost = [[rng.randint(0, 9) for _ in range(n)] for _ in range(n)]
        got = assign(cost)
        assert sorted(got) == list(range(n))
        assert sum(cost[i][j] for i, j in enumerate(got)) == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))


def test_paths_are_matched_optimally():
    rng = random.Random(4)
    for _ in range(30):
        r = [rng.randint(1, 9) for _ in range(rng.randint(1, 8))]
        walk = [(i, i + 1, x) for i, x in enumerate(r)]
        best = max(sum(x for x, b in zip(r, bits, strict=True) if b) for bits in product((0, 1), repeat=len(r)) if not any(a and b for a, b in zip(bits, bits[1:], strict=False)))
        value, pairs = match_path(walk)
        assert value == best == sum(r[u] for u, _ in pairs)


def test_global_paths_is_a_matching_and_cycles_are_even():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randint(2, 12)
        edges = [(float(rng.randint(1, 9)), u, v) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.4]
        pairs = global_paths(edges)
        ends = [x for p in pairs for x in p]
        assert len(ends) == len(set(ends)) and all(any(p == (u, v) for _, u, v in edges) for p in pairs)
        for walk in grow(edges):
            if len(walk) > 2 and walk[0][0] == walk[-1][1]:
                assert len(walk) % 2 == 0
    # a heavy middle edge does not spoil the two around it
    assert sorted(global_paths([(5.0, 1, 2), (4.0, 0, 1), (4.0, 2, 3)])) == [(0, 1), (2, 3)]
    assert len(global_paths([(1.0, 0, 1), (1.0, 1, 2), (1.0, 2, 3), (1.0, 0, 3)])) == 2


@pytest.mark.parametrize("method", ["flow", "ggg"])
def test_bisect_finds_the_grids_middle(method):
    g = grid(8, 4)
    side = bisect(g, 0.5, (17, 17), method, 4)
    assert g.cut(side) == 4 and abs(sum(side) - 16) <= 1
    two = graph(6, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)])
    assert two.cut(bisect(two, 0.5, (3, 3), method)) == 0


def test_split_is_balanced():
    g = grid(10, 10)
    part = split(g, 4, 26)
    assert sorted(set(part)) == [0, 1, 2, 3] and max(part.count(b) for b in range(4)) <= 26
    assert g.cut(part) <= 30
    assert split(grid(2, 1), 3, 1) and split(Local([], [], []), 3, 1) == []


def test_pair_refinement_never_worsens_and_counts_its_gain():
    rng = random.Random(6)
    for kernel in (refine_pair, refine_flow):
        for _ in range(40):
            g = random_graph(rng, rng.randint(2, 10))
            side = [rng.randint(0, 1) for _ in range(len(g))]
            extra = [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(len(g))]
            most = (g.total, g.total) if rng.random() < 0.5 else tuple(max(sum(w for w, s in zip(g.vw, side, strict=True) if s == x) for x in (0, 1)) + 1 for _ in (0, 1))
            cost = lambda s, g=g, extra=extra: 3 * g.cut(s) + sum(e[x] for e, x in zip(extra, s, strict=True))
            before = cost(side)
            gain = kernel(g, side, most, extra, factor=3)
            assert cost(side) == before - gain and gain >= 0
            assert all(sum(w for w, s in zip(g.vw, side, strict=True) if s == x) <= most[x] for x in (0, 1))


def test_greedy_and_hill_climb():
    m = Machine.parse("2:2", "1:10")
    g = grid(6, 6)
    pid = greedy(g, 4, 10, m.between)
    before = g.cost(pid, m.between)
    gain = hill_climb(g, pid, 4, 10, m.between)
    assert g.cost(pid, m.between) == before - 2 * gain and max(pid.count(b) for b in range(4)) <= 10


@pytest.mark.parametrize("method", ["flow", "ggg", "greedy"])
def test_multilevel_beats_bands(method):
    m = Machine.parse("2:2:2", "1:10:100")
    g = grid(16, 16)
    lmax = 34
    pid = multilevel.solve(g, m, lmax, 256, 0.03, 8, method, flow=1)
    assert max(pid.count(b) for b in range(8)) <= lmax
    bands = [u // 32 for u in range(256)]
    assert g.cost(pid, m.between) <= 1.5 * g.cost(bands, m.between)  # bands are nearly the best there is
    assert multilevel.solve(g, m, lmax, 256, 0.03, 8, method, flow=1) == pid


def test_multilevel_of_odd_graphs():
    m = Machine.parse("2:2", "1:10")
    for g in (grid(1, 1), graph(3, []), graph(5, [(0, i, 1) for i in range(1, 5)], [100, 1, 1, 1, 1]), grid(3, 1)):
        pid = multilevel.solve(g, m, max(1, -(-g.total // 4)), g.total, 0.03)
        assert len(pid) == len(g) and all(0 <= b < 4 for b in pid)


def test_balanced_cuts_by_closed_sets_and_random_orders():
    """Sets are those of brute force; above the limit, several orders are never farther from the middle than the natural one, and every cut is a minimum one."""
    import itertools

    from meshwork.kernels.flow import Network, balanced_min_cut, closed_sets, random_order

    rng = random.Random(3)
    after = [sum(1 << j for j in range(i) if rng.random() < 0.3) for i in range(9)]
    brute = {m for m in range(512) if all(m & after[i] == after[i] for i in range(9) if m >> i & 1)}
    sets = list(closed_sets(after))
    assert set(sets) == brute and len(sets) == len(brute)
    order = random_order(after, rng)
    assert sorted(order) == list(range(9)) and all(not after[i] & ~sum(1 << x for x in order[:n]) for n, i in enumerate(order))
    better = 0
    for trial in range(30):
        n = 40
        net = Network(n + 2)
        s, t = n, n + 1
        for i, j in itertools.pairwise(range(n)):
            if rng.random() < 0.8:
                net.add(i, j, 1 if rng.random() < 0.2 else 2, 0)
        net.add(s, 0, 1)
        net.add(n - 1, t, 1)
        weight = [rng.randint(1, 5) for _ in range(n)] + [0, 0]
        net.max_flow(s, t)
        total = sum(weight)
        away = []
        for orders in (0, 12):
            got = balanced_min_cut(net, s, t, weight, 0, total, exact=0, orders=orders)
            assert got is not None and all(net.cap[a] == 0 for u in range(n + 2) if got[u] for a in net.out[u] if not got[net.to[a]])
            away.append(abs(sum(x for x, g in zip(weight, got, strict=True) if g) - total / 2))
        assert away[1] <= away[0]
        better += away[1] < away[0]
    assert better
