"""Minimum cuts are searched for a balanced one only where one may be, and the first side is what the search at every step gives."""

from meshwork.kernels import split
from meshwork.kernels.local import Local


def grid(h, w):
    one = [(u, u + 1, 1 + u % 3) for u in range(h * w) if u % w != w - 1] + [(u, u + w, 1 + u % 3) for u in range(h * w - w)]
    return Local(range(h * w), [1 + u * 7 % 5 for u in range(h * w)], one + [(v, u, w) for u, v, w in one])


def test_no_search_where_no_cut_fits(monkeypatch):
    g = grid(10, 20)
    low, high = int(0.47 * g.total), int(0.53 * g.total)
    searched, flows = [], []
    search, flow = split.balanced_min_cut, split.Piercing.flow
    monkeypatch.setattr(split, "balanced_min_cut", lambda *a, **k: searched.append(1) or search(*a, **k))
    monkeypatch.setattr(split.Piercing, "flow", lambda self, *a: flows.append(1) or flow(self, *a))
    half = split.Piercing(g, 0, 199).run(low, high)
    weight = sum(w for w, x in zip(g.vw, half, strict=True) if x)
    assert low <= weight <= high and half[0] and not half[199]
    assert 0 < 3 * len(searched) < len(flows)


def test_layers_end_where_the_sink_is():
    net = split.Network(5)
    for u, v in ((0, 1), (1, 4), (0, 2), (2, 3), (3, 4)):
        net.add(u, v, 1)
    assert net._layers(0, 4)[4] == 2
    assert net.max_flow(0, 4) == 2 and net._layers(0, 4) is None
    assert net.source_side(0) == [True, False, False, False, False] and net.sink_side(4) == [False] * 4 + [True]
