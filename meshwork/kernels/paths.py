"""Global path matching: grow paths and even cycles from the best edges, then match each of them optimally."""

from __future__ import annotations

from meshwork.kernels.local import Local


def grow(edges: list[tuple[float, int, int]]) -> list[list[tuple[int, int, float]]]:
    """Paths and even cycles, each a list of consecutive edges (u, v, rating). Edges are taken by falling rating if both ends
    have fewer than two taken edges and no odd cycle closes."""
    degree: dict[int, int] = {}
    other: dict[int, int] = {}  # end of a path -> its other end
    length: dict[int, int] = {}
    taken: dict[int, list[tuple[int, float]]] = {}
    for r, u, v in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if degree.get(u, 0) == 2 or degree.get(v, 0) == 2:
            continue
        eu, ev = other.get(u, u), other.get(v, v)
        if eu == v and ev == u:  # closes a cycle of length + 1 edges
            if length.get(u, 0) % 2 == 0 or length.get(u, 0) == 1:
                continue
        size = length.get(u, 0) + length.get(v, 0) + 1
        for x, y in ((u, v), (v, u)):
            degree[x] = degree.get(x, 0) + 1
            taken.setdefault(x, []).append((y, r))
        other[eu], other[ev] = ev, eu
        length[eu] = length[ev] = size
    out, seen = [], set()
    for start in sorted(taken, key=lambda x: (degree[x], x)):  # ends of paths first, then cycles
        if start in seen:
            continue
        walk, u, last = [], start, None
        seen.add(u)
        while True:
            step = next(((v, r) for v, r in taken[u] if v != last and (v not in seen or (v == start and len(walk) > 1))), None)
            if step is None:
                break
            v, r = step
            walk.append((u, v, r))
            if v == start:
                break
            seen.add(v)
            last, u = u, v
        out.append(walk)
    return out


def match_path(walk: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int]]]:
    """The matching of largest rating on a path: keep[i] is the best of its first i edges."""
    keep = [0.0, walk[0][2] if walk else 0.0]
    for i in range(2, len(walk) + 1):
        keep.append(max(keep[i - 1], keep[i - 2] + walk[i - 1][2]))
    out, i = [], len(walk)
    while i > 0:
        if i == 1 or keep[i] > keep[i - 1]:
            out.append(walk[i - 1][:2])
            i -= 2
        else:
            i -= 1
    return keep[len(walk)], out


def match_walk(walk: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """A cycle is the better of two paths: without its first or without its last edge."""
    if len(walk) > 2 and walk[0][0] == walk[-1][1]:
        return max(match_path(walk[1:]), match_path(walk[:-1]), key=lambda x: x[0])[1]
    return match_path(walk)[1]


def global_paths(edges: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    return [tuple(sorted(e)) for walk in grow(edges) for e in match_walk(walk)]


def contract(g: Local, pairs: list[tuple[int, int]]) -> tuple[Local, list[int]]:
    """The graph with each pair made one vertex, and the coarse vertex of each fine one."""
    to = list(range(len(g)))
    for u, v in pairs:
        to[max(u, v)] = min(u, v)
    names = {x: i for i, x in enumerate(sorted(set(to)))}
    to = [names[x] for x in to]
    out = Local([], [], [])
    out.ids = list(range(len(names)))
    out.index = {i: i for i in out.ids}
    out.vw, out.near = [0] * len(names), [{} for _ in names]
    for u, c in enumerate(to):
        out.vw[c] += g.vw[u]
        for v, w in g.near[u].items():
            if to[v] != c:
                out.near[c][to[v]] = out.near[c].get(to[v], 0) + w
    return out, to
