"""A whole multilevel solve of a graph that fits into one task."""

from __future__ import annotations

from meshwork.functions.hierarchy import Machine
from meshwork.functions.scalars import adaptive_imbalance
from meshwork.kernels.local import Local
from meshwork.kernels.paths import contract, global_paths
from meshwork.kernels.split import greedy, hill_climb, refine_flow, refine_pair, split


def multisection(g: Local, m: Machine, lmax: int, weight: int, eps: float, method: str, seed: int) -> list[int]:
    """Outermost level first; each item's bound keeps the final one within reach."""
    pid = [0] * len(g)
    for level in range(len(m.sizes) - 1, -1, -1):
        k, stride = m.sizes[level], m.strides[level - 1] if level else 1
        items: dict[int, list[int]] = {}
        for u, b in enumerate(pid):
            items.setdefault(b, []).append(u)
        for b, members in items.items():
            part = g.part(members)
            free = adaptive_imbalance(eps, weight, m.k, max(1, part.total), k * stride, level + 1)
            most = max(lmax, -(-part.total // k)) if stride == 1 else max(min(lmax * stride, int((1 + free) * part.total / k) + 1), -(-part.total // k))
            for u, x in zip(members, split(part, k, most, method, 2, seed + b), strict=True):
                pid[u] = b + x * stride
    return pid


def rebalance(g: Local, pid: list[int], m: Machine, lmax: int) -> None:
    """Moves the cheapest vertices out of overloaded blocks, to neighbour blocks or else to any with room."""
    load = [0] * m.k
    for u, b in enumerate(pid):
        load[b] += g.vw[u]
    for b in range(m.k):
        if load[b] <= lmax:
            continue

        def price(u, to):
            return sum(w * (m.between(to, pid[v]) - m.between(pid[u], pid[v])) for v, w in g.near[u].items())

        options = []
        for u in (i for i, x in enumerate(pid) if x == b):
            targets = {pid[v] for v in g.near[u]} - {b}
            fits = [t for t in targets if load[t] + g.vw[u] <= lmax] or [t for t in range(m.k) if t != b and load[t] + g.vw[u] <= lmax]
            if fits:
                options.append(min((price(u, t), t) for t in fits) + (u,))
        for _, _, u in sorted(options):
            if load[b] <= lmax:
                break
            fits = [t for t in range(m.k) if t != b and load[t] + g.vw[u] <= lmax]
            if fits:
                t = min(fits, key=lambda t: (price(u, t), t))
                load[b] -= g.vw[u]
                load[t] += g.vw[u]
                pid[u] = t


def refine_pairs(g: Local, pid: list[int], m: Machine, lmax: int, fm: int, flow: int, alpha: float, again: int = 1) -> None:
    """Pairs of adjacent blocks by falling shared cost: local search, then minimum cuts."""
    for turn in range(max(fm, flow)):
        shared: dict[tuple[int, int], int] = {}
        for u in range(len(g)):
            for v, w in g.near[u].items():
                if pid[u] < pid[v]:
                    key = (pid[u], pid[v])
                    shared[key] = shared.get(key, 0) + w * m.between(*key)
        gained = 0
        for a, b in sorted(shared, key=lambda p: (-shared[p], p)):
            members = [u for u, x in enumerate(pid) if x in (a, b)]
            part = g.part(members)
            extra = []
            for u in members:
                outer = [(w, pid[v]) for v, w in g.near[u].items() if pid[v] not in (a, b)]
                extra.append((sum(w * m.between(a, x) for w, x in outer), sum(w * m.between(b, x) for w, x in outer)))
            side = [0 if pid[u] == a else 1 for u in members]
            if turn < fm:
                gained += refine_pair(part, side, (lmax, lmax), extra, 2, m.between(a, b))
            if turn < flow:
                for _ in range(again):
                    got = refine_flow(part, side, (lmax, lmax), extra, m.between(a, b), alpha)
                    gained += got
                    if not got:
                        break
            for u, s in zip(members, side, strict=True):
                pid[u] = b if s else a
        if not gained:
            break


def solve(g: Local, m: Machine, lmax: int, weight: int, eps: float, c: int = 8, method: str = "flow", lp: int = 5, fm: int = 1, flow: int = 0, alpha: float = 2.0, seed: int = 0, again: int = 1) -> list[int]:
    stack, now = [], g
    cap = max(1, weight // (2 * m.k))
    while len(now) > max(m.k * c, 40):
        edges = [(w / max(1, now.vw[u] * now.vw[v]), u, v) for u in range(len(now)) for v, w in now.near[u].items() if u < v and now.vw[u] + now.vw[v] <= cap]
        small, to = contract(now, global_paths(edges))
        if len(small) > 0.95 * len(now):
            break
        stack.append((now, to))
        now = small
    pid = greedy(now, m.k, lmax, m.between) if method == "greedy" else multisection(now, m, lmax, weight, eps, method, seed)
    while True:
        rebalance(now, pid, m, lmax)
        hill_climb(now, pid, m.k, lmax, m.between, lp)
        refine_pairs(now, pid, m, lmax, fm, flow, alpha, again)
        if not stack:
            return pid
        now, to = stack.pop()
        pid = [pid[c] for c in to]
