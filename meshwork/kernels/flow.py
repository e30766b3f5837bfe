"""Maximum flow, minimum cuts, and balanced cuts among the minimum ones."""

from __future__ import annotations

from collections.abc import Iterator
from random import Random


class Network:
    """Arcs in pairs: arc i and its reverse i ^ 1."""

    def __init__(self, n: int):
        self.n, self.to, self.cap = n, [], []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, u: int, v: int, c: int, back: int = 0) -> None:
        self.out[u].append(len(self.to))
        self.to.append(v)
        self.cap.append(c)
        self.out[v].append(len(self.to))
        self.to.append(u)
        self.cap.append(back)

    def _layers(self, s: int, t: int):
        """Hops from s as far as t needs them, or None if t isn't reached."""
        to, cap, out = self.to, self.cap, self.out
        level = [-1] * self.n
        level[s] = 0
        queue = [s]
        for u in queue:
            hops = level[u] + 1
            for a in out[u]:
                if cap[a] > 0 and level[v := to[a]] < 0:
                    level[v] = hops
                    if v == t:
                        return level
                    queue.append(v)
        return None

    def max_flow(self, s: int, t: int, bound: int | None = None) -> int:
        """By blocking flows in layered networks; stops early at `bound`."""
        to, cap, out = self.to, self.cap, self.out
        total = 0
        while (bound is None or total < bound) and (level := self._layers(s, t)):
            at = [0] * self.n
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    push = min([cap[a] for a in path])
                    for a in path:
                        cap[a] -= push
                        cap[a ^ 1] += push
                    total += push
                    first = next(i for i, a in enumerate(path) if not cap[a])
                    u = to[path[first] ^ 1]
                    del path[first:]
                    continue
                arcs, i, hops = out[u], at[u], level[u] + 1
                end = len(arcs)
                while i < end and not (cap[a := arcs[i]] > 0 and level[to[a]] == hops):
                    i += 1
                at[u] = i
                if i < end:
                    path.append(a)
                    u = to[a]
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break
        return total

    def _side(self, end: int, back: int) -> list[bool]:
        to, cap, out = self.to, self.cap, self.out
        seen = [False] * self.n
        seen[end] = True
        queue = [end]
        for u in queue:
            for a in out[u]:
                if cap[a ^ back] > 0 and not seen[v := to[a]]:
                    seen[v] = True
                    queue.append(v)
        return seen

    def source_side(self, s: int) -> list[bool]:
        return self._side(s, 0)

    def sink_side(self, t: int) -> list[bool]:
        return self._side(t, 1)

    def strong_components(self) -> list[int]:
        """The component of each node in the residual network, iteratively (Tarjan); successors have smaller numbers."""
        index, low, comp = [-1] * self.n, [0] * self.n, [-1] * self.n
        stack: list[int] = []
        count = found = 0
        for root in range(self.n):
            if index[root] >= 0:
                continue
            work = [(root, 0)]
            while work:
                u, i = work.pop()
                if index[u] < 0:
                    index[u] = low[u] = count
                    count += 1
                    stack.append(u)
                for j in range(i, len(self.out[u])):
                    a = self.out[u][j]
                    if self.cap[a] <= 0:
                        continue
                    v = self.to[a]
                    if index[v] < 0:
                        work.append((u, j))
                        work.append((v, 0))
                        break
                    if comp[v] < 0:
                        low[u] = min(low[u], low[v] if index[v] > index[u] else index[v])
                else:
                    if low[u] == index[u]:
                        while True:
                            v = stack.pop()
                            comp[v] = found
                            if v == u:
                                break
                        found += 1
        return comp


#: Random orders tried besides the natural one where there are too many free components to try all sets. Fixed value.
ORDERS = 12


def closed_sets(after: list[int]) -> Iterator[int]:
    """All sets of components, as bit masks, that hold what follows each of their members. after[i]: mask of what directly follows i, all of smaller number."""
    yield 0
    sets = [0]
    for i, need in enumerate(after):
        grown = [x | 1 << i for x in sets if x & need == need]
        yield from grown
        sets += grown


def random_order(after: list[int], rng: Random) -> list[int]:
    """An order in which all that follows a component stands before it, so that every prefix is closed; any of those that may come next is picked."""
    done, order = 0, []
    waiting = [bin(x).count("1") for x in after]
    users: list[list[int]] = [[] for _ in after]
    for i, need in enumerate(after):
        for j in range(i):
            if need >> j & 1:
                users[j].append(i)
    ready = [i for i, n in enumerate(waiting) if not n]
    while ready:
        at = rng.randrange(len(ready))
        ready[at], ready[-1] = ready[-1], ready[at]
        i = ready.pop()
        order.append(i)
        done |= 1 << i
        for u in users[i]:
            waiting[u] -= 1
            if not waiting[u]:
                ready.append(u)
    return order


def balanced_min_cut(net: Network, s: int, t: int, weight: list[int], low: int, high: int, exact: int = 12, orders: int = ORDERS) -> list[bool] | None:
    """Of all minimum cuts of a solved network, the source side whose weight is nearest to the middle of [low, high], or None if none is
    inside. A source side is a set of strong components closed under residual successors: all closed sets are tried if few components are free, else the
    prefixes of the topological order that the components are numbered by and of some random ones."""
    comp = net.strong_components()
    k = max(comp) + 1
    w = [0] * k
    for u, c in enumerate(comp):
        w[c] += weight[u]
    must = {comp[u] for u, x in enumerate(net.source_side(s)) if x}
    never = {comp[u] for u, x in enumerate(net.sink_side(t)) if x}
    free = [c for c in range(k) if c not in must and c not in never]
    place = {c: i for i, c in enumerate(free)}
    after = [0] * len(free)
    for u in range(net.n):
        i = place.get(comp[u])
        if i is None:
            continue
        for a in net.out[u]:
            j = place.get(comp[net.to[a]])
            if net.cap[a] > 0 and j is not None and j != i:
                after[i] |= 1 << j
    base, middle = sum(w[c] for c in must), (low + high) / 2
    best: tuple[float, set[int]] | None = None

    def offer(total: int, members) -> None:
        nonlocal best
        if low <= total <= high and (best is None or abs(total - middle) < best[0]):
            best = (abs(total - middle), set(members()))

    if len(free) <= exact:
        for mask in closed_sets(after):
            offer(base + sum(w[c] for i, c in enumerate(free) if mask >> i & 1), lambda mask=mask: (c for i, c in enumerate(free) if mask >> i & 1))
    else:
        rng = Random(len(free))
        for turn in range(orders + 1):
            order = random_order(after, rng) if turn else list(range(len(free)))  # smaller numbers follow, so prefixes of the natural order are closed
            total = base
            offer(total, lambda: ())
            for n, i in enumerate(order, 1):
                total += w[free[i]]
                offer(total, lambda n=n, order=order: (free[x] for x in order[:n]))
            if best is not None and best[0] < 1:
                break
    return None if best is None else [c in must or c in best[1] for c in comp]
