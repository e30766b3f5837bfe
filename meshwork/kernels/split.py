"""Splitting small graphs into blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

from meshwork.kernels.flow import Network, balanced_min_cut
from meshwork.kernels.local import Local, rng_of
from meshwork.kernels.paths import contract, global_paths

#: Larger graphs are contracted to about so many vertices before the flow bisection, and refined by flows on the way back.
FLOW_AT = 600


def farthest(g: Local, start: int) -> int:
    d = g.hops([start])
    return max(range(len(g)), key=lambda i: (d[i], -i))


def grow_half(g: Local, seed: int, target: int, most: int) -> list[bool]:
    """Greedy growing: from the seed, take the vertex whose neighbours are inside already for the largest part."""
    inside, weight = [False] * len(g), 0
    degree = [sum(x.values()) for x in g.near]
    conn = [0] * len(g)
    heap = [(0, seed)]
    while weight < target:
        while heap:
            key, u = heapq.heappop(heap)
            if not inside[u] and -key == 2 * conn[u] - degree[u] or u == seed and not inside[u]:
                break
        else:
            rest = [i for i in range(len(g)) if not inside[i] and weight + g.vw[i] <= most]
            if not rest:
                break
            u = rest[0]
        if weight + g.vw[u] > most:
            if not heap:
                rest = [i for i in range(len(g)) if not inside[i] and weight + g.vw[i] <= most]
                if not rest:
                    break
                u = rest[0]
            else:
                continue
        inside[u] = True
        weight += g.vw[u]
        for v, w in g.near[u].items():
            if not inside[v]:
                conn[v] += w
                heapq.heappush(heap, (degree[v] - 2 * conn[v], v))
    return inside


class Steps:
    """When a search should give up: gains since the best prefix, by their running mean and variance. As long as the mean could be chance it goes on; it ends
    once steps * mean^2 is above alpha * variance + beta."""

    def __init__(self, alpha: float = 1.0, beta: float = 0.0, least: int = 15):
        self.alpha, self.beta, self.least = alpha, beta, least
        self.reset()

    def reset(self) -> None:
        self.n, self.mean, self.spread = 0, 0.0, 0.0

    def add(self, gain: float) -> bool:
        """Takes a step's gain; whether to stop."""
        self.n += 1
        off = gain - self.mean
        self.mean += off / self.n
        self.spread += off * (gain - self.mean)
        return self.n > self.least and self.mean < 0 and self.n * self.mean**2 > self.alpha * self.spread / self.n + self.beta


def refine_pair(
    g: Local, side: list[int], most: tuple[int, int], extra: list[tuple[int, int]] | None = None, rounds: int = 3, factor: int = 1, base: tuple[int, int] = (0, 0), steps: Steps | None = None
) -> int:
    """Two-way local search with rollback: moves the best vertex that fits, each once a round, and keeps the best prefix; a round ends when `steps` says that what
    follows the best prefix falls for good. extra: what a vertex pays on side 0 and 1 for neighbours elsewhere; factor: what an edge between the sides costs; base: what
    the sides weigh besides. Returns the gain."""
    extra = extra or [(0, 0)] * len(g)
    steps = steps or Steps(beta=math.log(len(g) + 1))
    total = 0
    for _ in range(rounds):
        load = [base[x] + sum(w for w, s in zip(g.vw, side, strict=True) if s == x) for x in (0, 1)]
        gain = [factor * sum(w if side[v] != side[u] else -w for v, w in g.near[u].items()) + extra[u][side[u]] - extra[u][1 - side[u]] for u in range(len(g))]
        heap = [(-gain[u], u) for u in range(len(g))]
        heapq.heapify(heap)
        locked, moved, now, best, best_at, held = [False] * len(g), [], 0, 0, 0, []
        over = max(0, load[0] - most[0]) + max(0, load[1] - most[1])
        best_over = over
        steps.reset()
        while heap:
            key, u = heapq.heappop(heap)
            if locked[u] or -key != gain[u]:
                continue
            to = 1 - side[u]
            if load[to] + g.vw[u] > most[to]:
                held.append((key, u))
                continue
            locked[u] = True
            load[side[u]] -= g.vw[u]
            load[to] += g.vw[u]
            side[u] = to
            now += gain[u]
            moved.append(u)
            for v, w in g.near[u].items():
                if not locked[v]:
                    gain[v] += 2 * factor * (w if side[v] != to else -w)
                    heapq.heappush(heap, (-gain[v], v))
            for x in held:
                heapq.heappush(heap, x)
            held = []
            over = max(0, load[0] - most[0]) + max(0, load[1] - most[1])
            if (over, -now) < (best_over, -best):
                best, best_over, best_at = now, over, len(moved)
                steps.reset()
            elif steps.add(gain[u]):
                break
        for u in moved[best_at:]:
            side[u] = 1 - side[u]
        total += best
        if not best_at:
            break
    return total


def refine_flow(g: Local, side: list[int], most: tuple[int, int], extra: list[tuple[int, int]] | None = None, factor: int = 1, alpha: float = 2.0, base: tuple[int, int] = (0, 0)) -> int:
    """Replaces the cut in a corridor around the border by a minimum cut of it. The corridor grows from the border on each side as long as the
    other side could take it. base: what the sides weigh besides. Returns the gain; the sides change only if it is positive, or zero and better balanced."""
    extra = extra or [(0, 0)] * len(g)
    whole = g.total + base[0] + base[1]
    load = [base[x] + sum(w for w, s in zip(g.vw, side, strict=True) if s == x) for x in (0, 1)]
    border = [u for u in range(len(g)) if any(side[v] != side[u] for v in g.near[u])]
    if not border:
        return 0
    region = [False] * len(g)
    for x in (0, 1):
        room = max(0, alpha * (most[1 - x] - load[1 - x]))
        d = g.hops([u for u in border if side[u] == x], [s == x for s in side])
        for u in sorted((i for i in range(len(g)) if side[i] == x and d[i] >= 0), key=lambda i: (d[i], i)):
            if g.vw[u] <= room:
                region[u] = True
                room -= g.vw[u]
    inner = [u for u in range(len(g)) if region[u]]
    if not inner:
        return 0
    at = {u: i for i, u in enumerate(inner)}
    n = len(inner)
    net, weight = Network(n + 2), [g.vw[u] for u in inner] + [0, 0]
    s, t = n, n + 1
    fixed = [load[x] - sum(g.vw[u] for u in inner if side[u] == x) for x in (0, 1)]
    before = 0
    for u in inner:
        pull = list(extra[u])
        for v, w in g.near[u].items():
            if v in at:
                if at[u] < at[v]:
                    net.add(at[u], at[v], factor * w, factor * w)
                    before += factor * w * (side[u] != side[v])
            else:
                pull[1 - side[v]] += factor * w
        low = min(pull)
        if pull[1] - low:
            net.add(s, at[u], pull[1] - low)
        if pull[0] - low:
            net.add(at[u], t, pull[0] - low)
        before += pull[side[u]] - low
    flow = net.max_flow(s, t)
    if flow > before:
        return 0
    own = whole - most[1], most[0]
    left = balanced_min_cut(net, s, t, weight, own[0] - fixed[0], own[1] - fixed[0])
    if left is None:
        return 0
    after = fixed[0] + sum(weight[i] for i in range(n) if left[i])
    if flow == before and abs(2 * after - whole) >= abs(2 * load[0] - whole):
        return 0
    for u in inner:
        side[u] = 0 if left[at[u]] else 1
    return before - flow


class Piercing:
    """A flow between terminals around a and b that goes on as they grow."""

    def __init__(self, g: Local, a: int, b: int):
        n = len(g)
        self.g, self.net, self.s, self.t, self.value = g, Network(n + 2), n, n + 1, 0
        for u in range(n):
            for v, w in g.near[u].items():
                if u < v:
                    self.net.add(u, v, w, w)
        self.ends, self.held = (a, b), {}
        self.from_b, self.from_a = g.hops([b]), g.hops([a])
        self.hold(a, 0)
        self.hold(b, 1)

    def hold(self, u: int, x: int) -> None:
        big = 1 << 50
        self.held[u] = x
        if x == 0:
            self.net.add(self.s, u, big)
        else:
            self.net.add(u, self.t, big)

    def flow(self, limit: int | None = None) -> int:
        """The minimum cut between the terminals as they are; a bound at or above `limit` if that is reached. It is no more than any cut that the job can end with."""
        if limit is None or self.value < limit:
            self.value += self.net.max_flow(self.s, self.t, None if limit is None else limit - self.value)
        return self.value

    def grow(self, most: int) -> None:
        """Terminals become balls of `most` weight at most: both searches go on by turns, the lighter first, and skip what is too heavy."""
        queues = [[self.ends[0]], [self.ends[1]]]
        at, load = [0, 0], [self.g.vw[u] for u in self.ends]
        while True:
            able = [x for x in (0, 1) if load[x] < most and at[x] < len(queues[x])]
            if not able:
                return
            x = min(able, key=lambda x: load[x])
            u = queues[x][at[x]]
            at[x] += 1
            for v in sorted(self.g.near[u]):
                if v not in self.held and load[x] + self.g.vw[v] <= most:
                    self.hold(v, x)
                    queues[x].append(v)
                    load[x] += self.g.vw[v]

    def run(self, low: int, high: int) -> list[bool] | None:
        """The first side, of a weight in [low, high]: the lighter side is closed into its terminal, with one more vertex from the border (piercing), and the
        flow goes on. None if no vertex is left to take."""
        g, net, s, t, held = self.g, self.net, self.s, self.t, self.held
        n = len(g)
        for _ in range(2 * n):
            self.flow()
            left, right = net.source_side(s), net.sink_side(t)
            wl, wr = sum(g.vw[i] for i in range(n) if left[i]), sum(g.vw[i] for i in range(n) if right[i])
            # every minimum cut's first side holds `left` and nothing of `right`
            got = balanced_min_cut(net, s, t, [*g.vw, 0, 0], low, high, exact=6) if wl <= high and g.total - wr >= low else None
            if got is not None:
                return got[:n]
            x = 0 if wl <= wr else 1
            mine, theirs = (left, right) if x == 0 else (right, left)
            grown = [i for i in range(n) if mine[i]]
            for i in grown:
                if i not in held:
                    self.hold(i, x)
            away = self.from_b if x == 0 else self.from_a
            next_ = {v for i in grown for v in g.near[i] if not mine[v]} or {i for i in range(n) if not mine[i] and not theirs[i]}
            next_ = [v for v in next_ if not theirs[v]] or [v for v in next_ if v not in held]
            if not next_:
                return None
            self.hold(max(next_, key=lambda i: (away[i], -sum(w for v, w in g.near[i].items() if not mine[v]), -i)), x)
        return None


def flow_half(g: Local, a: int, b: int, low: int, high: int, rng) -> list[bool] | None:
    """Minimum cut between terminals around a and b, which grow until the first side's weight lies in [low, high]."""
    return Piercing(g, a, b).run(low, high)


def flow_bisection(g: Local, start: int, most: tuple[int, int], rng) -> list[bool] | None:
    """Flow bisection from two far ends, by levels: matched vertices are contracted until few are left, the minimum cut of these is
    projected back, and each level's cut is replaced by a minimum cut of its corridor."""
    low, high = g.total - most[1], most[0]
    stack, now = [], g
    cap = max(1, g.total // 20)
    while len(now) > FLOW_AT:
        edges = [(w / max(1, now.vw[u] * now.vw[v]), u, v) for u in range(len(now)) for v, w in now.near[u].items() if u < v and now.vw[u] + now.vw[v] <= cap]
        small, to = contract(now, global_paths(edges))
        if len(small) > 0.95 * len(now):
            break
        stack.append((now, to))
        start, now = to[start], small
    a = farthest(now, start)
    b = farthest(now, a)
    half = flow_half(now, a, b, low, high, rng) if a != b else None
    while stack and half is not None:
        now, to = stack.pop()
        side = [0 if half[c] else 1 for c in to]
        refine_pair(now, side, most)
        refine_flow(now, side, most)
        half = [s == 0 for s in side]
    return half


def bisect(g: Local, share: float, most: tuple[int, int], method: str = "flow", trials: int = 4, seed: int = 0) -> list[int]:
    """Sides 0 and 1 of about share and 1 - share of the weight: the best of some trials, balanced first, then by cut."""
    n, best = len(g), None
    if n < 2:
        return [0] * n
    parts = g.components()
    target = round(share * g.total)
    rng = rng_of(seed, n)
    for trial in range(trials):
        side = None
        if len(parts) > 1:  # whole components first fit, the heaviest first
            side, load = [1] * n, 0
            for c in sorted(parts, key=lambda c: (-sum(g.vw[i] for i in c), c[0])):
                w = sum(g.vw[i] for i in c)
                if load + w <= most[0] and load < target:
                    load += w
                    for i in c:
                        side[i] = 0
            if g.total - load > most[1]:
                side = None
        if side is None:
            start = int(rng.integers(n))
            half = flow_bisection(g, start, most, rng) if method == "flow" and len(parts) == 1 else None
            if half is None:
                half = grow_half(g, farthest(g, start), target, most[0])
            side = [0 if x else 1 for x in half]
        refine_pair(g, side, most)
        load = sum(w for w, s in zip(g.vw, side, strict=True) if s == 0)
        key = (max(0, load - most[0]) + max(0, g.total - load - most[1]), g.cut(side))
        if best is None or key < best[0]:
            best = (key, side)
    return best[1]


def split(g: Local, k: int, most: int, method: str = "flow", trials: int = 4, seed: int = 0) -> list[int]:
    """Blocks 0..k-1 of weight `most` at most (if the vertices allow it), by recursive bisection."""
    if k == 1 or not len(g):
        return [0] * len(g)
    left = k // 2
    side = bisect(g, left / k, (most * left, most * (k - left)), method, trials, seed)
    out = [0] * len(g)
    for x, parts, base in ((0, left, 0), (1, k - left, left)):
        own = [i for i in range(len(g)) if side[i] == x]
        for i, b in zip(own, split(g.part(own), parts, most, method, trials, seed + 1 + x), strict=True):
            out[i] = base + b
    return out


def greedy(g: Local, k: int, most: int, distance: Callable[[int, int], int]) -> list[int]:
    """Heaviest connections first: each vertex goes to the block that costs least, the lighter one on ties."""
    pid, load = [-1] * len(g), [0] * k
    for u in sorted(range(len(g)), key=lambda i: (-sum(g.near[i].values()), i)):
        cost = [0] * k
        for v, w in g.near[u].items():
            if pid[v] >= 0:
                for b in range(k):
                    cost[b] += w * distance(b, pid[v])
        fits = [b for b in range(k) if load[b] + g.vw[u] <= most] or list(range(k))
        b = min(fits, key=lambda b: (cost[b], load[b], b))
        pid[u] = b
        load[b] += g.vw[u]
    return pid


def hill_climb(g: Local, pid: list[int], k: int, most: int, distance: Callable[[int, int], int], passes: int = 5) -> int:
    """Moves single vertices to the best block that has room while that gains; returns the gain."""
    load = [0] * k
    for u, b in enumerate(pid):
        load[b] += g.vw[u]
    total = 0
    for _ in range(passes):
        moved = 0
        for u in range(len(g)):
            conn: dict[int, int] = {}
            for v, w in g.near[u].items():
                conn[pid[v]] = conn.get(pid[v], 0) + w
            here = sum(w * distance(pid[u], b) for b, w in conn.items())
            best = min(((sum(w * distance(c, b) for b, w in conn.items()), load[c], c) for c in conn if c != pid[u] and load[c] + g.vw[u] <= most), default=None)
            if best and best[0] < here:
                load[pid[u]] -= g.vw[u]
                pid[u] = best[2]
                load[best[2]] += g.vw[u]
                total += here - best[0]
                moved += 1
        if not moved:
            break
    return total
