"""A small graph in memory with ids 0..n-1."""

from __future__ import annotations

from collections import deque

import numpy as np


class Local:
    def __init__(self, ids, weights, edges):
        """ids: original ids; edges: rows (u, v, w) by original id, both directions; ends outside are dropped."""
        self.ids = [int(x) for x in ids]
        self.index = {x: i for i, x in enumerate(self.ids)}
        self.vw = [int(x) for x in weights]
        self.near: list[dict[int, int]] = [{} for _ in self.ids]
        for u, v, w in edges:
            i, j = self.index.get(int(u)), self.index.get(int(v))
            if i is not None and j is not None and i != j:
                self.near[i][j] = self.near[i].get(j, 0) + int(w)

    def __len__(self):
        return len(self.ids)

    @property
    def total(self) -> int:
        return sum(self.vw)

    def part(self, members: list[int]) -> Local:
        out = Local([], [], [])
        out.ids = [self.ids[i] for i in members]
        out.index = {x: i for i, x in enumerate(out.ids)}
        at = {m: i for i, m in enumerate(members)}
        out.vw = [self.vw[i] for i in members]
        out.near = [{at[j]: w for j, w in self.near[i].items() if j in at} for i in members]
        return out

    def hops(self, sources, inside=None) -> list[int]:
        """Hop distance from the sources, -1 where none is reached."""
        dist = [-1] * len(self)
        queue = deque()
        for s in sources:
            dist[s] = 0
            queue.append(s)
        while queue:
            u = queue.popleft()
            for v in self.near[u]:
                if dist[v] < 0 and (inside is None or inside[v]):
                    dist[v] = dist[u] + 1
                    queue.append(v)
        return dist

    def components(self) -> list[list[int]]:
        seen, out = [False] * len(self), []
        for s in range(len(self)):
            if not seen[s]:
                got = [i for i, d in enumerate(self.hops([s], [not x for x in seen])) if d >= 0]
                for i in got:
                    seen[i] = True
                out.append(got)
        return out

    def cut(self, side) -> int:
        return sum(w for u in range(len(self)) for v, w in self.near[u].items() if u < v and side[u] != side[v])

    def cost(self, pid, distance) -> int:
        return sum(w * distance(pid[u], pid[v]) for u in range(len(self)) for v, w in self.near[u].items())


def rng_of(*parts: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(list(parts)))
