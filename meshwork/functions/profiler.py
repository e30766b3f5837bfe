"""Nested scopes with calls and seconds, as a table and as JSON."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager


class Profiler:
    """with profiler.scope("solve"): ...; scopes inside others are their children."""

    def __init__(self):
        self.calls: dict[tuple[str, ...], int] = {}
        self.seconds: dict[tuple[str, ...], float] = {}
        self._open: list[str] = []

    @contextmanager
    def scope(self, name: str) -> Iterator[None]:
        self._open.append(name)
        path, start = tuple(self._open), time.perf_counter()
        self.calls.setdefault(path, 0)
        self.seconds.setdefault(path, 0.0)
        try:
            yield
        finally:
            self.calls[path] += 1
            self.seconds[path] += time.perf_counter() - start
            self._open.pop()

    def rows(self) -> list[tuple[str, int, int, float, float, float]]:
        """(path, depth, calls, total, average, share of the parent), parents before children in the order in which they were first entered."""
        def below(parent: tuple[str, ...]) -> list:
            out = []
            for p in [p for p in self.calls if p[:-1] == parent]:
                total = self.seconds[p]
                whole = self.seconds.get(parent) or sum(x for q, x in self.seconds.items() if len(q) == 1)
                out.append(("/".join(p), len(p) - 1, self.calls[p], total, total / max(1, self.calls[p]), total / whole if whole else 0.0))
                out += below(p)
            return out

        return below(())

    def to_json(self) -> str:
        def tree(parent: tuple[str, ...]) -> list:
            return [{"name": p[-1], "calls": self.calls[p], "total": self.seconds[p], "children": tree(p)} for p in self.calls if p[:-1] == parent]

        return json.dumps(tree(()))
