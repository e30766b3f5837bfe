"""Small assignment problems."""

from __future__ import annotations


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in a perfect matching of least cost (square matrix), by shortest augmenting paths with potentials."""
    n = len(cost)
    inf = float("inf")
    row_of, price_r, price_c = [-1] * n, [0.0] * n, [0.0] * n
    for start in range(n):
        dist, before, done = [inf] * n, [-1] * n, [False] * n
        row, col = start, -1
        reach = 0.0
        while True:
            nxt = -1
            for j in range(n):
                if done[j]:
                    continue
                d = reach + cost[row][j] - price_r[row] - price_c[j]
                if d < dist[j]:
                    dist[j], before[j] = d, col
                if nxt < 0 or dist[j] < dist[nxt]:
                    nxt = j
            reach, col = dist[nxt], nxt
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        for j in range(n):
            if done[j]:
                price_c[j] += dist[j] - reach
                if row_of[j] >= 0:
                    price_r[row_of[j]] += reach - dist[j]
        price_r[start] += reach
        while col >= 0:
            prev = before[col]
            row_of[col] = row_of[prev] if prev >= 0 else start
            col = prev
    out = [0] * n
    for j, r in enumerate(row_of):
        out[r] = j
    return out
