"""How often the items of two blocks share a key: a block is one row, its items by key, so a pair of blocks is counted without its meetings ever being shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

BLOCK = "block long, items binary, kinds array<string>, hours binary, starts binary, members binary"
PAIRS = "u long, v long, w long"
#: Meetings counted at a time. Fixed value.
MEETINGS = 1 << 19


def block_of(key, rows: pd.DataFrame) -> pd.DataFrame:
    """The distinct rows (u, kind, h) of a block as one row: its items, its keys (kind, hour), and for each key from `starts` on the places of its items."""
    items, member = np.unique(rows["u"].to_numpy(), return_inverse=True)
    kind, names = pd.factorize(rows["kind"])
    hour = rows["h"].to_numpy()
    order = np.lexsort((member, hour, kind))
    kind, hour, member = kind[order], hour[order], member[order]
    new = np.r_[True, (kind[1:] != kind[:-1]) | (hour[1:] != hour[:-1])]
    starts = np.r_[np.flatnonzero(new), len(rows)]
    return pd.DataFrame({"block": [int(key[0])], "items": [items.astype("i8").tobytes()], "kinds": [[str(names[x]) for x in kind[new]]], "hours": [hour[new].astype("i8").tobytes()],
                         "starts": [starts.astype("i4").tobytes()], "members": [member.astype("i4").tobytes()]})


def shared(x: dict, y: dict) -> Iterator[pa.RecordBatch]:
    """(u, v, w), both ways: the pairs of an item of block x and one of block y, which may be the same block, and how many keys they share."""
    same = x["block"] == y["block"]
    us, vs = np.frombuffer(x["items"], "i8"), np.frombuffer(y["items"], "i8")
    at = {k: i for i, k in enumerate(zip(y["kinds"], np.frombuffer(y["hours"], "i8").tolist(), strict=True))}
    to = np.array([at.get(k, -1) for k in zip(x["kinds"], np.frombuffer(x["hours"], "i8").tolist(), strict=True)], "i8")
    key = np.repeat(to, np.diff(np.frombuffer(x["starts"], "i4")))
    mine, theirs = np.frombuffer(x["members"], "i4")[key >= 0].astype("i8"), np.frombuffer(y["members"], "i4")
    key = key[key >= 0]
    order = np.argsort(mine, kind="stable")
    mine, key = mine[order], key[order]
    starts = np.frombuffer(y["starts"], "i4").astype("i8")
    first, many = starts[key], starts[key + 1] - starts[key]
    upto, rows = np.r_[0, np.cumsum(many)], np.searchsorted(mine, np.arange(len(us) + 1))
    ends, n = upto[rows], len(vs)

    def cells(i: int, j: int, lo: int) -> np.ndarray:
        m = many[i:j]
        place = np.arange(upto[j] - upto[i]) + np.repeat(first[i:j] - (upto[i:j] - upto[i]), m)
        return np.repeat((mine[i:j] - lo) * n, m) + theirs[place]

    lo = 0
    while lo < len(us):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + MEETINGS, "right")) - 1)
        i, stop, size = int(rows[lo]), int(rows[hi]), (hi - lo) * n
        if hi > lo + 1 and size > 4 * MEETINGS:  # few meetings among many items
            cell, w = np.unique(cells(i, stop, lo), return_counts=True)
        else:
            count = np.zeros(size, "i8")
            while i < stop:
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + MEETINGS, "right")) - 1)
                j = min(j, stop)
                count += np.bincount(cells(i, j, lo), minlength=size)
                i = j
            cell = np.flatnonzero(count)
            w = count[cell]
        a, b = lo + cell // n, cell % n
        if same:
            a, b, w = a[a != b], b[a != b], w[a != b]
        u, v = us[a], vs[b]
        if not same:
            u, v, w = np.r_[u, v], np.r_[v, u], np.r_[w, w]
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(w.astype("i8"))], ["u", "v", "w"])
        lo = hi


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks with the pair (a, b) of blocks that they are sent for, sorted by that: both blocks of a pair follow each other, a block that meets itself comes once."""
    held = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["a"] == row["b"]:
                yield from shared(row, row)
            elif held is None:
                held = row
            else:
                yield from shared(held, row)
                held = None
