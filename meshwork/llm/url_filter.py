"""URL filters by a bit-parallel wildcard automaton (Shift-And with self-loops over several machine words)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from meshwork.llm.textbytes import text_bytes

#: Fixed values of the contract: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: What the method blocks where no rule fits: globs over host + path. `*` stands for bytes other than `/`, `**` for any.
BLOCKED = ["*/cgi-bin/**", "*/wp-login**", "ads.**", "*/ads/**"]
GROUP = 4096


class Automaton:
    """All globs at once. A glob's tokens take a bit each after its start bit; the bit of token j says that the tokens up to j
    match the bytes so far. A byte moves all bits by one place and keeps those whose token it fits; a wildcard before a token is
    a loop on the bit before it."""

    def __init__(self, globs: list[str]):
        place, step, loops, starts, finals = 0, [], [], [], []
        for g in globs:
            starts.append(place)
            raw, i = g.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loops.append((place, True))
                    i += 2
                elif raw[i : i + 1] == b"*":
                    loops.append((place, False))
                    i += 1
                else:
                    place += 1
                    step.append((place, raw[i]))
                    i += 1
            finals.append(place)
            place += 1
        self.words = place // 64 + 1
        bit = lambda p: (p // 64, np.uint64(1 << (p % 64)))
        self.move = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for p, c in step:
            w, b = bit(p)
            self.move[c, w] |= b
        for p, any_byte in sorted(loops):  # of several wildcards at one place, the one for any byte counts
            w, b = bit(p)
            slash = self.stay[ord("/"), w] if any_byte else self.stay[ord("/"), w] & ~b
            self.stay[:, w] |= b
            if not any_byte:
                self.stay[ord("/"), w] = slash
        for p in starts:
            w, b = bit(p)
            self.start[w] |= b
        self.finals = [bit(p) for p in finals]

    def matches(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """texts x globs: which globs match which whole texts. Texts of like length run together, a byte of each at a time."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        out = np.zeros((len(size), len(self.finals)), bool)
        for lo in range(0, len(order), GROUP):
            rows = order[lo : lo + GROUP]
            n = size[rows]
            state = np.tile(self.start, (len(rows), 1))
            live = len(rows)
            for t in range(int(n[0]) if len(n) else 0):
                while n[live - 1] <= t:
                    live -= 1
                c = raw[off[rows[:live]] + t]
                s = state[:live]
                shifted = s << np.uint64(1)
                shifted[:, 1:] |= s[:, :-1] >> np.uint64(63)
                state[:live] = (shifted & self.move[c]) | (s & self.stay[c])
            for g, (w, b) in enumerate(self.finals):
                out[rows, g] = (state[:, w] & b) != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part after the first `://` up to `/`, `?`, `#` or the end, ASCII lower case; and from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filter(pages: DataFrame, url: str = "url", rules=None, blocked=None) -> DataFrame:
    """Adds host, path, rule (host + path of the longest rule that fits, else null) and verdict (allow or block).

    A rule fits its host and all subdomains where the path starts with the rule's; of equally long ones, the one of the longer
    host, then the smaller text, wins. Without a rule the verdict is block if a glob of `blocked` matches, else allow. A url that is
    null, empty or without `://` has empty host and path, so no rule. Columns of these names are replaced, others of any name stay; rows stay as they
    are, repeated ones too.
    """
    rules, blocked = RULES if rules is None else rules, BLOCKED if blocked is None else blocked
    rules = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    globs = [g for _, h, p in rules for g in (f"{h}{p}**", f"*.{h}{p}**")] + list(blocked)
    names, verdicts = [h + p for _, h, p in rules], [v for v, _, _ in rules]
    host, path = host_and_path(F.col(url))
    carried = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # the row travels as one struct with names of its own, so that no column's name can clash
    row = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    base = pages.select(row.alias("row"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(globs)
        for batch in batches:
            key = pc.binary_join_element_wise(batch.column("host"), batch.column("path"), "")
            hit = auto.matches(*text_bytes(key))
            by_rule = hit[:, : 2 * len(rules)].reshape(len(hit), len(rules), 2).any(2) if rules else np.zeros((len(hit), 1), bool)
            which = np.where(by_rule.any(1), by_rule.argmax(1), -1)
            bad = hit[:, 2 * len(rules) :].any(1)
            rule = [names[i] if i >= 0 else None for i in which.tolist()]
            verdict = [verdicts[i] if i >= 0 else "block" if b else "allow" for i, b in zip(which.tolist(), bad.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["row", "host", "path", "rule", "verdict"])

    out = base.mapInArrow(run, f"row {base.schema['row'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carried)], "host", "path", "rule", "verdict")
