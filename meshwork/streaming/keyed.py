"""Edits as keyed state: a stream of edits keeps every vertex and edge in Spark's state store, so a batch costs what it touches.

The key is a vertex. Its state is its weight and its edges, by neighbour, so each edge has a copy at either end. An edit of an edge goes to both ends; the removal of a vertex
clears the copies at that vertex only. A copy left at a neighbour is stale: it has seen all edits since that the other has, after a start above zero, and
adding, taking off with a floor of zero, setting and removing never let it fall below the other. So an edge exists if both copies do, and weighs what the
smaller of them says, which is what the fold over the whole log gives (`dynamic.snapshot`).

A question to the state store is a message to another process, so edges lie in pages of about PAGE: a batch asks for each page that it touches once and writes it once. Which page
holds a neighbour is told by a hash, and a vertex with more edges than its pages are for gets twice as many.

Each batch emits the rows that it changed: (kind, u, v, w, seq), kind "v" a vertex (v null), "e" a copy of an edge, w null where it is gone. `latest` keeps the last of each key, `graph_of`
makes the graph of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from meshwork.sources.graph import Graph

CHANGES = "kind string, u long, v long, w long, seq long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Edges in a page of a vertex's state on average, at most. Fixed value.
PAGE = 256


def page_of(v: int, pages: int) -> int:
    """The page of a neighbour, of a power of two of pages."""
    return (v * 0x9E3779B97F4A7C15 & 2**64 - 1) >> 32 & pages - 1


def routed(events: DataFrame) -> DataFrame:
    """(u, seq, op, v, w): each edit once for every vertex whose state it changes; edits of edges go to both ends, loops nowhere."""
    edge = F.col("op").isin("+e", "-e", "ew")
    to = F.when(edge, F.when(F.col("u") != F.col("v"), F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))))
    to = to.when(F.col("op").isin("+v", "-v", "vw"), F.array(F.struct(F.col("u").alias("a"), F.lit(None).cast("long").alias("b"))))
    sent = events.where("u is not null").select("seq", "op", "w", F.explode(to).alias("x"))
    return sent.select(F.col("x.a").alias("u"), "seq", "op", F.col("x.b").alias("v"), "w")


class Edits(StatefulProcessor):
    """Applies the edits of one vertex in the order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "w long, n long, pages long")
        self.pages = handle.getMapState("pages", "page long", "v array<long>, w array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        edits = sorted(rows, key=lambda r: r["seq"])
        head = self.head.get() if self.head.exists() else None
        before, n, pages = (int(x) for x in head) if head else (0, 0, 1)
        now = before
        held: dict[int, dict[int, int]] = {}  # the pages that the batch touches, as they were
        seen: dict[int, int | None] = {}  # copies as they are, of those that the batch touches
        was: dict[int, int | None] = {}

        def page(p: int) -> dict[int, int]:
            if p not in held:
                got = self.pages.getValue((p,)) if n else None
                held[p] = dict(zip(map(int, got[0]), map(int, got[1]), strict=True)) if got else {}
            return held[p]

        def copy(v: int) -> int | None:
            if v not in seen:
                seen[v] = was[v] = page(page_of(v, pages)).get(v)
            return seen[v]

        for op, v, given, last in ((r["op"], r["v"], r["w"], r["seq"]) for r in edits):
            if op == "+v":
                now += 1 if given is None else given
            elif op == "vw":
                now = 1 if given is None else given
            elif op == "-v":
                now = 0
                for x in [x for p in range(pages) for x in page(p)]:
                    copy(x)
                seen = dict.fromkeys(seen)
            else:
                other, old = v, copy(v)
                if op == "+e":
                    seen[other] = (old or 0) + (1 if given is None else given)
                elif op == "ew":
                    seen[other] = given
                else:
                    seen[other] = None if given is None else max(0, (old or 0) - given)
                if (seen[other] or 0) <= 0:
                    seen[other] = None
                if op != "-e" and not now:
                    now = 1
        changed = {v: w for v, w in seen.items() if w != was[v]}
        self._write(changed, was, page, held, n, pages, before, now)
        row = Row("kind", "u", "v", "w", "seq")
        if now != before:
            yield row("v", key[0], None, now or None, last)
        for v, w in changed.items():
            yield row("e", key[0], v, w, last)

    def _write(self, changed: dict, was: dict, page, held: dict[int, dict[int, int]], n: int, pages: int, before: int, now: int) -> None:
        """Writes the pages that changed, or all of them where there must be more."""
        count = n + sum((w is not None) - (was[v] is not None) for v, w in changed.items())
        many, dirty = pages, {page_of(v, pages) for v in changed}
        while count > PAGE * many:
            many *= 2
        if many > pages:
            every = {v: w for p in range(pages) for v, w in page(p).items()}
            dirty = set(range(many))
            held = {p: {} for p in dirty}
            for v, w in every.items():
                held[page_of(v, many)][v] = w
        for v, w in changed.items():
            if w is None:
                held[page_of(v, many)].pop(v, None)
            else:
                held[page_of(v, many)][v] = w
        for p in dirty:
            if held[p]:
                self.pages.updateValue((p,), (list(held[p]), list(held[p].values())))
            elif n:
                self.pages.removeKey((p,))
        if (now, count, many) != (before, n, pages):
            self.head.update((now, count, many))

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """(kind, u, v, w, seq): what each batch of a stream of edits (seq, op, u, v, w) changes. The session's state store must be RocksDB (`ROCKS`)."""
    return routed(events).groupBy("u").transformWithState(Edits(), CHANGES, "Update", "None")


def latest(log: DataFrame) -> DataFrame:
    """The last row of each vertex and of each copy of an edge, gone ones left out."""
    last = log.groupBy("kind", "u", "v").agg(F.max_by("w", "seq").alias("w"))
    return last.where("w is not null")


def graph_of(log: DataFrame) -> Graph:
    """The graph of a log of changes."""
    now = latest(log)
    copies = now.where("kind = 'e'").select("u", "v", "w")
    both = copies.join(copies.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("w").alias("other")), ["u", "v"])
    return Graph(now.where("kind = 'v'").select("u", F.col("w").alias("vw")), both.select("u", "v", F.least("w", "other").alias("w")))


def follow(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends what each batch of edits changes to a Parquet folder `log`. A batch that is replayed appends the same rows again, which `latest`
    doesn't mind. State is kept in RocksDB, which is set for this session."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(log)

    return changes(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
