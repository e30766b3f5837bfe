"""Graphs that change: a log of edits is folded to a snapshot, placements follow with little migration.

Edits are rows (seq, op, u, v, w); seq orders them and repeats are dropped. Rules:

* `+v u [w=1]` adds to a vertex's weight, `vw u w` sets it, `-v u` removes the vertex with its edges;
* `+e u v [w=1]` adds to an edge's weight, `ew u v w` sets it, both create missing ends with weight 1; `-e u v` removes an edge, `-e u v w`
  takes w off, and the edge goes when nothing is left; loops are ignored;
* a vertex exists if its weight isn't 0, an edge if its weight is above 0.

The fold needs no loop over the log. What stands before the last reset (set, remove) of a key doesn't matter; after it, weights are
sums, and taking off with a floor of 0 is the running sum less its smallest value below 0.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.functions.profiler import Profiler
from meshwork.functions.scalars import lmax as limit
from meshwork.kernels.assignment import assign as assignment
from meshwork.operators import gains, metrics, refine
from meshwork.operators.rounds import Rounds
from meshwork.sources.files import parse_commands, write_metis, write_partition
from meshwork.sources.graph import Graph, both_ways

if TYPE_CHECKING:
    from meshwork.plans.solver import Profile

EVENTS = "seq long, op string, u long, v long, w long"


def vertex_weights(events: DataFrame) -> DataFrame:
    """(u, vw) of the vertices that exist after all events."""
    e = events.where("u is not null")
    own = e.where(F.col("op").isin("+v", "vw", "-v")).select("seq", "u", F.col("op").alias("kind"), F.when(F.col("op") == "-v", 0).otherwise(F.coalesce("w", F.lit(1))).alias("w"))
    made = e.where(F.col("op").isin("+e", "ew") & (F.col("u") != F.col("v"))).select("seq", F.explode(F.array("u", "v")).alias("u"), F.lit("ensure").alias("kind"), F.lit(0).alias("w"))
    both = own.unionByName(made)
    reset = F.col("kind").isin("vw", "-v")
    last = both.where(reset).groupBy("u").agg(F.max("seq").alias("reset"), F.max_by("w", "seq").alias("base"))
    after = both.join(last, "u", "left").where(F.col("reset").isNull() | (F.col("seq") > F.col("reset")))
    sums = after.groupBy("u").agg(F.sum(F.when(F.col("kind") == "+v", F.col("w")).otherwise(0)).alias("added"), F.min_by("kind", "seq").alias("first"))
    every = both.select("u").distinct().join(last, "u", "left").join(sums, "u", "left")
    base = F.coalesce("base", F.lit(0))
    out = base + F.coalesce("added", F.lit(0)) + F.when((base == 0) & (F.col("first") == "ensure"), 1).otherwise(0)
    return every.select("u", out.cast("long").alias("vw")).where("vw <> 0")


def edge_weights(events: DataFrame) -> DataFrame:
    """(u, v, w), u < v, of the edges that exist after all events."""
    own = events.where(F.col("op").isin("+e", "ew", "-e") & (F.col("u") != F.col("v"))).select("seq", "op", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    gone = events.where("op = '-v'").groupBy("u").agg(F.max("seq").alias("gone"))
    reset = (F.col("op") == "ew") | ((F.col("op") == "-e") & F.col("w").isNull())
    keys = own.groupBy("u", "v").agg(F.max(F.when(reset, F.col("seq"))).alias("set_at"), F.max_by(F.when(F.col("op") == "ew", F.col("w")).otherwise(0), F.when(reset, F.col("seq"))).alias("set_to"))
    keys = keys.join(gone, "u", "left").withColumnRenamed("gone", "gone_u").join(gone.select(F.col("u").alias("v"), F.col("gone").alias("gone_v")), "v", "left")
    cleared = F.greatest("gone_u", "gone_v")
    keys = keys.select("u", "v", F.greatest("set_at", cleared).alias("reset"), F.when(cleared.isNull() | (F.col("set_at") > cleared), F.coalesce("set_to", F.lit(0))).otherwise(0).alias("base"))
    after = own.join(keys, ["u", "v"]).where(F.col("reset").isNull() | (F.col("seq") > F.col("reset")))
    step = F.when(F.col("op") == "+e", F.coalesce("w", F.lit(1))).otherwise(-F.col("w"))
    run = F.sum(step).over(Window.partitionBy("u", "v").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    sums = after.withColumns({"step": step, "run": F.col("base") + run}).groupBy("u", "v").agg(F.sum("step").alias("all"), F.min("run").alias("low"))
    met = keys.join(sums, ["u", "v"], "left")
    out = F.greatest("base", F.lit(0)) + F.coalesce("all", F.lit(0)) - F.least(F.coalesce("low", F.lit(0)), F.lit(0))
    return met.select("u", "v", out.cast("long").alias("w")).where("w > 0")


def snapshot(events: DataFrame) -> Graph:
    one = edge_weights(events)
    return Graph(vertex_weights(events), one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))


def folded(graph: Graph, events: DataFrame, removed: bool = True) -> Graph:
    """The graph after more events: only the vertices and edges that they name are folded with them, the others stay as they are. `removed`: whether any vertex is removed."""
    before = lambda t, op: t.select(F.lit(-2).cast("long").alias("seq"), F.lit(op).alias("op"), "u", *([F.lit(None).cast("long").alias("v"), F.col("vw").alias("w")] if op == "vw" else ["v", "w"]))
    of_edges = events.where(F.col("op").isin("+e", "-e", "ew") & (F.col("u") != F.col("v")))
    keys = both_ways(of_edges.select("u", "v", F.lit(None).alias("w"))).select("u", "v").distinct()
    named = events.select("u").unionByName(of_edges.select(F.col("v").alias("u"))).distinct()
    vertices = vertex_weights(before(graph.vertices.join(named, "u", "left_semi"), "vw").unionByName(events))
    one = edge_weights(before(graph.edges.where("u < v").join(keys, ["u", "v"], "left_semi"), "ew").unionByName(events))
    rest = graph.edges.join(keys, ["u", "v"], "left_anti")
    if removed:
        gone = events.where("op = '-v'").select("u").distinct()
        rest = rest.join(gone, "u", "left_anti").join(gone.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v", "w")
    return Graph(graph.vertices.join(named, "u", "left_anti").unionByName(vertices), rest.unionByName(both_ways(one)))


def dirty(events: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(u): vertices touched by the events: those that an edit names, and for a removed vertex the neighbours it has in `edges` or gets from the log."""
    named = events.where(F.col("op").isin("+v", "vw")).select("u").unionByName(events.where(F.col("op").isin("+e", "-e", "ew")).select(F.explode(F.array("u", "v")).alias("u")))
    removed = events.where("op = '-v'").select("u", "seq")
    log = events.where(F.col("op").isin("+e", "ew")).select("u", "v", "seq").unionByName(events.where(F.col("op").isin("+e", "ew")).select(F.col("v").alias("u"), F.col("u").alias("v"), "seq"))
    near = log.join(removed.withColumnRenamed("seq", "at"), "u").where("seq < at").select(F.col("v").alias("u"))
    if edges is not None:
        near = near.unionByName(edges.join(removed.select("u"), "u", "left_semi").select(F.col("v").alias("u")))
    return named.unionByName(near).distinct()


def place_new(graph: Graph, assign: DataFrame, m: Machine, most: int) -> DataFrame:
    """Block 0 or a neighbour's block for each vertex without one, whichever costs least (smaller id on ties) and has room; the rest, and those without
    placed neighbours, go where there is room."""
    new = graph.vertices.join(assign, "u", "left_anti")
    conn = graph.edges.join(new.select("u"), "u", "left_semi").join(assign.select(F.col("u").alias("v"), "pid"), "v").groupBy("u", F.col("pid").alias("id")).agg(F.sum("w").alias("w"))
    options = conn.select("u", F.col("id").alias("new_id")).unionByName(new.select("u", F.lit(0).cast("long").alias("new_id"))).distinct()
    met = options.join(conn, "u", "left").groupBy("u", "new_id").agg((-F.coalesce(F.sum(F.col("w") * m.distance(F.col("new_id"), F.col("id"))), F.lit(0))).alias("gain"))
    blocks = metrics.block_weights(graph.vertices, assign, m.k).withColumn("lmax", F.lit(most).cast("long"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("gain"), "new_id"))).where("r = 1").drop("r")
    fits = gains.admitted(best, new, blocks)
    placed = assign.join(graph.vertices.select("u"), "u", "left_semi").unionByName(fits.select("u", F.col("new_id").alias("pid")))
    # the rest is dealt to the blocks by a hash; rebalancing mends what does not fit
    rest = graph.vertices.select("u").join(placed, "u", "left_anti").select("u", F.pmod(F.xxhash64("u"), F.lit(m.k)).alias("pid"))
    return placed.unionByName(rest)


def overlap(vertices: DataFrame, old: DataFrame, new: DataFrame, below: int, size: int) -> DataFrame:
    """(parent_old, parent_new, digit_old, digit_new, w): the weight that blocks of a level share."""
    met = old.select("u", F.col("pid").alias("a")).join(new.select("u", F.col("pid").alias("b")), "u").join(vertices, "u")
    part = lambda c, n: F.floor(F.col(c) / n).cast("long")
    return met.groupBy(part("a", below * size).alias("parent_old"), part("b", below * size).alias("parent_new"), (part("a", below) % size).alias("digit_old"), (part("b", below) % size).alias("digit_new")).agg(F.sum("vw").alias("w"))


def align(vertices: DataFrame, old: DataFrame, new: DataFrame, m: Machine) -> DataFrame:
    """Renames the new blocks inside their parents, outermost level first, so that most weight stays where it was. The cost of
    the mapping doesn't change; vertices without an old block don't count. The driver sees a matrix of a_i x a_i for each parent."""
    spark = vertices.sparkSession
    rename: dict[int, int] = {0: 0}  # a new parent's id -> the old parent's it is matched with
    for level in range(len(m.sizes) - 1, -1, -1):
        size, below = m.sizes[level], m.strides[level - 1] if level else 1
        table: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
        for r in overlap(vertices, old, new, below, size).collect():
            table.setdefault((r["parent_old"], r["parent_new"]), {})[(r["digit_old"], r["digit_new"])] = r["w"]
        nxt: dict[int, int] = {}
        for parent_new, parent_old in rename.items():
            w = table.get((parent_old, parent_new), {})
            top = max(w.values(), default=0)
            to = assignment([[top - w.get((a, b), 0) for a in range(size)] for b in range(size)])
            for b, a in enumerate(to):
                nxt[parent_new * size + b] = parent_old * size + a
        rename = nxt
    names = spark.createDataFrame(list(rename.items()), "pid long, to long")
    return new.join(F.broadcast(names), "pid").select("u", F.col("to").alias("pid"))


class Session:
    """A placement that follows a log of commands."""

    def __init__(self, spark: SparkSession, machine: Machine, eps: float = 0.03, profile: str | Profile = "fast", seed: int = 0):
        self.spark, self.m, self.eps, self.profile, self.seed = spark, machine, eps, profile, seed
        self.state, self.profiler = Rounds(spark), Profiler()
        self.graph = Graph(spark.createDataFrame([], "u long, vw long"), spark.createDataFrame([], "u long, v long, w long"))
        self.assign: DataFrame | None = None
        #: Vertices touched since the last refinement or partition, and since the last partition (which `autorefine` goes by).
        self.touched = spark.createDataFrame([], "u long")
        self.unsettled = spark.createDataFrame([], "u long")
        self.last, self.migrated, self.times, self.rejected, self.choices = -1, 0, [], [], []

    # edits -------------------------------------------------------------------------------------------------------

    def apply(self, events: DataFrame, replays: bool = True) -> None:
        """Folds a batch of edits into the snapshot; rows of seq seen before are dropped, unless the caller knows that there are none (`replays`)."""
        new = (events.where(F.col("seq") > self.last) if replays else events).dropDuplicates(["seq"])
        new = self.state.keep(new.select("seq", "op", "u", "v", "w"))
        top = new.agg(F.max("seq")).first()[0]
        if top is None:
            return
        removed = bool(new.where("op = '-v'").head(1))
        marked = self.state.keep(dirty(new, self.graph.edges if removed else None))
        self.touched = self.state.keep(self.touched.unionByName(marked).distinct())
        self.unsettled = self.state.keep(self.unsettled.unionByName(marked).distinct())
        now = folded(self.graph, new, removed)
        self.graph = Graph(self.state.keep(now.vertices), self.state.keep(now.edges), True)
        self.last = max(self.last, top)

    @property
    def limit(self) -> int:
        return limit(self.graph.vertices.agg(F.coalesce(F.sum("vw"), F.lit(0))).first()[0], self.m.k, self.eps)

    # placements --------------------------------------------------------------------------------------------------

    def partition(self, profile: str | Profile | None = None) -> None:
        """Solves anew and renames the blocks towards the placement before."""
        from meshwork.plans.solver import solve

        with self.profiler.scope("solve"):
            new = self.state.keep(solve(self.graph, self.m, self.eps, profile or self.profile, self.seed))
        if self.assign is not None:
            with self.profiler.scope("align"):
                new = self.state.keep(align(self.graph.vertices, self.assign, new, self.m))
        self._accept(new)
        self.unsettled = self.spark.createDataFrame([], "u long")

    def refine_fast(self, rounds: int = 5, only_touched: bool = False) -> None:
        """Places new vertices, then refines by label propagation: all vertices may move, or only those that were touched and their neighbours."""
        most = self.limit
        now = self.assign if self.assign is not None else self.spark.createDataFrame([], "u long, pid long")
        now = self.state.keep(place_new(self.graph, now, self.m, most))
        now = refine.rebalance(self.graph, now, self.m, most)
        may = None
        if only_touched:
            near = self.graph.edges.join(self.touched, "u", "left_semi").select(F.col("v").alias("u"))
            may = self.state.keep(self.touched.unionByName(near).distinct())
        self._accept(refine.label_propagation(self.graph, now, self.m, most, rounds, self.seed, may))

    def unsettled_share(self) -> float:
        """Vertices touched since the last partition, in percent of all."""
        n = self.graph.vertices.count()
        return 100.0 * self.unsettled.count() / n if n else 0.0

    def autorefine(self, percent: float = 10.0, profile: str | Profile = "fast") -> str:
        """A full partition if at least `percent` of the vertices were touched since the last one, else a refinement."""
        if self.assign is None or self.unsettled_share() >= percent:
            self.partition(profile)
            return "partition"
        self.refine_fast({"eco": 10, "strong": 20}.get(profile, 5))
        return "refine"

    def _accept(self, new: DataFrame) -> None:
        new = self.state.keep(new)
        if self.assign is not None:
            self.migrated += metrics.migration(self.graph.vertices, self.assign, new, self.m).first()["migration_cost"]
        self.assign = new
        self.touched = self.spark.createDataFrame([], "u long")

    def set_machine(self, m: Machine) -> None:
        self.m, self.assign = m, None

    def stats(self) -> DataFrame:
        now = self.assign if self.assign is not None else self.graph.vertices.select("u", F.lit(0).cast("long").alias("pid"))
        out = metrics.solution_report(self.graph.vertices, self.graph.edges, now, self.m, self.eps)
        return out.withColumn("migration_cost", F.lit(self.migrated).cast("long"))

    def timings(self) -> DataFrame:
        return metrics.command_stats(self.spark.createDataFrame(self.times, "cmd string, seconds double"))

    # commands ----------------------------------------------------------------------------------------------------

    def run(self, commands: DataFrame) -> None:
        """Runs parsed commands (`parse_commands`) in order. Edits between two other commands are folded as one batch on the cluster; only the
        other commands, and what was rejected, come to the driver."""
        base = self.last + 1
        commands = self.state.keep(commands.withColumn("seq", F.col("seq") + base))
        edit = F.col("op").isin("+v", "+e", "-v", "-e", "vw", "ew") & ~F.col("rejected")
        self.rejected += [r["seq"] - base for r in commands.where("rejected").select("seq").orderBy("seq").collect()]
        others = commands.where(~edit & ~F.col("rejected")).orderBy("seq").collect()
        at = base - 1
        for r in [*others, None]:
            span = commands.where(edit & (F.col("seq") > at))
            # commands of a run are no replays, even if an `exec` among them has used numbers beyond theirs
            self.apply(span if r is None else span.where(F.col("seq") < r["seq"]), replays=False)
            if r is None or r["op"] == "quit":
                break
            start = time.time()
            with self.profiler.scope(r["op"]):
                self._do(r["op"], list(r["args"]))
            self.times.append((r["op"], time.time() - start))
            at = r["seq"]
        top = commands.agg(F.max("seq")).first()[0]
        self.last = max(self.last, top if top is not None else self.last)

    def listen(self, lines: Iterable[str], say: Callable[[str], None] = print) -> None:
        """Runs commands line by line as they come, say from standard input, until `quit`. Edits are folded together when another command comes, or at the end."""
        from meshwork.sources.files import COMMANDS, command_list

        held: list[str] = []
        for line in lines:
            held.append(line)
            word = (line.split() or ["#"])[0]
            if word.startswith("#") or word in ("+v", "+e", "-v", "-e", "vw", "ew") or word not in COMMANDS:
                continue
            Session.run(self, command_list(self.spark, held))
            held = []
            say(word)
            if word == "quit":
                return
        if held:
            Session.run(self, command_list(self.spark, held))

    def _do(self, op: str, args: list[str]) -> None:
        if op == "partition":
            self.partition(args[0] if args else None)
        elif op == "refine-fast":
            self.refine_fast(int(args[0]) if args else 5)
        elif op == "autorefine":
            self.choices.append(self.autorefine(float(args[0]) if args else 10.0, args[1] if len(args) > 1 else "fast"))
        elif op == "set-hierarchy":
            self.set_machine(Machine.parse(args[0], args[1]))
        elif op == "save-partition":
            write_partition(self.assign, args[0])
        elif op == "save-graph":
            write_metis(self.graph, args[0], weights=False)
        elif op == "exec":
            from meshwork.sources.files import read_commands

            Session.run(self, read_commands(self.spark, args[0]))
        elif op == "stats":
            self.report = self.stats().first().asDict()

    # streams -----------------------------------------------------------------------------------------------------

    def follow(self, stream: DataFrame, after: Callable[[Session], None] | None = None, checkpoint: str | None = None, available_now: bool = True):
        """Starts a streaming query that folds each micro-batch of edits (seq, op, u, v, w) into the snapshot, by seq within the batch; `after`
        runs then, say to refine. Edits carry no event time, so there is no watermark; a batch that is replayed is dropped by seq."""

        def batch(df: DataFrame, _: int) -> None:
            self.apply(df)
            if after:
                after(self)

        writer = stream.writeStream.foreachBatch(batch)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Edits from CSV files (seq,op,u,v,w) that arrive in a folder."""
    return spark.readStream.schema(EVENTS).csv(path)


__all__ = ["EVENTS", "Session", "align", "dirty", "edge_weights", "overlap", "parse_commands", "place_new", "read_event_stream", "snapshot", "vertex_weights"]
