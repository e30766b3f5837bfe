"""Bisections of many small graphs (items) at once: seeds, a table of jobs, bounds that make jobs needless, and the jobs as tasks of their own.

A job is a pair of seeds of an item. It costs a flow to learn the smallest cut between two seeds, and many to widen that to a balanced one, so jobs are told apart by
bounds first. All items go through the same four passes; a group holds one item, so items must be of bounded size, as coarsest graphs and their parts are.
"""

from __future__ import annotations

import copy
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.kernels import split
from meshwork.kernels.local import Local, rng_of
from meshwork.operators.rounds import Rounds
from meshwork.sources.graph import Graph

#: Widths of the corridors in which the best cut of an item is replaced, as multiples of the room across. Fixed values.
CORRIDORS = (0.2, 0.5, 1.0, 2.0, 4.0)
#: From so many items on, the jobs of an item share a group, as the items are tasks enough. Fixed value.
TOGETHER = 64
#: No cut yet.
NONE = 1 << 60


def _local(vs: pd.DataFrame, es: pd.DataFrame) -> Local:
    vs = vs.sort_values("u")
    return Local(vs["u"], vs["vw"], es[["u", "v", "w"]].itertuples(index=False, name=None))


def seeds(vertices: DataFrame, edges: DataFrame, n: int = 4, pool: int = 1, salt: int | None = None) -> DataFrame:
    """(item, place, u, hops): up to n seeds of each item, and the hops from each to those before it (-1: not reached).

    The first is a vertex far from a start (the smallest id, or a random one with a salt), each next one is far from all before it: one of the `pool` farthest, the farthest
    if that is 1. What isn't reached counts as farthest; ties go to the smaller id.
    """

    def pick(key, vs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        if not len(vs):
            return pd.DataFrame({"item": [], "place": [], "u": [], "hops": []})
        g = _local(vs, es)
        rng = rng_of(salt or 0, int(key[0]) % 2**63)
        far = [len(g) if d < 0 else d for d in g.hops([0 if salt is None else int(rng.integers(len(g)))])]
        taken: list[int] = []
        rows: list[list[int]] = []
        while len(taken) < min(n, len(g)):
            top = sorted((i for i in range(len(g)) if i not in taken), key=lambda i: (-far[i], i))[:pool]
            u = top[int(rng.integers(len(top)))] if len(top) > 1 else top[0]
            d = g.hops([u])
            rows.append([d[x] for x in taken])
            away = [len(g) if x < 0 else x for x in d]
            far = [min(x, y) for x, y in zip(far, away, strict=True)] if taken else away
            taken.append(u)
        return pd.DataFrame({"item": int(key[0]), "place": range(len(taken)), "u": [g.ids[i] for i in taken], "hops": rows})

    return vertices.groupBy("item").cogroup(edges.groupBy("item")).applyInPandas(pick, "item long, place int, u long, hops array<int>")


def pairs(found: DataFrame, fraction: float = 1.0) -> DataFrame:
    """(item, i, j, a, b, hops, kept): all pairs of an item's seeds. Pairs with the first seed are kept, and of the others the `fraction` that lies farthest apart, with ties."""
    x, y = found.alias("x"), found.alias("y")
    far = F.element_at("y.hops", F.col("x.place") + 1)
    out = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.place") < F.col("y.place"))).select(
        "x.item", F.col("x.place").alias("i"), F.col("y.place").alias("j"), F.col("x.u").alias("a"), F.col("y.u").alias("b"), far.alias("hops"))
    away = F.when(F.col("hops") < 0, F.lit(2**31 - 1)).otherwise(F.col("hops"))
    others = Window.partitionBy("item", F.col("i") > 0)
    most = F.greatest(F.lit(1), F.ceil(F.count("*").over(others) * F.lit(float(fraction))))
    return out.withColumn("kept", (F.col("i") == 0) | (F.rank().over(others.orderBy(away.desc())) <= most))


def transitive(known: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds `bound` to the asked pairs (item, i, j, ..): the smallest cut between two vertices is no smaller than the smaller one of their cuts from any third. known:
    (item, i, j, lam), smallest cuts between single vertices. (The rule doesn't hold between grown terminals, which a cut may split.)"""
    both = known.select("item", "i", "j", "lam").unionByName(known.select("item", F.col("j").alias("i"), F.col("i").alias("j"), "lam"))
    left = both.select(F.col("item").alias("item"), F.col("i").alias("i"), F.col("j").alias("x"), F.col("lam").alias("l1"))
    right = both.select(F.col("item").alias("item"), F.col("i").alias("x"), F.col("j").alias("j"), F.col("lam").alias("l2"))
    via = left.join(right, ["item", "x"]).where("i < j").groupBy("item", "i", "j").agg(F.max(F.least("l1", "l2")).alias("bound"))
    return asked.join(via, ["item", "i", "j"], "left").withColumn("bound", F.coalesce("bound", F.lit(0)))


def _each(jobs: DataFrame, vertices: DataFrame, edges: DataFrame, run, schema: str, together: bool = False) -> DataFrame:
    """A group for each job, with its item's graph; with `together` a group for all jobs of an item."""
    vs = vertices.join(jobs, "item")
    if together:

        def every(key, vs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
            made = [run((key[0], i, j), vs[(vs["i"] == i) & (vs["j"] == j)], es) for i, j in sorted(set(zip(vs["i"], vs["j"], strict=True)))]
            return pd.concat([t for t in made if len(t)] or made[:1])

        return vs.groupBy("item").cogroup(edges.join(jobs.select("item").distinct(), "item", "left_semi").groupBy("item")).applyInPandas(every, schema)
    asked = jobs.select(F.col("item").alias("__item"), F.col("i").alias("__i"), F.col("j").alias("__j"))
    es = edges.join(asked, F.col("item") == F.col("__item"))
    return vs.groupBy("item", "i", "j").cogroup(es.groupBy("__item", "__i", "__j")).applyInPandas(run, schema)


def prepared(jobs: DataFrame, vertices: DataFrame, edges: DataFrame, ball: float = 0.0, together: bool = False) -> DataFrame:
    """(item, i, j, a, b, lam, lower): lam is the smallest cut between the two seeds, lower that between the balls of `ball` of the weight around them, which no cut
    of the job falls below. jobs: (item, i, j, a, b, best); flows end at `best`, as the job is needless then."""

    def run(key, vs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        g, top = _local(vs, es), vs.iloc[0]
        p = split.Piercing(g, g.index[int(top["a"])], g.index[int(top["b"])])
        limit = None if top["best"] >= NONE else int(top["best"])
        lam = lower = p.flow(limit)
        if ball > 0 and (limit is None or lam < limit):
            p.grow(int(ball * g.total))
            lower = p.flow(limit)
        return pd.DataFrame({"item": [int(key[0])], "i": [int(key[1])], "j": [int(key[2])], "a": [int(top["a"])], "b": [int(top["b"])], "lam": [lam], "lower": [lower]})

    return _each(jobs, vertices, edges, run, "item long, i int, j int, a long, b long, lam long, lower long", together)


def cuts(jobs: DataFrame, vertices: DataFrame, edges: DataFrame, ball: float = 0.0, together: bool = False) -> DataFrame:
    """(item, i, j, cut, first): what each job ends with, `first` being the ids of side 0; no row where it finds no balanced cut. jobs: (item, i, j, a, b, most0,
    most1). Where the sides differ, the mirrored job (seed b in side 0) goes on from the same solved network."""

    def run(key, vs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        g, top = _local(vs, es), vs.iloc[0]
        most = int(top["most0"]), int(top["most1"])
        low, high = g.total - most[1], most[0]
        p = split.Piercing(g, g.index[int(top["a"])], g.index[int(top["b"])])
        p.flow()
        if ball > 0:
            p.grow(min(int(ball * g.total), *most))
            p.flow()
        tries = [(p, low, high, False)] if most[0] == most[1] else [(copy.deepcopy(p), low, high, False), (p, g.total - high, g.total - low, True)]
        best = None
        for net, lo, hi, mirrored in tries:
            half = net.run(lo, hi)
            if half is not None:
                first = [g.ids[u] for u, x in enumerate(half) if x != mirrored]
                got = (g.cut(half), first)
                best = got if best is None else min(best, got)
        rows = [(int(key[0]), int(key[1]), int(key[2]), *best)] if best else []
        return pd.DataFrame(rows, columns=["item", "i", "j", "cut", "first"])

    return _each(jobs, vertices, edges, run, "item long, i int, j int, cut long, first array<long>", together)


def finished(vertices: DataFrame, edges: DataFrame, limits: DataFrame, best: DataFrame) -> DataFrame:
    """(item, u, side): each item's best cut after two-way search and minimum cuts of corridors of rising width. An item without one is grown."""

    def run(key, vs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        if not len(vs):
            return pd.DataFrame({"item": [], "u": [], "side": []})
        g, top = _local(vs, es), vs.iloc[0]
        most = int(top["most0"]), int(top["most1"])
        if top["first"] is None:
            side = split.bisect(g, most[0] / max(1, sum(most)), most, "ggg", 2)
        else:
            first = {int(u) for u in top["first"]}
            side = [0 if u in first else 1 for u in g.ids]
            split.refine_pair(g, side, most)
            for alpha in CORRIDORS:
                split.refine_flow(g, side, most, alpha=alpha)
        return pd.DataFrame({"item": int(key[0]), "u": g.ids, "side": side})

    given = vertices.join(limits, "item").join(best.select("item", "first"), "item", "left")
    return given.groupBy("item").cogroup(edges.groupBy("item")).applyInPandas(run, "item long, u long, side int")


def bisect(vertices: DataFrame, edges: DataFrame, limits: DataFrame, n_seeds: int = 4, pool: int = 1, fraction: float = 1.0, keep: float = 1.0, ball: float = 0.0, salt: int | None = None,
           state: Rounds | None = None, report: list | None = None) -> DataFrame:
    """(item, u, side): items (item, u, vw) with edges (item, u, v, w) in two sides of weights most0 and most1 at most (limits: item, most0, most1).

    First flows of the jobs with the first seed; the most promising of these is run, and its cut is the item's best so far. Of the other jobs those whose
    transitive bound reaches the best are dropped unsolved, the rest get their first flow. Of what is still below the best, the `keep` of all jobs with the smallest bounds is run. With
    keep and fraction 1 the cut is that of all pairs. `report` gets a table of (item, jobs, solved, ran).
    """
    state = state or Rounds(vertices.sparkSession)
    together = limits.limit(TOGETHER).count() == TOGETHER
    all_jobs = state.keep(pairs(seeds(vertices, edges, n_seeds, pool, salt), fraction).where("kept"))
    star = state.keep(prepared(all_jobs.where("i = 0").withColumn("best", F.lit(NONE)), vertices, edges, ball, together))
    place = F.row_number().over(Window.partitionBy("item").orderBy("lower", "i", "j"))
    lead = state.keep(cuts(star.withColumn("place", place).where("place = 1").join(limits, "item"), vertices, edges, ball, together))
    best = lead.select("item", F.col("cut").alias("best"))
    rest = transitive(star, all_jobs.where("i > 0")).join(best, "item", "left").withColumn("best", F.coalesce("best", F.lit(NONE)))
    solved = state.keep(prepared(rest.where("bound < best").drop("bound", "hops", "kept"), vertices, edges, ball, together))
    counts = all_jobs.groupBy("item").agg(F.count("*").alias("jobs"))
    asked = star.withColumn("place", place).where("place > 1").drop("place").unionByName(solved).join(best, "item", "left").where("best IS NULL OR lower < best")
    asked = asked.withColumn("place", place).join(counts, "item").where(F.col("place") < F.greatest(F.lit(1), F.ceil(F.col("jobs") * F.lit(float(keep)))))
    others = state.keep(cuts(asked.select("item", "i", "j", "a", "b").join(limits, "item"), vertices, edges, ball, together))
    winner = lead.unionByName(others).groupBy("item").agg(F.min(F.struct("cut", "i", "j", "first")).alias("x")).select("item", "x.*")
    if report is not None:
        n = lambda t, name: t.groupBy("item").agg(F.count("*").alias(name))
        tables = [counts, n(star.select("item").unionByName(solved.select("item")), "solved"), n(lead.select("item").unionByName(asked.select("item")), "ran")]
        report.append(reduce(lambda x, y: x.join(y, "item", "left"), tables).na.fill(0))
    return state.keep(finished(vertices, edges, limits, winner))


def multisection(graph: Graph, m: Machine, lmax: int, **options) -> DataFrame:
    """(u, pid): a graph of bounded size on a machine, outermost level first, each level by repeated bisections; all items of a step are bisected together."""
    state = Rounds(graph.edges.sparkSession)
    own = state.keep(graph.vertices.select("u", "vw", F.lit(0).cast("long").alias("item")))
    for level in range(len(m.sizes) - 1, -1, -1):
        stride = m.strides[level - 1] if level else 1
        ranges, count = {0: m.sizes[level]}, m.sizes[level]
        # places inside a level's range, and how many blocks each still has: the same for all items, so k of them at most
        while any(k > 1 for k in ranges.values()):
            inside = F.floor(F.col("item") / stride) % count
            parts = F.create_map(*[F.lit(x) for place, k in ranges.items() for x in (place, k)])
            now = own.withColumn("k", F.element_at(parts, inside.cast("int")))
            open_ = now.where("k > 1")
            a, b = open_.select("u", "item").alias("a"), open_.select(F.col("u").alias("v"), F.col("item").alias("other")).alias("b")
            edges = state.keep(graph.edges.join(a, "u").join(b, "v").where("item = other").select("item", "u", "v", "w"))
            half = F.floor(F.col("k") / 2)
            limits = state.keep(open_.groupBy("item").agg(F.first("k").alias("k")).select("item", (half * stride * lmax).cast("long").alias("most0"), ((F.col("k") - half) * stride * lmax).cast("long").alias("most1")))
            sides = bisect(state.keep(open_.select("item", "u", "vw")), edges, limits, state=state, **options)
            own = state.keep(now.join(sides.select("u", "side"), "u", "left").select("u", "vw", (F.col("item") + F.when(F.col("side") == 1, half * stride).otherwise(0)).cast("long").alias("item")))
            ranges = {p: k for place, n in ranges.items() for p, k in ([(place, n)] if n == 1 else [(place, n // 2), (place + n // 2, n - n // 2)])}
    return own.select("u", F.col("item").alias("pid"))
