"""Corridors of pairs of blocks, and which pairs may be refined at once.

A corridor is what a kernel gets of a pair of blocks instead of the blocks: on each side the vertices nearest to the border, as many as the other side could take
`alpha` times over. It is grown by a search from all borders of all pairs at once, and cut by running weights over ranges of (hop, id), so no task sees a whole side.
The search runs in chunks, ranges of ids: in a round a task carries it on inside its chunk as far as it leads, and what leaves the chunk is sent to the next round. So a round
is a hop at least, and many where neighbours have like ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.operators.rounds import Rounds, few
from meshwork.sources.graph import Graph

#: The room of a side is reckoned as if the other were this share of the limit below it at least, so that full blocks have a corridor too. Fixed value.
LEAST_ROOM = 1 / 32
SIDE = ["a", "b", "side"]
#: Vertices of a chunk of the search. Fixed value.
CHUNK = 20_000


def colour(a: Column, b: Column, k: int) -> Column:
    """A static colouring of the pairs a < b of k blocks in which pairs of one colour share no block: the rounds of a tournament, k of them (k - 1 if k is even)."""
    if k % 2:
        return F.pmod(a + b, F.lit(k))
    odd = max(1, k - 1)
    return F.when(b == k - 1, F.pmod(2 * a, F.lit(odd))).otherwise(F.pmod(a + b, F.lit(odd)))


def rooms(blocks: DataFrame, pairs: DataFrame, alpha: float) -> DataFrame:
    """(a, b, side, own, other, room) of both sides of each pair; own: the side's block, other: the block across. blocks: (pid, bweight, lmax)."""
    room = lambda p: F.floor(alpha * F.greatest(F.col("lmax") - F.col("bweight"), F.floor(F.col("lmax") * LEAST_ROOM))).cast("long").alias("room")
    out = None
    for side, own, other in ((0, "a", "b"), (1, "b", "a")):
        met = pairs.select("a", "b").join(blocks.select(F.col("pid").alias(other), room(other)), other)
        rows = met.select("a", "b", F.lit(side).alias("side"), F.col(own).alias("own"), F.col(other).alias("other"), "room")
        out = rows if out is None else out.unionByName(rows)
    return out


def cuts_of(vertices: DataFrame) -> list[int]:
    """Where the id ranges of about CHUNK vertices begin, but for the first."""
    n = -(-vertices.count() // CHUNK)
    return sorted({int(x) for x in vertices.approxQuantile("u", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []


def _chunk_of(cuts: list[int]):
    at = np.asarray(cuts, np.int64)

    @F.pandas_udf("int")
    def run(u: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, u, side="right").astype(np.int32))

    return run(F.col("u")) if cuts else F.lit(0)


FOUND = "chunk int, a long, b long, side int, u long, vw long, hop long, room long, sent boolean"


def _grow(cuts: list[int], most_hops: int):
    """Carries what was sent to a chunk on inside it, side by side, as far as it leads; what leaves the chunk is sent to others. A label is the hop of some way, so the least one
    is right as soon as nothing is sent any more. What lies behind a hop by which the chunk alone fills the room is left."""
    at, far = np.asarray(cuts, np.int64), most_hops + 1

    def run(key, found: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        arcs = arcs.sort_values("u", kind="stable")
        tail, head = arcs["u"].to_numpy(np.int64), arcs["v"].to_numpy(np.int64)
        ids = np.union1d(tail, found["u"].to_numpy(np.int64))
        begin, end = np.searchsorted(tail, ids), np.searchsorted(tail, ids, side="right")
        vw = np.zeros(len(ids), np.int64)
        np.maximum.at(vw, np.searchsorted(ids, found["u"]), found["vw"].to_numpy(np.int64))
        vw[np.searchsorted(ids, tail)] = arcs["vw"].to_numpy(np.int64)
        to = np.minimum(np.searchsorted(ids, head), len(ids) - 1)
        inside = ids[to] == head
        out = []
        for side, rows in found.groupby(SIDE):
            place, hops, sent = np.searchsorted(ids, rows["u"]), rows["hop"].to_numpy(np.int64), rows["sent"].to_numpy(bool)
            room, leaving = int(rows["room"].iloc[0]), []
            hop = np.full(len(ids), far)
            np.minimum.at(hop, place[~sent], hops[~sent])
            before = hop.copy()
            np.minimum.at(hop, place[sent], hops[sent])
            open_ = hop < before
            for h in range(int(hop.min()), most_hops):
                if vw[hop <= h].sum() >= room:
                    break
                now = np.flatnonzero(open_ & (hop == h))
                many = end[now] - begin[now]
                arc = np.repeat(begin[now] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                own = to[arc[inside[arc]]]
                own = own[hop[own] > h + 1]
                hop[own], open_[own] = h + 1, True
                leaving.append((h + 1, np.unique(head[arc[~inside[arc]]])))
            got = np.flatnonzero(hop < far)
            frame = pd.DataFrame({"chunk": int(key[0]), "u": ids[got], "vw": vw[got], "hop": hop[got], "sent": False})
            away = [pd.DataFrame({"chunk": np.searchsorted(at, v, side="right"), "u": v, "vw": 0, "hop": h, "sent": True}) for h, v in leaving if len(v)]
            if away:
                frame = pd.concat([frame, pd.concat(away).drop_duplicates("u")])
            out.append(frame.assign(a=side[0], b=side[1], side=side[2], room=room))
        return pd.concat(out)[[c.split()[0] for c in FOUND.split(", ")]] if out else pd.DataFrame(columns=[c.split()[0] for c in FOUND.split(", ")])

    return run


def arcs_of(graph: Graph, cuts: list[int]) -> DataFrame:
    """(u, v, w, vw, chunk): the edges with weight and chunk of their first end."""
    return graph.edges.join(graph.vertices.withColumn("chunk", _chunk_of(cuts)), "u").select("u", "v", "w", "vw", "chunk")


def placed_arcs(arcs: DataFrame, assign: DataFrame) -> DataFrame:
    """(u, v, w, vw, chunk, pu, pv): `arcs_of` with the blocks of both ends."""
    return arcs.join(assign.select("u", F.col("pid").alias("pu")), "u").join(assign.select(F.col("u").alias("v"), F.col("pid").alias("pv")), "v").select("u", "v", "w", "vw", "chunk", "pu", "pv")


def moved_arcs(ea: DataFrame, moves: DataFrame) -> DataFrame:
    """`placed_arcs` after the moves (u, new_id); where these are few, no arc is shuffled."""
    nu, nv = few(moves, "u", F.col("new_id").alias("nu")), few(moves, F.col("u").alias("v"), F.col("new_id").alias("nv"))
    return ea.join(nu, "u", "left").join(nv, "v", "left").select("u", "v", "w", "vw", "chunk", F.coalesce("nu", "pu").alias("pu"), F.coalesce("nv", "pv").alias("pv"))


def corridors(graph: Graph, assign: DataFrame, pairs: DataFrame, blocks: DataFrame, alpha: float, most_hops: int = 64, cuts: list[int] | None = None, ea: DataFrame | None = None) -> DataFrame:
    """(a, b, side, u, vw, hop): of each side of the pairs (a, b) the vertices by hops from the border, then by id, while their weight is within the side's room.
    A vertex may be in corridors of several pairs. Vertices that no border is connected to inside their block are in none. cuts: `cuts_of(graph.vertices)`, ea: the
    written `placed_arcs`, if known."""
    state = Rounds(graph.edges.sparkSession)
    if ea is None:
        cuts = cuts_of(graph.vertices) if cuts is None else cuts
        ea = state.keep(placed_arcs(arcs_of(graph, cuts), assign))
    limits = F.broadcast(rooms(blocks, pairs, alpha))
    border = ea.where("pu <> pv").select("chunk", "u", "vw", F.col("pu").alias("own"), F.col("pv").alias("other")).join(limits, ["own", "other"])
    names = [c.split()[0] for c in FOUND.split(", ")]
    found = border.withColumns({"hop": F.lit(0).cast("long"), "sent": F.lit(True)}).select(*names).distinct()
    arcs = ea.where("pu = pv").select(*[(F.col(c) + 0).alias(c) for c in ("chunk", "u", "vw", "v")])  # columns of its own for the cogroup
    active = [r["chunk"] for r in border.select("chunk").distinct().collect()]  # a row for each chunk at most
    while active:
        here = F.col("chunk").isin(active)
        grown = found.where(here).groupBy("chunk").cogroup(arcs.where(here).groupBy("chunk")).applyInPandas(_grow(cuts, most_hops), FOUND)
        found = state.keep(grown.unionByName(found.where(~here)))
        if not found.where("sent").head(1):
            break
        # a side that weighs as much as its room is done: all that is further comes behind what it has
        sums = found.where("not sent").groupBy(*SIDE, "hop").agg(F.sum("vw").alias("vw"), F.max("room").alias("room"))
        upto = sums.withColumn("upto", F.sum("vw").over(Window.partitionBy(*SIDE).orderBy("hop")))
        last = F.broadcast(upto.where("upto >= room").groupBy(*SIDE).agg(F.min("hop").alias("last")))
        near = found.where("sent").join(last, SIDE, "left").where("last is null or hop <= last")
        active = [r["chunk"] for r in near.select("chunk").distinct().collect()]
    return state.keep(nearest(found.where("not sent")).select(*SIDE, "u", "vw", "hop"))


def nearest(found: DataFrame) -> DataFrame:
    """Of each side what lies within its room by hop, then id. Chunks are ranges of ids, so weights run over the chunks of a hop, then inside one: a task sees a row for each
    hop and chunk of a side, or what a chunk has of a hop."""
    by_chunk = found.groupBy(*SIDE, "hop", "chunk").agg(F.sum("vw").alias("sum"), F.max("room").alias("most"))
    line = Window.partitionBy(*SIDE).orderBy("hop", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    nearer = Window.partitionBy(*SIDE).orderBy("hop").rangeBetween(Window.unboundedPreceding, -1)
    starts = by_chunk.withColumns({"start": F.coalesce(F.sum("sum").over(line), F.lit(0)), "nearer": F.sum("sum").over(nearer)})
    starts = starts.where("start <= most and (nearer is null or nearer < most)").select(*SIDE, "hop", "chunk", "start")
    inside = Window.partitionBy(*SIDE, "hop", "chunk").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    return found.join(starts, [*SIDE, "hop", "chunk"]).withColumn("upto", F.col("start") + F.sum("vw").over(inside)).where("upto <= room")


def pair_frames(ea: DataFrame, members: DataFrame, blocks: DataFrame, m: Machine) -> tuple[DataFrame, DataFrame]:
    """What the kernels of pairs get: (a, b, u, vw, side, pay0, pay1, base0, base1), the corridors, and (a, b, u, v, w), the edges inside them. pay: what a vertex pays on
    either side for its neighbours outside the corridor, base: what the blocks weigh without it. ea: `placed_arcs`."""
    own = members.select("a", "b", "u", "side", "vw")
    there = own.select("a", "b", F.col("u").alias("v"), F.lit(True).alias("inside"))
    met = ea.select("u", "v", "w", "pv").join(own.select("a", "b", "u"), "u").join(there, ["a", "b", "v"], "left")
    inner = met.where("inside").select((F.col("a") + 0).alias("a"), (F.col("b") + 0).alias("b"), "u", "v", "w")  # columns of its own for the cogroup
    outer = met.where("inside is null")
    pays = outer.groupBy("a", "b", "u").agg(F.sum(F.col("w") * m.distance(F.col("a"), F.col("pv"))).alias("pay0"), F.sum(F.col("w") * m.distance(F.col("b"), F.col("pv"))).alias("pay1"))
    taken = own.groupBy("a", "b").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("vw"))), F.lit(0)).alias(f"in{s}") for s in (0, 1)])
    base = taken.join(blocks.select(F.col("pid").alias("a"), F.col("bweight").alias("wa")), "a").join(blocks.select(F.col("pid").alias("b"), F.col("bweight").alias("wb")), "b")
    base = base.select("a", "b", (F.col("wa") - F.col("in0")).alias("base0"), (F.col("wb") - F.col("in1")).alias("base1"))
    vertices = own.join(pays, ["a", "b", "u"], "left").fillna(0, ["pay0", "pay1"]).join(F.broadcast(base), ["a", "b"])
    return vertices, inner
