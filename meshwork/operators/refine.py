"""Refinement and rebalancing in synchronous rounds, and kernels on scheduled pairs of blocks."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.kernels.local import Local
from meshwork.kernels.split import refine_flow, refine_pair
from meshwork.operators import corridors, gains, metrics
from meshwork.operators.rounds import Rounds, few
from meshwork.sources.graph import Graph


def cost(graph: Graph, assign: DataFrame, m: Machine) -> int:
    return metrics.qap(metrics.placed(graph.edges, assign), m).first()[0]


def blocks_of(graph: Graph, assign: DataFrame, k: int, lmax: int) -> DataFrame:
    return metrics.block_weights(graph.vertices, assign, k).withColumn("lmax", F.lit(lmax).cast("long"))


def label_propagation(graph: Graph, assign: DataFrame, m: Machine, lmax: int, rounds: int = 5, seed: int = 0, may: DataFrame | None = None) -> DataFrame:
    """Each round moves an independent set of boundary vertices (of those in `may`, if given) to their best blocks that have room. Gains then add up, so the
    cost falls by exactly twice their sum, and no block becomes overloaded."""
    state = Rounds(graph.edges.sparkSession)
    graph, assign = state.graph(graph), state.keep(assign)
    conn = metrics.block_conn(metrics.placed(graph.edges, assign))
    conn = state.keep(conn if may is None else conn.join(may, "u", "left_semi"))
    blocks = state.keep(blocks_of(graph, assign, m.k, lmax))
    for i in range(rounds):
        wanted = gains.best_block(conn, assign, m, blocks, graph.vertices, seed + i).where("gain > 0")
        moves = state.keep(gains.admitted(gains.independent(wanted, graph.edges, seed + i), graph.vertices, blocks))
        if not moves.head(1):
            break
        assign = state.keep(gains.apply_moves(assign, moves))
        if i + 1 == rounds:
            break
        now = gains.moved_conn(conn, graph.edges, moves)
        conn = state.keep(now if may is None else now.join(may, "u", "left_semi"))
        blocks = state.keep(gains.moved_weights(blocks, graph.vertices, moves))
    return assign


def rebalance_candidates(conn: DataFrame, assign: DataFrame, vertices: DataFrame, blocks: DataFrame, m: Machine) -> DataFrame:
    """(u, old_id, new_id, gain): for the vertices of overloaded blocks the best of their neighbour blocks with room."""
    over = blocks.where("bweight > lmax").select(F.col("pid"))
    inside = assign.join(F.broadcast(over), "pid", "left_semi")
    moves = gains.candidates(conn, inside)
    fits = moves.join(vertices, "u").join(F.broadcast(blocks.select(F.col("pid").alias("new_id"), "bweight", "lmax")), "new_id").where("bweight + vw <= lmax").select("u", "old_id", "new_id")
    first = Window.partitionBy("u").orderBy(F.desc("gain"), "new_id")
    return gains.gain(conn, fits, m).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def rebalance_step(candidates: DataFrame, vertices: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of each overloaded block the best candidates that cover its overload, as far as their targets have room."""
    over = blocks.select(F.col("pid").alias("old_id"), (F.col("bweight") - F.col("lmax")).alias("excess"))
    line = Window.partitionBy("old_id").orderBy(F.desc("gain"), "u").rowsBetween(Window.unboundedPreceding, -1)
    met = candidates.join(vertices, "u").join(F.broadcast(over), "old_id").withColumn("before", F.coalesce(F.sum("vw").over(line), F.lit(0)))
    chosen = met.where("before < excess").select("u", "old_id", "new_id", "gain")
    return gains.admitted(chosen, vertices, blocks)


def rebalance(graph: Graph, assign: DataFrame, m: Machine, lmax: int, rounds: int = 20) -> DataFrame:
    """Moves vertices out of overloaded blocks until none is left or nothing fits: to neighbour blocks, or to any block where no neighbour
    block has room. Of like targets a hash picks, so that a round fills many of them."""
    state = Rounds(graph.edges.sparkSession)
    graph, assign = state.graph(graph), state.keep(assign)
    blocks = state.keep(blocks_of(graph, assign, m.k, lmax))
    conn = None
    for i in range(rounds):
        if not blocks.where("bweight > lmax").head(1):
            break
        conn = state.keep(metrics.block_conn(metrics.placed(graph.edges, assign))) if conn is None else conn
        near = rebalance_candidates(conn, assign, graph.vertices, blocks, m)
        spare = [(r["pid"], r["room"]) for r in blocks.where("bweight < lmax").select("pid", (F.col("lmax") - F.col("bweight")).alias("room")).collect()]  # k rows at most
        heavy = assign.join(F.broadcast(blocks.where("bweight > lmax").select("pid")), "pid", "left_semi").join(graph.vertices, "u").join(near.select("u"), "u", "left_anti")
        rooms = F.array(*[F.struct(F.lit(p).cast("long").alias("pid"), F.lit(x).cast("long").alias("room")) for p, x in spare or [(0, -1)]])
        fits = heavy.withColumn("fits", F.filter(rooms, lambda b: b["room"] >= F.col("vw"))).where(F.size("fits") > 0)
        any_ = fits.select("u", F.col("pid").alias("old_id"), F.element_at("fits", (F.pmod(F.xxhash64(F.lit(i), "u"), F.size("fits")) + 1).cast("int"))["pid"].alias("new_id"))
        far = gains.gain(conn, any_, m)
        moves = state.keep(rebalance_step(near.unionByName(far.select(*near.columns)), graph.vertices, blocks))
        if not moves.head(1):
            break
        assign = state.keep(gains.apply_moves(assign, moves))
        conn = state.keep(gains.moved_conn(conn, graph.edges, moves))
        blocks = state.keep(gains.moved_weights(blocks, graph.vertices, moves))
    return assign


def fill_empty(graph: Graph, assign: DataFrame, m: Machine, lmax: int) -> DataFrame:
    """Gives each empty block the lightest-connected vertices of the heaviest blocks, one for each empty block."""
    blocks = blocks_of(graph, assign, m.k, lmax)
    empty = blocks.where("n_vertices = 0").withColumn("i", F.row_number().over(Window.orderBy("pid"))).select(F.col("pid").alias("new_id"), "i")
    rich = blocks.where("n_vertices > 1").select("pid", "bweight")
    own = assign.join(F.broadcast(rich), "pid").join(graph.vertices, "u").where("vw <= {}".format(int(lmax)))
    one = own.withColumn("r", F.row_number().over(Window.partitionBy("pid").orderBy("vw", "u"))).where("r = 1")
    one = one.withColumn("i", F.row_number().over(Window.orderBy(F.desc("bweight"), "pid"))).select("u", "i")
    return gains.apply_moves(assign, one.join(empty, "i").select("u", "new_id"))


def schedule(pairs: list[tuple[int, int, int]], active: set[int] | None = None) -> list[list[tuple[int, int]]]:
    """Batches of block-disjoint pairs from quotient rows (a, b, w), the heaviest first; all batches are kept, small ones too."""
    batches: list[tuple[set[int], list[tuple[int, int]]]] = []
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if active is not None and a not in active and b not in active:
            continue
        for used, batch in batches:
            if a not in used and b not in used:
                break
        else:
            used, batch = set(), []
            batches.append((used, batch))
        used |= {a, b}
        batch.append((a, b))
    return [b for _, b in batches]


def distance3_schedule(pairs: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Batches in which no two pairs are joined by a quotient edge either, so that moves in one never change gains in another."""
    near: dict[int, set[int]] = {}
    for a, b, _ in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    batches: list[tuple[set[int], list[tuple[int, int]]]] = []
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        around = near[a] | near[b] | {a, b}
        for used, batch in batches:
            if not used & around:
                break
        else:
            used, batch = set(), []
            batches.append((used, batch))
        used |= {a, b}
        batch.append((a, b))
    return [b for _, b in batches]


def cost_change(graph: Graph, assign: DataFrame, moves: DataFrame, m: Machine, ea: DataFrame | None = None) -> int:
    """What moves (u, new_id) change the cost by, from the edges of the vertices that move: each such edge counts in both directions. ea: the edges with the blocks of
    both ends, if written."""
    ea = metrics.placed(graph.edges.join(moves.select("u"), "u", "left_semi"), assign) if ea is None else ea
    hit = ea.join(few(moves, "u", "new_id"), "u").join(few(moves, F.col("u").alias("v"), F.col("new_id").alias("moved_v")), "v", "left")
    change = F.col("w") * (m.distance(F.col("new_id"), F.coalesce("moved_v", "pv")) - m.distance(F.col("pu"), F.col("pv")))
    # an edge between two vertices that move is met in both directions
    twice = F.when(F.col("moved_v").isNull(), 2).otherwise(1)
    return hit.agg(F.coalesce(F.sum(change * twice), F.lit(0)).cast("long")).first()[0]


def coloured(quotient: DataFrame, k: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The pairs of the quotient graph (at most k^2 / 2) by static colour, the colours with the most weight first; pairs of a colour share no block."""
    rows = quotient.select("a", "b", "w", corridors.colour(F.col("a"), F.col("b"), k).alias("colour")).collect()
    classes: dict[int, list] = {}
    for r in rows:
        classes.setdefault(r["colour"], []).append((r["a"], r["b"], r["w"]))
    order = sorted(classes, key=lambda c: (-sum(w for *_, w in classes[c]), c))
    return [(c, sorted((a, b) for a, b, _ in classes[c])) for c in order]


def stages_of(pairs: list[tuple[int, int, int, int]], active: set[int] | None = None) -> list[list[tuple[int, int]]]:
    """Stages of block-disjoint pairs from rows (a, b, w, static colour), of which a block is in `active`, the heaviest first: the static colours, or pairs dealt one by one where
    that takes fewer stages (two or three for a chain of blocks, that may show all colours)."""
    left = [p for p in pairs if active is None or p[0] in active or p[1] in active]
    classes: dict[int, list] = {}
    for a, b, w, c in left:
        classes.setdefault(c, []).append((a, b, w))
    dealt = schedule([p[:3] for p in left])
    if len(dealt) < len(classes):
        return [sorted(x) for x in dealt]
    order = sorted(classes, key=lambda c: (-sum(w for *_, w in classes[c]), c))
    return [sorted((a, b) for a, b, _ in classes[c]) for c in order]


#: How many times over the room of the other side a corridor may weigh, for the searches that have no alpha of their own.
WIDE = 8.0


def refine_pairs(graph: Graph, assign: DataFrame, m: Machine, lmax: int, kernel: str = "fm", rounds: int = 1, alpha: float = 2.0, active: set[int] | None = None, again: int = 1, spaced: bool = False) -> DataFrame:
    """Refines pairs of blocks side by side with two-way local search ("fm"), minimum cuts ("flow") or swaps ("swap"). Block-disjoint pairs are a stage (`stages_of`); each
    pair's corridor is a group. With `spaced`, no two pairs of a stage are joined by an edge of the quotient graph either. The cost is kept from the edges of moved
    vertices; a stage that does not lower it is dropped. Pairs of which no block changed in the last round are left out (`active`). What the blocks weigh, a row for each,
    is kept by the driver; the edges are written with the blocks of their ends and only changed where vertices move."""
    spark = graph.edges.sparkSession
    state = Rounds(spark)
    graph, assign = state.graph(graph), state.keep(assign)
    load = {r["pid"]: r["bweight"] for r in blocks_of(graph, assign, m.k, lmax).collect()}
    cuts = corridors.cuts_of(graph.vertices)
    ea = state.keep(corridors.placed_arcs(corridors.arcs_of(graph, cuts), assign))
    over = lambda x: sum(max(0, w - lmax) for w in x.values())
    for _ in range(rounds):
        quotient = [(r["a"], r["b"], r["w"], r["colour"]) for r in metrics.quotient(ea).withColumn("colour", corridors.colour(F.col("a"), F.col("b"), m.k)).collect()]
        improved: set[int] = set()
        taken: list[DataFrame] = []
        for stage in distance3_schedule([p[:3] for p in quotient]) if spaced else stages_of(quotient, active):
            stage = [p for p in stage if active is None or p[0] in active or p[1] in active]
            if not stage:
                continue
            pairs = spark.createDataFrame(pa.table({"a": pa.array([a for a, _ in stage], "int64"), "b": pa.array([b for _, b in stage], "int64")}))
            ends = sorted({x for p in stage for x in p})
            blocks = spark.createDataFrame(pa.table({"pid": pa.array(ends, "int64"), "bweight": pa.array([load[x] for x in ends], "int64"), "lmax": pa.array([lmax] * len(ends), "int64")}))
            members = corridors.corridors(graph, assign, pairs, blocks, alpha if kernel == "flow" else max(alpha, WIDE), cuts=cuts, ea=ea)
            vertices, inner = corridors.pair_frames(ea, members, blocks, m)
            run = _pair_kernel(kernel, m, lmax, alpha, again)
            moves = state.keep(vertices.groupBy("a", "b").cogroup(inner.groupBy("a", "b")).applyInPandas(run, "u long, vw long, old_id long, new_id long"))
            sums = moves.groupBy("old_id", "new_id").agg(F.sum("vw").alias("vw")).collect()  # two rows for each pair at most
            if not sums:
                continue
            change, after = cost_change(graph, assign, moves, m, ea), dict(load)
            for r in sums:
                after[r["old_id"]] -= r["vw"]
                after[r["new_id"]] += r["vw"]
            if change < 0 or (change == 0 and over(after) < over(load)):
                ea, load = state.keep(corridors.moved_arcs(ea, moves)), after
                taken.append(moves)
                improved |= {r[x] for r in sums for x in ("old_id", "new_id")}
        if not improved:
            break
        active = improved
        for moves in taken:
            assign = gains.apply_moves(assign, moves)
        assign = state.keep(assign)
    return assign


def partner_moves(conn: DataFrame, assign: DataFrame, pairs: DataFrame, m: Machine) -> DataFrame:
    """(u, old_id, new_id, gain): what moving to the partner of its block would gain each vertex that is connected to it. pairs: (a, b), sharing no block."""
    partner = pairs.select(F.col("a").alias("pid"), F.col("b").alias("new_id")).unionByName(pairs.select(F.col("b").alias("pid"), F.col("a").alias("new_id")))
    wanted = assign.join(F.broadcast(partner), "pid").select("u", F.col("pid").alias("old_id"), "new_id")
    met = wanted.join(conn.select("u", F.col("id").alias("new_id")), ["u", "new_id"], "left_semi").select("u", "old_id", "new_id")
    return gains.gain(conn, met, m)


def label_propagation_by_pairs(graph: Graph, assign: DataFrame, m: Machine, lmax: int, rounds: int = 5, seed: int = 0) -> DataFrame:
    """Label propagation over block pairs: colour after colour of the static colouring, vertices move to the partner of their block if that gains. Of a colour
    an independent set moves, as far as the targets have room; so the cost falls by twice the sum of the gains."""
    spark = graph.edges.sparkSession
    state = Rounds(spark)
    graph, assign = state.graph(graph), state.keep(assign)
    ea = metrics.placed(graph.edges, assign)
    conn = state.keep(metrics.block_conn(ea))
    blocks = state.keep(blocks_of(graph, assign, m.k, lmax))
    quotient = state.keep(metrics.quotient(ea).select("a", "b", "w"))
    active: set[int] | None = None
    for i in range(rounds):
        improved: set[int] = set()
        before = assign
        for _, pairs in coloured(quotient, m.k):
            pairs = [p for p in pairs if active is None or p[0] in active or p[1] in active]
            if not pairs:
                continue
            wanted = partner_moves(conn, assign, spark.createDataFrame(pairs, "a long, b long"), m).where("gain > 0")
            moves = state.keep(gains.admitted(gains.independent(wanted, graph.edges, seed + i), graph.vertices, blocks))
            hit = [r["pid"] for r in moves.select(F.explode(F.array("old_id", "new_id")).alias("pid")).distinct().collect()]
            if not hit:
                continue
            improved |= set(hit)
            assign = state.keep(gains.apply_moves(assign, moves))
            conn = state.keep(gains.moved_conn(conn, graph.edges, moves))
            blocks = state.keep(gains.moved_weights(blocks, graph.vertices, moves))
        if not improved:
            break
        active = improved
        moved = before.join(assign.select("u", F.col("pid").alias("new_id")), "u").where("pid <> new_id").select("u", "new_id")
        quotient = state.keep(gains.moved_quotient(quotient, graph.edges, before, moved))
    return assign


def _pair_kernel(kernel: str, m: Machine, lmax: int, alpha: float, again: int = 1):
    def run(key, vs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        vs = vs.sort_values("u")
        g = Local(vs["u"], vs["vw"], es[["u", "v", "w"]].itertuples(index=False, name=None))
        side = [int(s) for s in vs["side"]]
        old = list(side)
        extra = [(int(a), int(b)) for a, b in zip(vs["pay0"], vs["pay1"], strict=True)]
        ends = int(key[0]), int(key[1])
        base = (int(vs["base0"].iloc[0]), int(vs["base1"].iloc[0])) if len(vs) else (0, 0)
        d = m.between(*ends)
        if kernel == "flow":
            for _ in range(again):
                if not refine_flow(g, side, (lmax, lmax), extra, d, alpha, base):
                    break
        elif kernel == "swap":
            _swap(g, side, extra, d, lmax, base)
        else:
            refine_pair(g, side, (lmax, lmax), extra, 2, d, base)
        return pd.DataFrame([(g.ids[i], g.vw[i], ends[old[i]], ends[s]) for i, s in enumerate(side) if s != old[i]], columns=["u", "vw", "old_id", "new_id"])

    return run


def _swap(g, side: list[int], extra, d: int, lmax: int, base: tuple[int, int] = (0, 0)) -> None:
    """Exchanges the ends of cut edges while that gains and fits."""
    load = [base[x] + sum(w for w, s in zip(g.vw, side, strict=True) if s == x) for x in (0, 1)]

    def gain(u):
        return d * sum(w if side[v] != side[u] else -w for v, w in g.near[u].items()) + extra[u][side[u]] - extra[u][1 - side[u]]

    for u in range(len(g)):
        options = [(gain(u) + gain(v) - 2 * w * d, v) for v, w in g.near[u].items() if side[v] != side[u]]
        if not options:
            continue
        best, v = max(options, key=lambda x: (x[0], -x[1]))
        a, b = side[u], side[v]
        if best > 0 and load[a] - g.vw[u] + g.vw[v] <= lmax and load[b] - g.vw[v] + g.vw[u] <= lmax:
            load[a] += g.vw[v] - g.vw[u]
            load[b] += g.vw[u] - g.vw[v]
            side[u], side[v] = b, a


def swap_moves(graph: Graph, assign: DataFrame, m: Machine) -> DataFrame:
    """(u, old_id, new_id, gain): vertex-disjoint swaps that gain, each the best of both of its ends; a whole round of swap refinement in SQL."""
    conn = metrics.block_conn(metrics.placed(graph.edges, assign))
    swaps = gains.swap_gain(graph.edges, conn, assign, m).where("gain > 0")
    both = swaps.select("u", "v", "gain").unionByName(swaps.select(F.col("v").alias("u"), F.col("u").alias("v"), "gain"))
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("gain"), lo, hi))).where("r = 1").drop("r")
    back = best.select(F.col("v").alias("u"), F.col("u").alias("v"))
    chosen = best.join(back, ["u", "v"])
    a = assign.select("u", F.col("pid").alias("old_id"))
    b = assign.select(F.col("u").alias("v"), F.col("pid").alias("new_id"))
    return chosen.join(a, "u").join(b, "v").select("u", "old_id", "new_id", "gain")


def better(results: DataFrame) -> DataFrame:
    """Of rows (trial, overload, qap) the best: balanced first, then the smaller overload, then the smaller cost."""
    return results.agg(F.min_by("trial", F.struct(F.col("overload") > 0, "overload", "qap", "trial")).alias("trial"))
