"""Coarsening: rate edges, match or cluster vertices, contract, project back.

Rounds write their state (`Rounds`), so their plans stay small and a lost executor costs the tasks of one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshwork.functions.scalars import rating, unhash
from meshwork.operators.rounds import Rounds, ranked
from meshwork.sources.graph import Graph


def rated(vertices: DataFrame, edges: DataFrame, kind: str = "expansion_star", cap: int | None = None, assign: DataFrame | None = None) -> DataFrame:
    """(u, v, w, r) of the edges that may be contracted: both ends in one block, their weight within the cap."""
    a, b = vertices.select("u", F.col("vw").alias("cu")), vertices.select(F.col("u").alias("v"), F.col("vw").alias("cv"))
    met = edges.join(a, "u").join(b, "v")
    if cap is not None:
        met = met.where(F.col("cu") + F.col("cv") <= cap)
    if assign is not None:
        met = met.join(assign.select("u", F.col("pid").alias("pu")), "u").join(assign.select(F.col("u").alias("v"), F.col("pid").alias("pv")), "v").where("pu = pv")
    out_u = out_v = None
    if kind == "inner_outer":
        deg = edges.groupBy("u").agg(F.sum("w").alias("out_u"))
        met = met.join(deg, "u").join(deg.select(F.col("u").alias("v"), F.col("out_u").alias("out_v")), "v")
        out_u, out_v = F.col("out_u"), F.col("out_v")
    return met.select("u", "v", "w", rating(kind, F.col("w"), F.col("cu"), F.col("cv"), out_u, out_v).alias("r"))


def best_neighbor(edges: DataFrame, order: list[Column]) -> DataFrame:
    """(u, v): the first neighbour of each vertex."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(*order))).where("rank = 1").select("u", "v")


def mutual(pref: DataFrame) -> DataFrame:
    """(u, v), u < v, that prefer each other."""
    back = pref.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return pref.join(back, ["u", "v"]).where("u < v")


#: A pass over all edges keeps so many of the best for each vertex, and handshakes go on among these; rounds that match less than the share FEW are left to the next
#: pass. Fixed values.
LIST, FEW = 16, 0.01


def shortlists(arcs: DataFrame, order: list[Column]) -> DataFrame:
    """(u, v, r) in both directions: the first LIST neighbours of each vertex."""
    best = arcs.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(*order))).where(F.col("rank") <= LIST).select("u", "v", "r")
    return best.unionByName(best.select(F.col("v").alias("u"), F.col("u").alias("v"), "r")).groupBy("u", "v").agg(F.max("r").alias("r"))


def matching(vertices: DataFrame, edges: DataFrame, kind: str = "expansion_star", cap: int | None = None, assign: DataFrame | None = None, seed: int = 0, most_rounds: int = 20, target: float = 1.0) -> DataFrame:
    """(u, v), u < v: a maximal matching by handshakes. Each free vertex prefers its best-rated free neighbour; mutual preferences
    match. The order is the same seen from either end, so the best free edge is mutual and every round adds one at least. Rounds go over short lists of edges; all edges
    are met again, those of free vertices, only when the lists are used up. `most_rounds` bounds the passes and the rounds of each."""
    rounds = Rounds(edges.sparkSession)
    n, done, found, free, i = vertices.count(), 0, None, vertices, 0
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    for turn in range(most_rounds):
        if turn:
            free = rounds.keep(vertices.join(ends(found), "u", "left_anti"))
        order = lambda i: [F.desc("r"), unhash(lo * 31 + hi, seed + i), lo, hi]
        open_ = rounds.keep(shortlists(rated(free, edges, kind, cap, assign), order(i)))
        before = done
        for _ in range(most_rounds):
            new = rounds.keep(mutual(best_neighbor(open_, order(i))))
            added, i = new.count(), i + 1
            if not added:
                break
            found = new if found is None else found.unionByName(new)
            done += 2 * added
            if done >= target * n:
                return found
            if 2 * added < FEW * n:
                break
            used = ends(new)
            open_ = rounds.keep(open_.join(used, "u", "left_anti").join(used.select(F.col("u").alias("v")), "v", "left_anti"))
        if done == before:
            break
    return found if found is not None else edges.select("u", "v").limit(0)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("u").unionByName(pairs.select(F.col("v").alias("u")))


def two_hop_degree_one(edges: DataFrame) -> DataFrame:
    """(u, v), u < v: vertices of degree one that hang on the same vertex, paired in order."""
    leaf = edges.groupBy("u").agg(F.count("*").alias("d"), F.min("v").alias("mid")).where("d = 1")
    return _paired(leaf, ["mid"])


def twins(edges: DataFrame) -> DataFrame:
    """(u, v), u < v: vertices of equal neighbourhood, paired in order."""
    near = edges.groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("near"))
    return _paired(near, ["near"])


def _paired(rows: DataFrame, by: list[str], order: tuple[str, ...] = ("u",)) -> DataFrame:
    """Rows 1 and 2, 3 and 4, ... of each group in this order; at most one of a group is left over."""
    numbered = ranked(rows, by, list(order), Rounds(rows.sparkSession)).withColumn("__pair", F.floor(F.col("rank") / 2))
    pairs = numbered.groupBy(*by, "__pair").agg(F.min("u").alias("a"), F.max("u").alias("b"), F.count("*").alias("n"))
    return pairs.where("n = 2").select(F.col("a").alias("u"), F.col("b").alias("v"))


def two_hop_matchmaker(edges: DataFrame, free: DataFrame) -> DataFrame:
    """(u, v), u < v: free vertices whose strongest neighbour is the same one, paired in order."""
    best = best_neighbor(edges.join(free.select("u"), "u", "left_semi"), [F.desc("w"), F.col("v")])
    return _paired(best.withColumnRenamed("v", "mid"), ["mid"])


#: A matching of this share of the vertices is enough; below it, vertices that share a neighbour are paired. Fixed value.
ENOUGH = 0.75
TWO_HOP = (("degree one", two_hop_degree_one), ("twins", twins), ("matchmaker", lambda e: two_hop_matchmaker(e, e.select("u").distinct())))


def two_hop(vertices: DataFrame, edges: DataFrame, pairs: DataFrame, cap: int, assign: DataFrame | None = None, enough: float = ENOUGH, report: list | None = None) -> DataFrame:
    """(u, v), u < v: `pairs` and, of the vertices they leave, those that share a neighbour: vertices of degree one first, then twins,
    then vertices with the same strongest neighbour; each step only while less than the share `enough` of the vertices is matched. Pairs weigh `cap` at
    most and stay inside a block of `assign`. `report` gets the steps taken."""
    state = Rounds(edges.sparkSession)
    found, n = pairs, vertices.count()
    for name, step in TWO_HOP:
        if 2 * found.count() >= enough * n:
            break
        if report is not None:
            report.append(name)
        free = state.keep(vertices.select("u").join(ends(found), "u", "left_anti"))
        found = state.keep(found.unionByName(allowed(step(edges.join(free, "u", "left_semi")), vertices, cap, assign)))
    return found


def allowed(pairs: DataFrame, vertices: DataFrame, cap: int, assign: DataFrame | None = None) -> DataFrame:
    """The pairs of weight `cap` at most, both of one block."""
    met = pairs.join(vertices.select("u", F.col("vw").alias("a")), "u").join(vertices.select(F.col("u").alias("v"), F.col("vw").alias("b")), "v").where(F.col("a") + F.col("b") <= cap)
    if assign is not None:
        met = met.join(assign.select("u", F.col("pid").alias("pa")), "u").join(assign.select(F.col("u").alias("v"), F.col("pid").alias("pb")), "v").where("pa = pb")
    return met.select("u", "v")


def pair_any(vertices: DataFrame, pairs: DataFrame, cap: int, assign: DataFrame | None = None) -> DataFrame:
    """`pairs` and, of the vertices they leave, in each block and lightest first, every two that follow each other: the last resort where nothing is adjacent, which
    bounds what coarsening leaves, whatever the ids."""
    free = vertices.join(ends(pairs), "u", "left_anti").where(F.col("vw") < cap)
    free = free.join(assign, "u") if assign is not None else free.withColumn("pid", F.lit(0).cast("long"))
    return pairs.unionByName(allowed(_paired(free, ["pid"], ("vw", "u")), vertices, cap, assign))


def mapping_of(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, c): a vertex's coarse vertex is named by the smaller of the pair."""
    down = pairs.select(F.col("v").alias("u"), F.col("u").alias("c"))
    return vertices.select("u").join(down, "u", "left").select("u", F.coalesce("c", "u").alias("c"))


def dense_mapping(mapping: DataFrame) -> DataFrame:
    """(u, c) with c = 0, 1, ... in the order of the old c, numbered over sorted partitions and not by one task."""
    spark = mapping.sparkSession
    names = mapping.select("c").distinct().sort("c").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    return mapping.join(spark.createDataFrame(names, "c long, i long"), "c").select("u", F.col("i").alias("c"))


def contract(graph: Graph, mapping: DataFrame) -> Graph:
    """Vertices of one c become one: weights add up, parallel edges too, inner edges vanish."""
    a, b = mapping.select("u", F.col("c").alias("cu")), mapping.select(F.col("u").alias("v"), F.col("c").alias("cv"))
    edges = graph.edges.join(a, "u").join(b, "v").where("cu <> cv").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))
    vertices = graph.vertices.join(mapping, "u").groupBy(F.col("c").alias("u")).agg(F.sum("vw").alias("vw"))
    return Graph(vertices, edges)


def contract_assign(assign: DataFrame, mapping: DataFrame) -> DataFrame:
    """The placement of the coarse vertices, if no cluster spans blocks."""
    return assign.join(mapping, "u").groupBy(F.col("c").alias("u")).agg(F.min("pid").alias("pid"))


def project(assign: DataFrame, mapping: DataFrame) -> DataFrame:
    """The placement of the fine vertices."""
    return mapping.join(assign.select(F.col("u").alias("c"), "pid"), "c").select("u", "pid")


def lp_candidates(vertices: DataFrame, edges: DataFrame, clusters: DataFrame, max_w: int, kind: str = "weight") -> DataFrame:
    """(u, old, new, gain): the strongest neighbouring cluster that has room, if it is stronger than the own one."""
    sizes = clusters.join(vertices, "u").groupBy("c").agg(F.sum("vw").alias("cw"))
    met = edges.join(clusters.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").cast("double").alias("r"))
    met = met.join(clusters.select("u", F.col("c").alias("own")), "u").join(vertices, "u").join(sizes, "c")
    if kind == "expansion_star":
        met = met.withColumn("r", F.col("r") / (F.col("vw") * F.col("cw")))
    inner = met.where("c = own").select("u", F.col("r").alias("stay"))
    outer = met.where((F.col("c") != F.col("own")) & (F.col("vw") + F.col("cw") <= max_w))
    first = Window.partitionBy("u").orderBy(F.desc("r"), "c")
    best = outer.withColumn("i", F.row_number().over(first)).where("i = 1")
    best = best.join(inner, "u", "left").withColumn("gain", F.col("r") - F.coalesce("stay", F.lit(0.0)))
    return best.where("gain > 0").select("u", F.col("own").alias("old_id"), F.col("c").alias("new_id"), "gain")


def cluster(graph: Graph, max_w: int, most_rounds: int = 5, least: float = 0.01, seed: int = 0, assign: DataFrame | None = None) -> DataFrame:
    """(u, c): size-constrained label propagation. In a round the vertices of one parity of a hash may move, and each cluster takes the
    strongest movers that fit. A round that moves fewer than `least` of all vertices is the last."""
    from meshwork.operators.gains import admitted

    rounds = Rounds(graph.edges.sparkSession)
    graph = rounds.graph(graph)
    edges = graph.edges
    if assign is not None:
        edges = rated(graph.vertices, edges, "weight", None, assign).select("u", "v", "w")
    n = graph.vertices.count()
    clusters = rounds.keep(graph.vertices.select("u", F.col("u").alias("c")))
    for i in range(most_rounds):
        moves = lp_candidates(graph.vertices, edges, clusters, max_w).where(F.pmod(F.floor(unhash(F.col("u"), seed + i) / 1024), F.lit(2)) == i % 2)
        sizes = clusters.join(graph.vertices, "u").groupBy(F.col("c").alias("pid")).agg(F.sum("vw").alias("bweight")).withColumn("lmax", F.lit(max_w))
        moves = rounds.keep(admitted(moves, graph.vertices, sizes))
        moved = moves.count()
        new = moves.select("u", F.col("new_id").alias("n"))
        clusters = rounds.keep(clusters.join(new, "u", "left").select("u", F.coalesce("n", "c").alias("c")))
        if moved < least * n and i % 2:
            break
    return clusters


def merge_singletons(graph: Graph, clusters: DataFrame, max_w: int) -> DataFrame:
    """Vertices alone in their cluster that hang on the same strongest neighbour are packed together while they fit."""
    lone = clusters.join(clusters.groupBy("c").agg(F.count("*").alias("n")).where("n = 1").select("c"), "c", "left_semi")
    best = best_neighbor(graph.edges.join(lone.select("u"), "u", "left_semi"), [F.desc("w"), F.col("v")]).join(graph.vertices, "u")
    bins = ranked(best, ["v"], ["u"], Rounds(graph.edges.sparkSession), "vw").withColumn("bin", F.floor(F.col("ahead") * 2 / max_w))
    head = bins.withColumn("head", F.min("u").over(Window.partitionBy("v", "bin"))).withColumn("sofar", F.sum("vw").over(Window.partitionBy("v", "bin").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)))
    new = head.where(F.col("sofar") <= max_w).select("u", F.col("head").alias("n"))
    return clusters.join(new, "u", "left").select("u", F.coalesce("n", "c").alias("c"))
