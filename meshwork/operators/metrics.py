"""What a placement costs: joins of edges with the assignment, and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshwork.functions.hierarchy import Machine


def placed(edges: DataFrame, assign: DataFrame, shuffled: bool = False) -> DataFrame:
    """(u, v, w, pu, pv): edges with the blocks of both ends. With `shuffled` the placement, a row for each vertex, never passes through the driver to be broadcast."""
    a = assign.select(F.col("u").alias("__u"), F.col("pid").alias("pu"))
    b = assign.select(F.col("u").alias("__v"), F.col("pid").alias("pv"))
    if shuffled:
        a, b = a.hint("shuffle_hash"), b.hint("shuffle_hash")
    return edges.join(a, edges.u == F.col("__u")).join(b, edges.v == F.col("__v")).select("u", "v", "w", "pu", "pv")


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("long")


def qap(ea: DataFrame, m: Machine) -> DataFrame:
    """The mapping cost: both directions of each edge count. Weights are summed for each pair of blocks first, so distances are
    computed k^2 times at most."""
    return block_pairs(ea).agg(_zero(F.sum(F.col("w") * m.distance(F.col("pu"), F.col("pv")))).alias("qap"))


def block_pairs(ea: DataFrame) -> DataFrame:
    return ea.groupBy("pu", "pv").agg(F.sum("w").alias("w"))


def qap_by_groups(ea: DataFrame, m: Machine) -> DataFrame:
    """The mapping cost with distances looked up in the table of PEs (k rows)."""
    pes = m.pes(ea.sparkSession)
    met = block_pairs(ea).join(F.broadcast(pes.alias("x")), F.col("pu") == F.col("x.pid")).join(F.broadcast(pes.alias("y")), F.col("pv") == F.col("y.pid"))
    return met.agg(_zero(F.sum(F.col("w") * m.distance_by_groups("x", "y"))).alias("qap"))


def qap_per_layer(ea: DataFrame, m: Machine) -> DataFrame:
    pairs = block_pairs(ea).select(m.level(F.col("pu"), F.col("pv")).alias("layer"), (F.col("w") * m.distance(F.col("pu"), F.col("pv"))).alias("c"))
    return pairs.groupBy("layer").agg(F.sum("c").cast("long").alias("qap"))


def qap_of_subset(ea: DataFrame, subset: DataFrame, m: Machine) -> DataFrame:
    """The cost of the edges that leave the vertices of `subset` (u)."""
    return qap(ea.join(subset.select("u"), "u", "left_semi"), m)


def qap_of_conn(conn: DataFrame, assign: DataFrame, m: Machine) -> DataFrame:
    """The cost from block connections (u, id, w), which are fewer than edges."""
    met = conn.join(assign, "u")
    return met.agg(_zero(F.sum(F.col("w") * m.distance(F.col("pid"), F.col("id")))).alias("qap"))


def edge_cut(ea: DataFrame) -> DataFrame:
    """Both directions, and each edge once."""
    cut = ea.where("pu <> pv").agg(_zero(F.sum("w")).alias("edge_cut_directed"))
    return cut.withColumn("edge_cut", F.floor(F.col("edge_cut_directed") / 2).cast("long"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, degree, weighted_degree), 0 for isolated vertices."""
    d = edges.groupBy("u").agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))
    return vertices.select("u").join(d, "u", "left").select("u", _zero(F.col("degree")).alias("degree"), _zero(F.col("weighted_degree")).alias("weighted_degree"))


def degree_histogram(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(vertices, edges).groupBy("degree").agg(F.count("*").alias("n"))


def block_weights(vertices: DataFrame, assign: DataFrame, k: int) -> DataFrame:
    """(pid, bweight, n_vertices) of all k blocks, empty ones too."""
    own = vertices.join(assign, "u").groupBy("pid").agg(F.sum("vw").alias("bweight"), F.count("*").alias("n_vertices"))
    every = vertices.sparkSession.range(k).select(F.col("id").alias("pid"))
    return every.join(own, "pid", "left").select("pid", _zero(F.col("bweight")).alias("bweight"), _zero(F.col("n_vertices")).alias("n_vertices"))


def balance(blocks: DataFrame, lmax: int) -> DataFrame:
    """Largest and average weight, empty and overloaded blocks, and the weight over lmax."""
    over = F.col("bweight") > lmax
    return blocks.agg(
        F.max("bweight").alias("max_weight"),
        F.count_if(F.col("bweight") == 0).alias("n_empty"),
        F.count_if(over).alias("n_overloaded"),
        _zero(F.sum(F.greatest(F.col("bweight") - lmax, F.lit(0)))).alias("overload"),
        (F.max("bweight") / (F.sum("bweight") / F.count("*"))).alias("balance"),
        F.max(over).alias("is_overloaded"),
    )


def block_conn(ea: DataFrame) -> DataFrame:
    """(u, id, w): how strongly a vertex is connected to each block."""
    return ea.groupBy("u", F.col("pv").alias("id")).agg(F.sum("w").alias("w"))


def quotient(ea: DataFrame) -> DataFrame:
    """(a, b, w), a < b: each edge between two blocks once."""
    cut = ea.where("u < v and pu <> pv")
    return cut.groupBy(F.least("pu", "pv").alias("a"), F.greatest("pu", "pv").alias("b")).agg(F.sum("w").alias("w"))


def block_adjacency(ea: DataFrame) -> DataFrame:
    return ea.where("pu <> pv").select("pu", "pv").distinct()


def boundary(ea: DataFrame) -> DataFrame:
    """(u, pid, n_ext) of the vertices with a neighbour in another block."""
    return ea.groupBy("u", F.col("pu").alias("pid")).agg(F.count_if(F.col("pu") != F.col("pv")).alias("n_ext")).where("n_ext > 0")


def boundary_sizes(ea: DataFrame) -> DataFrame:
    return boundary(ea).groupBy("pid").agg(F.count("*").alias("n"))


def subgraph_sizes(vertices: DataFrame, ea: DataFrame, assign: DataFrame) -> DataFrame:
    """(pid, n, weight, inner_arcs)."""
    own = vertices.join(assign, "u").groupBy("pid").agg(F.count("*").alias("n"), F.sum("vw").alias("weight"))
    inner = ea.where("pu = pv").groupBy(F.col("pu").alias("pid")).agg(F.count("*").alias("inner_arcs"))
    return own.join(inner, "pid", "left").withColumn("inner_arcs", _zero(F.col("inner_arcs")))


def induced(ea: DataFrame) -> DataFrame:
    """(pid, u, v, w): the edges inside each block, all induced subgraphs at once."""
    return ea.where("pu = pv").select(F.col("pu").alias("pid"), "u", "v", "w")


def migration(vertices: DataFrame, old: DataFrame, new: DataFrame, m: Machine) -> DataFrame:
    """What moving from old to new costs: weight times distance of the vertices that both have; and how many move."""
    met = old.select("u", F.col("pid").alias("a")).join(new.select("u", F.col("pid").alias("b")), "u").join(vertices, "u")
    moved = F.col("a") != F.col("b")
    return met.agg(_zero(F.sum(F.when(moved, F.col("vw") * m.distance(F.col("a"), F.col("b"))))).alias("migration_cost"), F.count_if(moved).alias("moved_vertices"))


def solution_report(vertices: DataFrame, edges: DataFrame, assign: DataFrame, m: Machine, eps: float) -> DataFrame:
    """One row: n, m, k, lmax, cost, cut and balance."""
    from meshwork.functions.scalars import lmax as limit

    total = vertices.agg(_zero(F.sum("vw"))).first()[0]
    most = limit(total, m.k, eps)
    ea = placed(edges, assign)
    size = vertices.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.floor(F.count("*") / 2).cast("long").alias("m_edges")))
    out = size.crossJoin(qap(ea, m)).crossJoin(edge_cut(ea)).crossJoin(balance(block_weights(vertices, assign, m.k), most))
    return out.withColumns({"k": F.lit(m.k).cast("long"), "lmax": F.lit(most).cast("long")})


def duplicate_arcs(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 1")


def command_stats(log: DataFrame) -> DataFrame:
    """(cmd, calls, total, average) of a table (cmd, seconds)."""
    return log.groupBy("cmd").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total"), F.avg("seconds").alias("average"))


def multisection_items(graph, assign: DataFrame, m: Machine) -> DataFrame:
    """(item, depth, k, n, weight, m_edges): the parts that a multisection has split, outermost first; item is the smallest block of a part, k its number of
    children, n, weight and m_edges count its own vertices and inner edges."""
    out = None
    for depth in range(len(m.sizes)):
        stride = m.strides[len(m.sizes) - 1 - depth]
        part = lambda c: (F.floor(F.col(c) / stride) * stride).cast("long")  # noqa: E731, B023
        own = assign.join(graph.vertices, "u").groupBy(part("pid").alias("item")).agg(F.count("*").alias("n"), F.sum("vw").cast("long").alias("weight"))
        inner = placed(graph.edges, assign).where(part("pu") == part("pv")).groupBy(part("pu").alias("item")).agg(F.floor(F.count("*") / 2).cast("long").alias("m_edges"))
        rows = own.join(inner, "item", "left").select("item", F.lit(depth).cast("long").alias("depth"), F.lit(m.sizes[len(m.sizes) - 1 - depth]).cast("long").alias("k"), "n", "weight", F.coalesce("m_edges", F.lit(0).cast("long")).alias("m_edges"))
        out = rows if out is None else out.unionByName(rows)
    return out
