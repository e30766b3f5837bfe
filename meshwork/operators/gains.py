"""What moving vertices would save: one table of block connections answers every target at once.

A gain counts each incident edge once and is positive for an improvement, so one move changes the mapping cost by -2 * gain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.functions.scalars import unhash
from meshwork.operators.rounds import few


def _saved(m: Machine, old: Column, new: Column) -> Column:
    return F.sum((m.distance(F.col("id"), old) - m.distance(F.col("id"), new)) * F.col("w"))


def gain(conn: DataFrame, moves: DataFrame, m: Machine) -> DataFrame:
    """(u, old_id, new_id, gain) for moves (u, old_id, new_id). conn: block connections (u, id, w)."""
    met = moves.join(conn, "u", "left")
    g = met.groupBy("u", "old_id", "new_id").agg(_saved(m, F.col("old_id"), F.col("new_id")).alias("gain"))
    return g.withColumn("gain", F.coalesce("gain", F.lit(0)).cast("long"))


def gain_and_flags(conn: DataFrame, moves: DataFrame, m: Machine) -> DataFrame:
    """With the gain: whether u is boundary before and after the move, and whether it has a neighbour in the new block."""
    met = moves.join(conn, "u", "left")
    return met.groupBy("u", "old_id", "new_id").agg(
        F.coalesce(_saved(m, F.col("old_id"), F.col("new_id")), F.lit(0)).cast("long").alias("gain"),
        F.coalesce(F.max(F.col("id") != F.col("old_id")), F.lit(False)).alias("is_boundary_old"),
        F.coalesce(F.max(F.col("id") != F.col("new_id")), F.lit(False)).alias("is_boundary_new"),
        F.coalesce(F.max(F.col("id") == F.col("new_id")), F.lit(False)).alias("is_connected"),
    )


def cut_gain(conn: DataFrame, moves: DataFrame) -> DataFrame:
    """(u, old_id, new_id, gain, is_connected) for the edge cut: connection to the new block less that to the old."""
    met = moves.join(conn, "u", "left")
    to = lambda c: F.coalesce(F.sum(F.when(F.col("id") == F.col(c), F.col("w"))), F.lit(0))
    return met.groupBy("u", "old_id", "new_id").agg((to("new_id") - to("old_id")).cast("long").alias("gain"), (to("new_id") > 0).alias("is_connected"))


def candidates(conn: DataFrame, assign: DataFrame) -> DataFrame:
    """(u, old_id, new_id): each vertex with the other blocks that it is connected to."""
    return conn.join(assign, "u").where("id <> pid").select("u", F.col("pid").alias("old_id"), F.col("id").alias("new_id"))


def best_block(conn: DataFrame, assign: DataFrame, m: Machine, room: DataFrame | None = None, vertices: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """(u, old_id, new_id, gain): the best target of each vertex among its neighbour blocks; ties go to the smaller block, or by a
    hash of seed, vertex and block. room: blocks (pid, bweight, lmax) that must take the vertex."""
    moves = candidates(conn, assign)
    if room is not None:
        fits = moves.join(vertices, "u").join(F.broadcast(room.select(F.col("pid").alias("new_id"), "bweight", "lmax")), "new_id")
        moves = fits.where(F.col("bweight") + F.col("vw") <= F.col("lmax")).select("u", "old_id", "new_id")
    tie = F.col("new_id") if seed is None else F.xxhash64(F.lit(seed), "u", "new_id")
    first = Window.partitionBy("u").orderBy(F.desc("gain"), tie, "new_id")
    return gain(conn, moves, m).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def swap_gain(edges: DataFrame, conn: DataFrame, assign: DataFrame, m: Machine) -> DataFrame:
    """(u, v, gain) of exchanging the blocks of the ends of each cut edge: both gains, less twice what the edge itself counts for."""
    ends = edges.where("u < v").join(assign.select("u", F.col("pid").alias("pu")), "u").join(assign.select(F.col("u").alias("v"), F.col("pid").alias("pv")), "v").where("pu <> pv")
    one = gain(conn, ends.select("u", F.col("pu").alias("old_id"), F.col("pv").alias("new_id")).distinct(), m)
    two = gain(conn, ends.select(F.col("v").alias("u"), F.col("pv").alias("old_id"), F.col("pu").alias("new_id")).distinct(), m)
    a = one.select("u", F.col("old_id").alias("pu"), F.col("new_id").alias("pv"), F.col("gain").alias("ga"))
    b = two.select(F.col("u").alias("v"), F.col("old_id").alias("pv"), F.col("new_id").alias("pu"), F.col("gain").alias("gb"))
    met = ends.join(a, ["u", "pu", "pv"]).join(b, ["v", "pu", "pv"])
    return met.select("u", "v", (F.col("ga") + F.col("gb") - 2 * F.col("w") * m.distance(F.col("pu"), F.col("pv"))).cast("long").alias("gain"))


def admitted(moves: DataFrame, vertices: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of moves (u, old_id, new_id, gain) those that fit: for each target, by falling gain, as long as the running weight stays within its
    room. Blocks only gain what fits, so none becomes overloaded."""
    room = blocks.select(F.col("pid").alias("new_id"), (F.col("lmax") - F.col("bweight")).alias("room"))
    met = moves.join(vertices, "u").join(room, "new_id")
    line = Window.partitionBy("new_id").orderBy(F.desc("gain"), "u").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("sum", F.sum("vw").over(line)).where("sum <= room").drop("sum", "room", "vw")


def independent(moves: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """Moves without adjacent movers, so that gains add up: one stays if its gain, then its hash, is above all moving neighbours'."""
    key = F.struct(F.col("gain"), unhash(F.col("u"), seed).alias("h"), F.col("u").alias("id"))
    own = moves.withColumn("key", key)
    near = edges.join(own.select("u", "key"), "u").join(own.select(F.col("u").alias("v"), F.col("key").alias("other")), "v")
    beaten = near.where("other > key").select("u").distinct()
    return own.drop("key").join(beaten, "u", "left_anti")


def apply_moves(assign: DataFrame, moves: DataFrame) -> DataFrame:
    new = few(moves, "u", F.col("new_id").alias("__new"))
    return assign.join(new, "u", "left").select("u", F.coalesce("__new", "pid").alias("pid"))


def moved_conn(conn: DataFrame, edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Block connections after the moves, from the change alone: -w at the old and +w at the new block of each neighbour."""
    hit = edges.join(few(moves, F.col("u").alias("v"), "old_id", "new_id"), "v")
    delta = hit.select("u", F.col("old_id").alias("id"), (-F.col("w")).alias("w")).unionByName(hit.select("u", F.col("new_id").alias("id"), "w"))
    return conn.unionByName(delta).groupBy("u", "id").agg(F.sum("w").alias("w")).where("w <> 0")


def moved_weights(blocks: DataFrame, vertices: DataFrame, moves: DataFrame) -> DataFrame:
    met = few(moves, "u", "old_id", "new_id").join(vertices, "u")
    delta = met.select(F.col("old_id").alias("pid"), (-F.col("vw")).alias("d")).unionByName(met.select(F.col("new_id").alias("pid"), F.col("vw").alias("d")))
    sums = delta.groupBy("pid").agg(F.sum("d").alias("d"))
    return blocks.join(sums, "pid", "left").withColumn("bweight", (F.col("bweight") + F.coalesce("d", F.lit(0))).cast("long")).drop("d")


def moved_quotient(quotient: DataFrame, edges: DataFrame, assign: DataFrame, moves: DataFrame) -> DataFrame:
    """The quotient graph (a, b, w), a < b, after the moves, from the edges of moved vertices alone: what they gave the old pair of blocks goes over to the new one.
    assign: the placement before the moves."""
    there = moves.select("u", "new_id")
    hit = edges.join(there.select("u"), "u", "left_semi")
    # an edge between two moved vertices is met from both ends and counted from the smaller one
    both = there.select(F.col("u").alias("v"), F.lit(True).alias("other"))
    hit = hit.join(both, "v", "left").where("other is null or u < v").select("u", "v", "w")
    old = assign.select("u", "pid")
    new = old.join(there, "u", "left").select("u", F.coalesce("new_id", "pid").alias("pid"))
    sign = lambda where, factor: hit.join(where, "u").join(where.select(F.col("u").alias("v"), F.col("pid").alias("qid")), "v").where("pid <> qid").select(F.least("pid", "qid").alias("a"), F.greatest("pid", "qid").alias("b"), (F.col("w") * factor).alias("w"))
    delta = sign(old, -1).unionByName(sign(new, 1))
    return quotient.select("a", "b", "w").unionByName(delta).groupBy("a", "b").agg(F.sum("w").cast("long").alias("w")).where("w <> 0")
