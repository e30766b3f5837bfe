"""Global path matching on Spark: paths and even cycles grown from the best edges, each matched optimally.

1. Edges get their place in the order of rating by a range-partitioned sort. In a round every vertex names its best open edges, as many as it may still take (two
   in all); edges named from both ends are taken. The best open edge is always one, so the rounds end, and taken edges form paths and cycles.
2. Taken edges are two arcs each; pointer jumping tells every arc its path's end and its distance from it, in as many rounds as the longest path has binary
   digits. What never ends is a cycle. An odd cycle loses its lightest edge for good, and growing goes on from the ends that this frees.
3. The largest matching of a path is keep[i] = max(keep[i-1], keep[i-2] + r[i]), a product of 2 x 2 matrices of (max, +). Paths are cut to chunks of `CHUNK` edges;
   chunks are multiplied by themselves, then combined by a scan that doubles its reach, so no task sees a whole path. Which edges were taken follows from
   runs of rising keep, the same way from behind. A cycle is the better of two paths: without its first edge and without its last.

All steps are joins, windows and aggregates over rows of vertices, arcs or chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshwork.functions.scalars import unhash
from meshwork.operators.rounds import Rounds, ranked

CHUNK = 256
ARC = ["u", "v"]


def two_best(open_: DataFrame, taken_at: DataFrame) -> DataFrame:
    """(u, v): edges that are among the best that both of their ends may still take. open_: (u, v, rank) from both ends; taken_at: (u, n)."""
    from pyspark.sql import Window

    first = open_.withColumn("i", F.row_number().over(Window.partitionBy("u").orderBy("rank"))).where("i <= 2")
    first = first.join(taken_at, "u", "left").where(F.col("i") <= 2 - F.coalesce("n", F.lit(0))).select("u", "v")
    return first.join(first.select(F.col("v").alias("u"), F.col("u").alias("v")), ARC)


def grow(edges: DataFrame, taken: DataFrame | None, state: Rounds) -> DataFrame:
    """(u, v, r, rank) from both ends: the edges taken, those of `taken` among them. edges: the same columns, all that may be taken."""
    taken = edges.limit(0) if taken is None else taken
    while True:
        at = state.keep(taken.groupBy("u").agg(F.count("*").alias("n")))
        full = at.where("n >= 2").select("u")
        free = edges.join(full, "u", "left_anti").join(full.withColumnRenamed("u", "v"), "v", "left_anti").join(taken.select(*ARC), ARC, "left_anti")
        new = state.keep(free.join(two_best(free.select("u", "v", "rank"), at), ARC).select("u", "v", "r", "rank"))
        if not new.head(1):
            return taken
        taken = state.keep(taken.unionByName(new))


def follow(arcs: DataFrame, state: Rounds, cut: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pointer jumping over arcs (u, v, rank): those that reach an end, with (end, before, n): the last vertex, the one before it, and how many arcs are left; and the
    rest, on cycles, with (least, worst): the smallest vertex and the largest rank of the cycle. Arcs into a vertex of `cut` (u) end there."""
    onward = arcs if cut is None else arcs.join(cut.select("u"), "u", "left_anti")
    nxt = onward.select(F.col("u").alias("v"), F.col("v").alias("w"))
    step = arcs.join(nxt, "v", "left").where("w is null or w <> u").groupBy("u", "v", "rank").agg(F.max("w").alias("w"))
    # an arc whose only way on is back has none: it was dropped by the filter and is put back
    step = arcs.select("u", "v", "rank").join(step.select("u", "v", "w"), ARC, "left")
    at_end = F.col("w").isNull()
    now = step.select(
        "u", "v", F.when(~at_end, F.col("v")).alias("nu"), F.col("w").alias("nv"), F.when(at_end, F.col("v")).alias("end"), F.when(at_end, F.col("u")).alias("before"),
        F.lit(1).cast("long").alias("n"), F.col("u").alias("least"), F.col("rank").alias("worst"),
    )
    now, open_, stable = state.keep(now), None, False
    while True:
        left = now.where("end is null").agg(F.count("*").alias("n"), F.sum(F.col("least").cast("decimal(38,0)")).alias("s"), F.sum(F.col("worst").cast("decimal(38,0)")).alias("w")).first()
        if not left["n"]:
            break
        # while a path goes on, each round ends some of its arcs; then cycles go on until what they have seen no longer changes
        if open_ is not None and tuple(left) == open_:
            stable = True
            break
        open_ = tuple(left)
        t = now.select(F.col("u").alias("nu"), F.col("v").alias("nv"), *[F.col(c).alias("t_" + c) for c in ("nu", "nv", "end", "before", "n", "least", "worst")])
        met = now.where("end is null").join(t, ["nu", "nv"])
        met = met.select("u", "v", F.col("t_nu").alias("nu"), F.col("t_nv").alias("nv"), F.col("t_end").alias("end"), F.col("t_before").alias("before"), (F.col("n") + F.col("t_n")).alias("n"), F.least("least", "t_least").alias("least"), F.greatest("worst", "t_worst").alias("worst"))
        now = state.keep(now.where("end is not null").unionByName(met))
    cycles = now.where("end is null") if stable else now.limit(0)
    return now.where("end is not null").select("u", "v", "end", "before", "n"), cycles.select("u", "v", "least", "worst")


def lines(edges: DataFrame, state: Rounds) -> DataFrame:
    """(path, variant, pos, u, v, r): the taken edges in order. variant 0: paths; 1 and 2: cycles without their first and without their last edge. edges: (u, v, r, rank)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "r", "rank"))
    taken = None
    while True:
        taken = state.keep(grow(both, taken, state))
        ended, cycles = follow(taken.select("u", "v", "rank"), state)
        cycles = state.keep(cycles)
        odd = state.keep(cycles.groupBy("least", "worst").agg(F.count("*").alias("n")).where("n % 4 = 2").select(F.col("worst").alias("rank")))  # two arcs an edge
        if not odd.head(1):
            break
        both = state.keep(both.join(odd, "rank", "left_anti"))
        taken = taken.join(odd, "rank", "left_anti")
    weight = taken.select("u", "v", "r")
    back = ended.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("end").alias("start"), (F.col("n") - 1).alias("pos"))
    out = ended.select("u", "v", "end").join(back, ARC).where("start < end").join(weight, ARC).select(F.col("start").alias("path"), F.lit(0).alias("variant"), "pos", "u", "v", "r")
    if cycles.head(1):
        heads = cycles.select(F.col("least").alias("u")).distinct()
        first = cycles.join(heads, "u", "left_semi").groupBy(F.col("u").alias("end")).agg(F.max("v").alias("before"))  # go round towards the smaller neighbour
        line, _ = follow(cycles.select("u", "v", F.col("worst").alias("rank")), state, heads)
        line = line.join(first, ["end", "before"]).join(weight, ARC)
        sizes = line.groupBy("end").agg(F.count("*").alias("size"))
        line = line.join(sizes, "end").withColumn("pos", F.col("size") - F.col("n"))
        one = line.where("pos > 0").select(F.col("end").alias("path"), F.lit(1).alias("variant"), (F.col("pos") - 1).alias("pos"), "u", "v", "r")
        two = line.where("pos < size - 1").select(F.col("end").alias("path"), F.lit(2).alias("variant"), "pos", "u", "v", "r")
        out = out.unionByName(one).unionByName(two)
    return state.keep(out)


def scan(chunks: DataFrame, by: list[str], value: str, combine, state: Rounds, backward: bool = False) -> DataFrame:
    """Replaces `value` of each chunk by the combination of all up to it (backward: from it on), the reach doubling in each round."""
    last = chunks.agg(F.max("chunk")).first()[0] or 0
    reach, sign = 1, -1 if backward else 1
    while reach <= last:
        other = chunks.select(*by, (F.col("chunk") + sign * reach).alias("chunk"), F.col(value).alias("other"))
        joined = chunks.join(other, [*by, "chunk"], "left")
        chunks = state.keep(joined.withColumn(value, F.when(F.col("other").isNull(), F.col(value)).otherwise(combine(F.col("other"), F.col(value)))).drop("other"))
        reach *= 2
    return chunks


def _step(s: Column, r: Column) -> Column:
    """One more edge: two columns (x, y) = (keep[i-1], keep[i]) of a matrix each become (y, max(y, x + r))."""
    return F.struct(s["y1"].alias("x1"), F.greatest(s["y1"], s["x1"] + r).alias("y1"), s["y2"].alias("x2"), F.greatest(s["y2"], s["x2"] + r).alias("y2"))


def _times(a: Column, b: Column) -> Column:
    """First a, then b, in (max, +)."""
    apply = lambda x, y: (F.greatest(x + b["x1"], y + b["x2"]), F.greatest(x + b["y1"], y + b["y2"]))
    (x1, y1), (x2, y2) = apply(a["x1"], a["y1"]), apply(a["x2"], a["y2"])
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def path_scores(line: DataFrame, state: Rounds, chunk: int = CHUNK) -> DataFrame:
    """Adds `keep`, the largest total of a matching of the edges up to this one, and `before`, that without it. line: (path, variant, pos, r, ..)."""
    by = ["path", "variant"]
    own = line.withColumn("chunk", F.floor(F.col("pos") / chunk).cast("long"))
    rs = own.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("rs"))
    low = F.lit(float("-inf"))
    one = F.struct(F.lit(0.0).alias("x1"), low.alias("y1"), low.alias("x2"), F.lit(0.0).alias("y2"))
    chunks = state.keep(rs.withColumn("m", F.aggregate("rs", one, lambda s, e: _step(s, e["r"]))))
    upto = scan(chunks.select(*by, "chunk", "m"), by, "m", _times, state)
    # what the chunk starts from: the product of all before it, applied to keep = 0, 0
    prior = upto.select(*by, (F.col("chunk") + 1).alias("chunk"), F.struct(F.greatest("m.x1", "m.x2").alias("x"), F.greatest("m.y1", "m.y2").alias("y")).alias("from"))
    begun = chunks.join(prior, [*by, "chunk"], "left").withColumn("from", F.coalesce("from", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))))
    empty = F.array().cast("array<double>")
    start = F.struct(F.col("from.x").alias("x"), F.col("from.y").alias("y"), empty.alias("all"))
    grown = F.aggregate("rs", start, lambda s, e: F.struct(s["y"].alias("x"), F.greatest(s["y"], s["x"] + e["r"]).alias("y"), F.concat(s["all"], F.array(F.greatest(s["y"], s["x"] + e["r"]))).alias("all")))
    scored = begun.select(*by, F.col("from.y").alias("first"), "rs", grown["all"].alias("all"))
    rows = scored.select(*by, "first", "all", F.posexplode("rs").alias("i", "e"))
    before = F.when(F.col("i") == 0, F.col("first")).otherwise(F.element_at("all", F.greatest(F.col("i"), F.lit(1))))
    keeps = rows.select(*by, F.col("e.pos").alias("pos"), F.element_at("all", F.col("i") + 1).alias("keep"), before.alias("before"))
    return line.join(keeps, [*by, "pos"])


def chosen(scored: DataFrame, state: Rounds, chunk: int = CHUNK) -> DataFrame:
    """The edges of each path's largest matching: of a run of rising keep its last edge, and every second one before it."""
    from pyspark.sql import Window

    by = ["path", "variant"]
    own = state.keep(scored.withColumn("chunk", F.floor(F.col("pos") / chunk).cast("long")).withColumn("rises", F.col("keep") > F.col("before")))
    # a run ends before an edge that doesn't rise: the first such place behind each edge, in its chunk or a later one
    stops = own.where("not rises").groupBy(*by, "chunk").agg(F.min("pos").alias("stop"))
    ends = own.groupBy(*by, "chunk").agg((F.max("pos") + 1).alias("size"))
    last = ends.groupBy(*by).agg(F.max("size").alias("size"))
    chunks = ends.select(*by, "chunk").join(stops, [*by, "chunk"], "left").join(last, by)
    chunks = state.keep(chunks.select(*by, "chunk", F.coalesce("stop", "size").alias("stop")))
    after = scan(chunks, by, "stop", lambda other, mine: F.least(other, mine), state, backward=True).select(*by, (F.col("chunk") - 1).alias("chunk"), F.col("stop").alias("later"))
    inside = Window.partitionBy(*by, "chunk").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    met = own.withColumn("stop", F.min(F.when(~F.col("rises"), F.col("pos"))).over(inside)).join(after, [*by, "chunk"], "left").join(last, by)
    stop = F.coalesce("stop", "later", "size")
    return met.where(F.col("rises") & ((stop - 1 - F.col("pos")) % 2 == 0)).select(*by, "pos", "u", "v", "r")


def global_paths(rated: DataFrame, seed: int = 0) -> DataFrame:
    """(u, v), u < v: a matching from rated edges (u, v, r) with u < v or both directions; edges of rating 0 or less aren't taken. Ties go by a hash of both ends and the seed.
    A table without edges gives no pairs."""
    state = Rounds(rated.sparkSession)
    one = rated.where("u < v and r > 0").select("u", "v", F.col("r").cast("double").alias("r"))
    order = [(-F.col("r")).alias("less"), unhash(F.col("u") * 31 + F.col("v"), seed).alias("h")]
    edges = ranked(one.select("*", *order), [], ["less", "h", "u", "v"], state).select("u", "v", "r", "rank")
    line = lines(state.keep(edges), state)
    scored = state.keep(path_scores(line, state))
    total = scored.groupBy("path", "variant").agg(F.max("keep").alias("total"))
    best = total.groupBy("path").agg(F.max_by("variant", F.struct("total", -F.col("variant"))).alias("variant"))
    pick = chosen(scored, state).join(best, ["path", "variant"])
    return state.keep(pick.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
