"""Mixing sources to target weights: whole copies first, then Pareto order sampling of the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshwork.llm.scratch import Scratch

#: Fixed values of the contract: the weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: About so many documents share a bin of the order.
PER_BIN = 1000
#: A source whose draw lacks no more than this share of its target is full.
NEAR = 1e-4
SPACE = "[\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """The number of runs of bytes that aren't white space (null: 0); the empty parts are at the text's ends."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, SPACE), "")).cast("long")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with their place in code-point order, null last, without a window over all of them."""
    ordered = sources.sort(F.col("source").asc_nulls_last())
    return sources.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), "source string, source_size long, place long")


def targets(sources: DataFrame, scratch: Scratch, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) by water-filling: what targets above `most` times the size leave is shared by weight
    among the others, until none is above. Each round is one aggregate of one row over the table of sources."""
    ranked = _ranked(sources, scratch)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = scratch.save(ranked.select("source", "source_size", w.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    level, total = -1.0, None
    full = lambda lv: F.col("weight") * lv > F.col("cap")
    while True:
        got = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(full(level), F.col("cap")).otherwise(0.0)).alias("fixed"), F.sum(F.when(full(level), 0.0).otherwise(F.col("weight"))).alias("free")).first()
        total = (got["all"] or 0) * share
        now = max(level, (total - got["fixed"]) / got["free"]) if got["free"] else level
        if now == level:
            break
        level = now
    return table.select("source", "source_size", F.when(full(level), F.col("cap")).otherwise(F.col("weight") * max(level, 0.0)).alias("target"))


def _scanned(left: Column, rows: Column) -> Column:
    """Of the rows (__u, size) of a bin, those taken in order while they fit, as (left, drawn places)."""
    placed = F.transform(F.sort_array(rows), lambda x, i: F.struct((i + 1).alias("place"), x["size"].alias("size")))
    start = F.struct(left.cast("double").alias("left"), F.array().cast("array<int>").alias("drawn"))
    fits = lambda acc, x: (x["size"] > 0) & (x["size"] <= acc["left"])
    return F.aggregate(placed, start, lambda acc, x: F.when(fits(acc, x), F.struct((acc["left"] - x["size"]).alias("left"), F.concat(acc["drawn"], F.array(x["place"])).alias("drawn"))).otherwise(acc))


def _drawn_bins(lean: DataFrame, lacks: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(__source, __bin, most, places): what is drawn of a bin if a source's documents are gone through in order and each that fits in
    what the source still lacks is taken: all documents of at most `most` words, or those at `places` of a bin in which some don't fit.

    A round passes over all bins up to the first where the documents that fit one by one don't fit together; this bin is gone
    through row by row, and the next round starts behind it with what is left, until that is less than `__near`. lacks: (__s, __left, __near, __from).
    """
    state, parts = scratch.save(lacks.where("__left >= __near"), "lacks"), []
    while not state.isEmpty():
        met = lean.join(state, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bin") >= F.col("__from")) & (F.col("size") > 0) & (F.col("size") <= F.col("__left")))
        ahead = Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        words = met.groupBy("__source", "__bin").agg(F.sum("size").alias("words"), F.first("__left").alias("most"), F.first("__near").alias("near"))
        words = words.withColumn("left", F.col("most") - F.coalesce(F.sum("words").over(ahead), F.lit(0))).where("left >= 0")
        reached = scratch.save(words, "reached")
        last = reached.where("words > left").select(F.col("__source").alias("__s"), F.col("__bin").alias("__b"), "left", "near")
        rows = lean.join(last, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b")))
        rows = rows.groupBy("__source", "__bin").agg(F.first("left").alias("left"), F.first("near").alias("near"), F.collect_list(F.struct("__u", "size")).alias("rows"))
        gone = scratch.save(rows.select("__source", "__bin", "near", _scanned(F.col("left"), F.col("rows")).alias("got")).select("__source", "__bin", "near", "got.left", "got.drawn"), "gone")
        parts.append(reached.where("words <= left").select("__source", "__bin", "most", F.lit(None).cast("array<int>").alias("places")))
        parts.append(gone.select("__source", "__bin", F.lit(None).cast("double").alias("most"), F.col("drawn").alias("places")))
        state = gone.where("left >= near").select(F.col("__source").alias("__s"), F.col("left").alias("__left"), "near", (F.col("__bin") + 1).alias("__from")).withColumnRenamed("near", "__near")
    return reduce(DataFrame.unionByName, parts) if parts else None


def _cuts(lean: DataFrame, bins: DataFrame, table: DataFrame, scratch: Scratch) -> DataFrame:
    """(__s, __b, source_size, target, most, places, last): what is drawn of each bin, `last` being the place of the source's closing text."""
    given = table.select(F.col("source").alias("__s"), "source_size", "target")
    drawn = _drawn_bins(lean, given.select("__s", (F.col("target") - _whole() * F.col("source_size")).alias("__left"), F.greatest(F.lit(1.0), F.col("target") * NEAR).alias("__near"), F.lit(-(2**62)).cast("long").alias("__from")), scratch)
    if drawn is None:
        drawn = bins.select("__source", "__bin", F.lit(None).cast("double").alias("most"), F.lit(None).cast("array<int>").alias("places")).limit(0)
    names = lambda t: t.withColumnsRenamed({"__source": "__s", "__bin": "__b"})
    same = F.col("__source").eqNullSafe(F.col("__s"))
    plan = scratch.save(bins.select("__source", "__bin").join(names(drawn), same & (F.col("__bin") == F.col("__b")), "left").select("__source", "__bin", "most", "places"), "plan")
    placed = lean.withColumn("__place", F.row_number().over(Window.partitionBy("__source", "__bin").orderBy("__u", "size")))
    flagged = placed.join(names(plan), same & (F.col("__bin") == F.col("__b"))).withColumn("drawn", _drawn())
    rest = F.when(~F.col("drawn") & (F.col("size") > 0), F.struct("size", "__u", "__bin", "__place"))
    ends = flagged.groupBy("__source").agg(F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0)).alias("words"), F.min(rest).alias("least"))
    ends = ends.join(given, same).withColumn("left", F.col("target") - _whole() * F.col("source_size") - F.col("words"))
    ends = ends.select("__s", "source_size", "target", F.when((F.col("left") > 0) & (F.col("least.size") / 2 <= F.col("left")), F.col("least")).alias("least"))
    last = F.when(F.col("least.__bin") == F.col("__bin"), F.col("least.__place"))
    cuts = plan.join(ends, same).select(F.col("__source").alias("__s"), F.col("__bin").alias("__b"), "source_size", "target", "most", "places", last.alias("last"))
    return scratch.save(cuts, "cuts")


def _drawn() -> Column:
    by_size = (F.col("size") > 0) & (F.col("size") <= F.col("most"))
    return F.coalesce(by_size, F.lit(False)) | F.coalesce(F.array_contains("places", F.col("__place")), F.lit(False))


def _whole() -> Column:
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return F.floor(ratio + 1e-12).cast("long")


def size_class(size: Column) -> Column:
    """How often a size can be halved: 64 classes at most."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double")) + 1e-9)).otherwise(0).cast("int")


def inclusion(classes: DataFrame, table: DataFrame) -> DataFrame:
    """(__os, __oc, __p, __r) for each source and size class: the probability that a document is drawn beyond its certain copies, and the factor that its random
    odds get. classes: (__source, __class, words); table: targets.

    Probabilities are in proportion to 1 + class / 8, which longer documents get more of, up to 1, so that the expected words are what the source lacks: with
    the classes in falling order, the first level that needn't lift the class at hand above 1 is the right one. The factor is the odds of the source's mean probability over those
    of the class, so ranks spread over (0, 1).
    """
    given = table.select(F.col("source").alias("__s"), "source_size", (F.col("target") - _whole() * F.col("source_size")).alias("lack"))
    own = classes.join(given, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("w", 1 + F.col("__class") / 8)
    falling = Window.partitionBy("__source").orderBy(F.desc("__class"))
    first = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("words")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("level", F.when(rest > 0, (F.col("lack") - first) / rest))
    level = F.max_by(F.when((F.col("level") > 0) & (F.col("level") * F.col("w") <= 1), F.col("level")), F.when((F.col("level") > 0) & (F.col("level") * F.col("w") <= 1), F.col("__class"))).over(Window.partitionBy("__source"))
    p = F.least(F.lit(1.0), F.coalesce(level, F.lit(0.0)) * F.col("w"))
    mean = F.when(F.col("source_size") > 0, F.col("lack") / F.col("source_size")).otherwise(0.0)
    factor = F.when((p >= 1) | (mean <= 0) | (p <= 0), F.when(p >= 1, 0.0).otherwise(1.0)).otherwise((mean / (1 - mean)) * ((1 - p) / p))
    return own.select(F.col("__source").alias("__os"), F.col("__class").alias("__oc"), p.alias("__p"), factor.alias("__r"))


def mix_sources(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 7, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """Adds size (words), source_size, target (of the source), copies and taken (copies * size).

    Each document gets the whole part of target / source_size as certain copies. The rest is drawn by Pareto order sampling: a document's inclusion probability p grows
    with the logarithm of its size (`inclusion`); with u uniform from a hash of id and text, documents of a source are gone through in the order of
    (u/(1-u)) / (p/(1-p)), those of p = 1 first. Each that fits in the words that the source still lacks is taken, longer
    ones are set aside, until the source lacks less than NEAR of its target; at the end the shortest one left is added if at least half of it fits. So a source misses its target by NEAR of it, or half of its
    shortest text that wasn't drawn, at most. The order is cut into bins of about PER_BIN documents, so no source is ever in one task.
    Reruns give the same; null ids and
    sources are values like others (null source last); a null text has size 0 and is never drawn beyond the certain copies; repeated rows are drawn
    each for itself, ties in any order; columns of the names above are replaced, all others are kept, whatever their names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    bins = max(1, docs.count() // PER_BIN)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "text"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    carried = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    # carried columns get names of their own, so that none can clash with the operator's
    own = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carried)], F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").cast("string").alias("__source"))
    own = own.withColumn("size", n_words(F.col("text"))).withColumn("__class", size_class(F.col("size"))).withColumn("__t", u).drop("text")
    sizes = scratch.save(own.select("__source", "__class", "__t", "size"), "sizes")
    classes = scratch.save(sizes.groupBy("__source", "__class").agg(F.sum("size").alias("words")), "classes")
    sources = classes.groupBy(F.col("__source").alias("source")).agg(F.sum("words").cast("long").alias("source_size"))
    table = scratch.save(targets(sources, scratch, share, most, weights), "targets")
    odds = scratch.save(inclusion(classes, table), "odds")
    lean = scratch.save(_ordered(sizes, odds, bins).select("__source", "__bin", "__u", "size"), "order", [sizes])
    by_bin = scratch.save(lean.groupBy("__source", "__bin").agg(F.sum("size").alias("words")), "bins")
    cuts = _cuts(lean, by_bin, table, scratch)
    met = _ordered(own, odds, bins).join(cuts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b")))
    met = met.withColumn("__place", F.row_number().over(Window.partitionBy("__source", "__bin").orderBy("__u", "size", "id")))
    drawn = _drawn() | F.coalesce(F.col("__place") == F.col("last"), F.lit(False))
    out = met.withColumn("copies", _whole() + drawn.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carried)], "size", "source_size", "target", "copies", "taken")


def _ordered(rows: DataFrame, odds: DataFrame, bins: int) -> DataFrame:
    """Adds __u, the rank: random odds over inclusion odds, brought to (0, 1) by the odds' own share, or below 0 for what is certain; and __bin, its bin. The
    table of odds has a row for each source and class; Spark sends it to all tasks only below its own limit, else both are shuffled."""
    met = rows.join(odds, F.col("__source").eqNullSafe(F.col("__os")) & (F.col("__class") == F.col("__oc"))).drop("__os", "__oc")
    t, r = F.col("__t"), F.col("__r")
    rank = F.when(F.col("__p") >= 1, t - 1).otherwise(t * r / (1 - t + t * r))
    return met.withColumn("__u", rank).withColumn("__bin", F.floor(F.col("__u") * bins).cast("long")).drop("__t", "__p", "__r", "__class")
