"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

1. Each different text becomes its set of coded five-word shingles; texts with equal sets are one class, its representative the one
   of smallest id.
2. A representative has a label of DEPTH MinHash values in each tree. A tree is the prefix trie of its labels: they are range-partitioned
   and sorted, and what neighbours share is the trie. Every pair of neighbours with a prefix of at least the floor's length is written with that length; texts below one
   node of any depth are then a chain of such pairs.
3. Matched prefixes are shortened from the full depth on until the target recall is reached, which is reckoned from the similarities of all
   neighbours, counted on the cluster; the floor is the depth that reaches it if all pairs were just at the threshold.
4. Chains of all trees are joined to components (never listing all pairs of a node). A component's members are dealt to tiles of bounded size and each
   tile verifies its pairs exactly, by products of 0/1 matrices over the shingles that occur twice; links are counted there, not listed.
5. Verified links are joined to classes of near-duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshwork.llm.components import components
from meshwork.llm.repeats import LAST, distinct_texts, key_of, key_of_table, order_of
from meshwork.llm.scratch import Scratch, n_parts
from meshwork.llm.textbytes import NOT_SPACE, U, blocks, run_lanes, signed, within, word_lanes, words

N, LEAST, TREES, DEPTH, RECALL, TILE = 5, 0.8, 32, 8, 0.9999, 128
COLUMNS = 8192


def recall_at(depth: int, similarity, trees: int):
    """The probability that a pair of this similarity shares a prefix of `depth` in some tree."""
    return 1 - (1 - np.asarray(similarity, np.float64) ** depth) ** trees


def depth_for(least: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix with which a pair of similarity `least` meets in some tree with probability `recall`."""
    return max((d for d in range(1, depth + 1) if recall_at(d, least, trees) >= recall), default=1)


def shortened(similarity: np.ndarray, least: float, trees: int, depth: int, floor: int, recall: float, many: np.ndarray | None = None) -> int:
    """The longest prefix at which the expected share of the pairs found is `recall`, from the pairs met at the floor, `many` of each similarity: each
    stands for as many pairs as its chance to be met there says. Without similar pairs it is the floor."""
    similar = similarity >= least
    pairs = similarity[similar]
    if not len(pairs):
        return floor
    weight = (1 if many is None else many[similar]) / recall_at(floor, pairs, trees)
    return max((d for d in range(floor, depth + 1) if (weight * recall_at(d, pairs, trees)).sum() >= recall * weight.sum()), default=floor)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle codes of each text, one after another, with a second code of each, and the texts' offsets. A text of 1 to n-1 words has one
    shingle, all of it."""
    start, end, first = words(data, off, NOT_SPACE)
    lanes = word_lanes(data, start, end, key)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), np.maximum(0, count - n + 1))
    at = first[row] + within(np.maximum(0, count - n + 1))
    code, second = (x[at] if len(at) else np.zeros(0, U) for x in run_lanes(lanes, n))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        few = [[x[0] ^ U(int(count[i])) for x in run_lanes((lanes[0][first[i] : first[i + 1]], lanes[1][first[i] : first[i + 1]]), int(count[i]))] for i in short.tolist()]
        row = np.concatenate([row, short])
        code, second = (np.concatenate([x, np.array([f[j] for f in few], U)]) for j, x in enumerate((code, second)))
    order = np.lexsort((code, row))
    code, second, row = code[order], second[order], row[order]
    if len(code):
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
        code, second, row = code[new], second[new], row[new]
    return code, second, np.searchsorted(row, np.arange(len(count) + 1))


def _signatures(n: int, trees: int, depth: int, key: int):
    """For each text the number of its shingles, a 128-bit digest of the set, and the labels: trees x depth values of 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(43))
        turns = rng.integers(0, 2**31, trees * depth).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        salts = rng.integers(0, 2**32, trees * depth).astype(np.uint32)
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column("text")):
                code, second, cut = shingle_sets(data, off, n, key)
                size = np.diff(cut)
                some = np.flatnonzero(size)
                labels = np.zeros((hi - lo, trees * depth), np.uint16)
                if len(some):
                    low, begin = (code >> U(32)).astype(np.uint32), cut[some]
                    for i, (salt, turn) in enumerate(zip(salts, turns, strict=True)):
                        # the low bits of the least value
                        labels[some, i] = np.minimum.reduceat((low ^ salt) * turn, begin)
                sets = [hashlib.blake2b(code[a:b].tobytes() + second[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x).slice(lo, hi - lo) for x in ("k", "c", "ord", "copies")] + [pa.array(size), pa.array(sets, pa.binary()), pa.array([x.tobytes() for x in labels], pa.binary())],
                    names=["k", "c", "ord", "copies", "n", "set", "labels"],
                )

    return run


def _forest(trees: int, depth: int):
    """A row for each tree: its number, the label as two numbers, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = np.frombuffer(b"".join(batch.column("labels").to_pylist()), np.uint16).reshape(m, trees, depth)
            wide = np.zeros((m, trees, 8), np.uint64)
            wide[:, :, : min(depth, 8)] = x[:, :, :8]
            high = wide[:, :, 0] << U(48) | wide[:, :, 1] << U(32) | wide[:, :, 2] << U(16) | wide[:, :, 3]
            low = wide[:, :, 4] << U(48) | wide[:, :, 5] << U(32) | wide[:, :, 6] << U(16) | wide[:, :, 7]
            k = np.asarray(batch.column("k"), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), m)), pa.array(signed(high.ravel())), pa.array(signed(low.ravel())), pa.array(np.repeat(k, trees))], names=["tree", "high", "low", "k"])

    return run


#: shared: length of the common prefix; rows at the ends of a partition (shared null) carry their label.
TRIE = "u long, v long, shared int, tree int, high long, low long"


def _shared(a_high, a_low, b_high, b_low) -> np.ndarray:
    """How many values of 16 bits two labels have in common from the front."""
    def front(x):
        return (x >> U(48) == 0).astype(np.int32) + (x >> U(32) == 0) + (x >> U(16) == 0) + (x == 0)

    high, low = (a_high ^ b_high).view(U), (a_low ^ b_low).view(U)
    return np.where(high == 0, 4 + front(low), front(high)).astype(np.int32)


def _trie(floor: int):
    """Neighbours of a sorted partition that share a prefix of the floor's length or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None

        def end(t, i):
            return pa.RecordBatch.from_arrays([pa.array([int(t["k"][i])]), pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([int(t["tree"][i])], pa.int32()), pa.array([int(t["high"][i])]), pa.array([int(t["low"][i])])], names=[x.split()[0] for x in TRIE.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = {x: batch.column(x).to_numpy() for x in batch.schema.names}
            if last is None:
                yield end(t, 0)
            else:
                t = {x: np.concatenate([last[x], t[x]]) for x in t}
            last = {x: t[x][-1:] for x in t}
            same = _shared(t["high"][1:], t["low"][1:], t["high"][:-1], t["low"][:-1])
            keep = np.flatnonzero((t["tree"][1:] == t["tree"][:-1]) & (same >= floor))
            a, b = t["k"][keep], t["k"][keep + 1]
            none = pa.nulls(len(keep), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(same[keep]), pa.nulls(len(keep), pa.int32()), none, none], names=[x.split()[0] for x in TRIE.split(", ")])
        if last is not None:
            yield end(last, 0)

    return run


def _across(ends: list, floor: int) -> list[tuple[int, int, int]]:
    """Links between the labels at the ends of partitions, two for each, in the order of the trie."""
    rows = sorted((r["tree"], r["high"], r["low"], r["u"]) for r in ends)
    out = []
    for x, y in zip(rows, rows[1:], strict=False):
        if x[0] == y[0] and x[3] != y[3]:
            n = int(_shared(*(np.array([v], np.int64) for v in (*x[1:3], *y[1:3])))[0])
            if n >= floor:
                out.append((max(x[3], y[3]), min(x[3], y[3]), n))
    return out


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For how many pairs how many values of their labels agree."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("of_u", "of_v"))
            same, many = np.unique((a == b).sum(1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(same, pa.int64()), pa.array(many, pa.int64())], names=["same", "many"])


def _sets(n: int, key: int):
    """A row with the text's shingles for each tile that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, chunk, chunks, root = (batch.column(c).to_pylist() for c in ("k", "chunk", "chunks", "root"))
            for lo, hi, data, off in blocks(batch.column("text")):
                code, _, cut = shingle_sets(data, off, n, key)
                out, size = [], 0
                for i in range(lo, hi):
                    own = code[cut[i - lo] : cut[i - lo + 1]].tobytes()
                    for j in range(chunks[i]):
                        out.append((root[i], min(chunk[i], j), max(chunk[i], j), k[i], chunk[i], own))
                        size += len(own)
                        if size > 4_000_000:
                            yield _tiles(out)
                            out, size = [], 0
                if out:
                    yield _tiles(out)

    return run


def _tiles(out: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["root", "a", "b", "k", "chunk", "shingles"])


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets: a product of 0/1 matrices over the elements that occur twice, some columns at a time."""
    n = len(sets)
    if n == 2:
        got = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), got], [got, len(sets[1])]], np.float64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    col = np.cumsum(new) - 1
    twice = np.bincount(col) > 1
    keep = twice[col]
    col, row = (np.cumsum(twice) - 1)[col[keep]], row[keep]
    out = np.zeros((n, n))
    for a in range(0, int(twice.sum()), COLUMNS):
        i, j = np.searchsorted(col, [a, a + COLUMNS])
        x = np.zeros((n, COLUMNS), np.float32)
        x[row[i:j], col[i:j] - a] = 1
        out += x @ x.T
    return out


def verified(k: list[int], chunk: list[int], sets: list[np.ndarray], cross: bool, least: float) -> tuple[list[int], list[int]]:
    """For each member of a tile the number of its links in it, and the smallest member that links join it to. A cross tile counts
    the links between its two chunks only."""
    n = len(k)
    size = np.array([len(s) for s in sets], np.float64)
    both = common(sets)
    linked = both >= least * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if cross:
        part = np.asarray(chunk)
        linked &= part[:, None] != part[None, :]
    root = np.asarray(k, np.int64)
    if linked.any():
        while True:
            new = root.copy()
            i, j = np.nonzero(linked)
            np.minimum.at(new, i, root[j])
            if (new == root).all():
                break
            root = new
    return linked.sum(1).tolist(), root.tolist()


def _verify(least: float):
    """Tiles of a sorted partition, one after another."""

    def done(key, rows):
        own = {r[0]: r for r in rows}
        if len(own) < 2 or (key[1] != key[2] and len({r[1] for r in own.values()}) < 2):
            return []
        k = sorted(own)
        links, root = verified(k, [own[x][1] for x in k], [np.frombuffer(own[x][2], np.uint64) for x in k], key[1] != key[2], least)
        return [x for x in zip(k, root, links, strict=True) if x[2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def flush():
            cols = list(zip(*out, strict=True))
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k", "root", "links"])
            out.clear()
            return got

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("root", "a", "b", "k", "chunk", "shingles")), strict=True):
                if r[:3] != key:
                    out.extend(done(key, rows) if rows else [])
                    key, rows = r[:3], []
                rows.append(r[3:])
            if len(out) > 5000:
                yield flush()
        out.extend(done(key, rows) if rows else [])
        if out:
            yield flush()

    return run


def candidates(signatures: DataFrame, least: float, trees: int, depth: int, recall: float, scratch: Scratch) -> DataFrame:
    """(node, root): components of the texts that share a prefix, long enough for the target recall, in some tree. signatures: (k, labels)."""
    spark = signatures.sparkSession
    floor = depth_for(least, trees, depth, recall)
    rows = scratch.save(signatures.select("k", "labels").mapInArrow(_forest(trees, depth), "tree int, high long, low long, k long"), "labels")
    sort = ["tree", "high", "low", "k"]
    ordered = rows.repartitionByRange(n_parts(spark), *sort).sortWithinPartitions(*sort)
    trie = scratch.save(ordered.mapInArrow(_trie(floor), TRIE), "trie", [rows])
    ends = trie.where("shared is null").select("tree", "high", "low", "u").collect()  # two rows for each partition
    links = trie.where("shared is not null").select("u", "v", "shared")
    across = _across(ends, floor)
    if across:
        links = links.unionByName(spark.createDataFrame(across, "u long, v long, shared int"))
    links = scratch.save(links.groupBy("u", "v").agg(F.max("shared").alias("shared")), "neighbours", [trie])
    labels = lambda at: signatures.select(F.col("k").alias(at), F.col("labels").alias("of_" + at)).hint("merge")
    met = links.select("u", "v").join(labels("u"), "u").join(labels("v"), "v").select("of_u", "of_v")
    alike = met.mapInArrow(_alike, "same long, many long").groupBy("same").agg(F.sum("many").alias("many")).toArrow()  # trees * depth + 1 rows at most
    d = shortened(alike["same"].to_numpy() / (trees * depth), least, trees, depth, floor, recall, alike["many"].to_numpy())
    return scratch.save(components(links.where(F.col("shared") >= d).select("u", "v"), scratch), "candidates", [links])


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, least: float = LEAST, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_shingles, copy_of, n_copies, class_id, n_links, first, text_key), a row for each row of `docs`.

    copy_of: smallest id among the texts of equal shingle set; n_copies: how many rows hold these; n_links: how many other
    sets are similar (Jaccard >= least); class_id: smallest id of all that similar pairs join, copies included; first: whether the row comes first in its
    class by id, then by text; text_key: 16 bytes of the text's SHA-256, for joining back. A text without words (null too) is alone: its own class, no
    copies; one of fewer than n words has itself as its only shingle. Null ids count as the largest, so class_id is null only if all ids are;
    rows repeated with the same id and text are copies, all of them first if one is. Other columns, whatever their names, play no part.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = distinct_texts(docs, text, doc_id, scratch)
    key = key_of_table(texts)
    every = scratch.save(texts.mapInArrow(_signatures(n, trees, depth, key), "k long, c binary, ord long, copies long, n long, set binary, labels binary"), "signatures")
    same = every.where("n > 0").groupBy("set").agg(F.min(F.struct("ord", "k")).alias("r"), F.sum("copies").alias("n_copies"))
    reps = scratch.save(same.select("set", F.col("r.k").alias("rep"), F.col("r.ord").alias("copy_of"), "n_copies"), "representatives")
    # one text of each class carries its labels on
    maybe = candidates(every.join(reps.select(F.col("rep").alias("k")).hint("merge"), "k", "left_semi"), least, trees, depth, recall, scratch)
    sizes = maybe.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    dealt = maybe.join(scratch.save(sizes, "sizes"), "root").select(F.col("node").alias("k"), "root", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    sets = texts.select("k", "text").join(scratch.save(dealt, "dealt").hint("merge"), "k").mapInArrow(_sets(n, key), "root long, a int, b int, k long, chunk int, shingles binary")
    tiles = sets.repartition(n_parts(spark), "root", "a", "b").sortWithinPartitions("root", "a", "b")
    links = scratch.save(tiles.mapInArrow(_verify(least), "k long, root long, links long"), "links", [texts])
    classes = components(links.select(F.col("k").alias("u"), F.col("root").alias("v")), scratch)
    counts = links.groupBy("k").agg(F.sum("links").alias("n_links"))
    found = reps.join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left").join(counts.withColumnRenamed("k", "rep"), "rep", "left")
    found = scratch.save(found.select("set", "copy_of", "n_copies", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "rep"), "found")
    heads = found.groupBy("root").agg(F.min(F.struct(F.col("copy_of").alias("ord"), F.col("rep").alias("k"))).alias("head"))
    found = found.join(scratch.save(heads, "heads"), "root").select("set", "copy_of", "n_copies", "n_links", F.col("head.ord").alias("class_id"), F.col("head.k").alias("head"))
    told = every.select("k", "c", "n", "set").join(found, "set", "left").select("c", "n", "copy_of", "n_copies", "n_links", "class_id", (F.col("head") == F.col("k")).alias("is_head"))
    told = scratch.save(told, "classes")
    rows = docs.select(order_of(F.col(f"`{doc_id}`")).alias("ord"), key_of(F.col(f"`{text}`")).alias("c"))
    out = rows.join(told, "c")
    null = lambda c: F.when(c != LAST, c)
    alone = F.col("n") == 0
    or_own = lambda c, own: F.when(alone, own).otherwise(F.col(c))
    return out.select(
        null(F.col("ord")).alias(doc_id), F.col("n").alias("n_shingles"), null(or_own("copy_of", F.col("ord"))).alias("copy_of"), or_own("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        null(or_own("class_id", F.col("ord"))).alias("class_id"), or_own("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("is_head") & (F.col("ord") == F.col("class_id")))).alias("first"), F.col("c").alias("text_key"),
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs` that come first in their class, with all their columns; of rows repeated with the same id and text, one. Rows without words all stay."""
    kept = jaccard_join(docs, text, doc_id, **how).where("first and n_shingles > 0").groupBy("text_key").agg(F.min(order_of(F.col(f"`{doc_id}`"))).alias("head"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key_of(F.col(f"`{text}`")).alias("c"), order_of(F.col(f"`{doc_id}`")).alias("ord"), F.col(f"`{text}`").alias("text"))
    empty = F.coalesce(F.length(F.regexp_replace(F.col("text"), "[\\x20\\x09-\\x0D]", "")), F.lit(0)) == 0
    match = (F.col("c") == F.col("text_key")) & (F.col("ord") == F.col("head"))
    rest = keyed.where(~empty).join(kept.hint("merge"), match, "left_semi").groupBy("c").agg(F.first("row").alias("row"))
    return rest.select("row.*").unionByName(keyed.where(empty).select("row.*"))
