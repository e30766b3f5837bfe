"""Words built to share a code, at one and at several partitions; single inputs that earlier versions got wrong."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm.ann import ann
from meshwork.llm.exact_topk import exact_topk
from meshwork.llm.jaccard_join import jaccard_join, keep_first
from meshwork.llm.packing import pack
from meshwork.llm.rlz_dedup import rlz_dedup
from meshwork.llm.textbytes import U, mix, range_codes, word_lanes
from meshwork.llm.url_filter import url_filter

DOCS = "doc_id long, text string"


def colliding(seed: int) -> tuple[str, str]:
    """Two words of 16 letters with one code of `range_codes`: the second eight bytes undo what the first differ in."""
    rng, printable = random.Random(seed), bytes(range(0x21, 0x7F))
    first = bytes(rng.choice(printable) for _ in range(16))
    step = lambda code, chunk, i: mix((code ^ chunk) * U(0xD6E8FEB86659FD93) + U(i + 1))
    begin = mix(np.array([16], np.int64).astype(U) + U((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64))
    a, b = (np.frombuffer(first[i : i + 8], "<u8") for i in (0, 8))
    want = step(begin, a, 0) ^ b
    other = np.array([bytes(rng.choice(printable) for _ in range(8)) for _ in range(60000)], "S8").view("<u8")
    rest = step(begin, other, 0) ^ want
    for x, y in zip(other, rest, strict=True):
        second = x.tobytes() + y.tobytes()
        if all(c in printable for c in second) and second != first:
            return first.decode(), second.decode()
    raise AssertionError("none found")


def pairs(seed):
    known = {41: ("P7ZVRhpZu0kv8FZL", "vUArpB5V[(][c@8#"), 13: ("31Y1eY6qkeX6LMWa", "ylA5UjtF:&Y`TI*'")}
    got = [known[seed], colliding(seed)]
    for p, q in got:
        data = np.frombuffer((p + q).encode(), np.uint8)
        at = np.array([0, 16]), np.array([16, 32])
        a, b = range_codes(data, *at, seed)
        x, y = word_lanes(data, *at, seed)
        assert a == b and x[0] != x[1] and y[0] != y[1]
    return got


@pytest.mark.parametrize("parts", ["1", "4"])
def test_unlike_texts_stay(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for p, q in pairs(41):
            df = spark.createDataFrame([(1, f"{p} a b c d e f g"), (2, f"{q} a b c d e f g"), (3, p), (4, q)], DOCS)
            assert all((r["n_copies"], r["copy_of"], r["class_id"], r["n_links"]) == (1, r["doc_id"], r["doc_id"], 0) for r in jaccard_join(df).collect())
            assert keep_first(df).count() == 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", ["1", "4"])
def test_the_right_holder_is_asked(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for a, b in pairs(13):
            rows = [(1, f"{b} " * 13 + "one"), (2, f"{a} " * 13 + "two"), (3, f"{a} " * 13 + "three"), (4, f"{b} " * 7 + f"{a} " * 7)]
            got = {r["doc_id"]: r["n_removed"] for r in rlz_dedup(spark.createDataFrame(rows, DOCS)).collect()}
            assert got == {1: 0, 2: 0, 3: 13, 4: 0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_large_component(spark):
    rows = [(0, [1e8, 0.0]), (1, [1.0, 2.0]), (2, [0.5, 0.25]), (50, [0.1, 0.2]), (51, [-1e15, 0.0])] + [(i, [i / 8, 1.0]) for i in range(3, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk(df, df.where("vec_id in (0, 50)")).collect()]
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    score = lambda a, b: sum(p * q for p, q in zip(x[a], x[b], strict=True))
    for q in (0, 50):
        want = sorted((-score(q, j), j) for j in x if j != q)[:5]
        assert [(v, s) for a, _, v, s in sorted(got) if a == q] == [(j, -s) for s, j in want]


@pytest.mark.parametrize("search", [ann, exact_topk])
def test_vectors_of_several_lengths(spark, search):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(2 if i < 30 else 3).tolist()) for i in range(50)] + [(100, [1.0, 2.0, 3.0]), (200, [1.0]), (300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = search(df, df.where("vec_id % 20 = 0")).collect()
    k = 20 if search is ann else 5
    sizes = {i: len(v) for i, v in rows}
    for q in (0, 20, 40, 100):
        mine = [r["vec_id"] for r in out if r["query_id"] == q]
        assert len(mine) == min(k, sum(n == sizes[q] for n in sizes.values()) - 1) and {sizes[v] for v in mine} == {sizes[q]}
    assert not [r for r in out if r["query_id"] in (200, 300)]


@pytest.mark.parametrize(("n", "clusters"), [(9000, 0), (6000, 30)])
def test_recall_of_windows(spark, n, clusters):
    """Above one block: uniform vectors, where a window is most of an ordering, and clusters, where it is a small part."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 16))
    if clusters:
        x = rng.standard_normal((clusters, 16))[rng.integers(0, clusters, n)] * 3 + x * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann(df, df.where("vec_id % 100 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, n, 100):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.9 * 20 * len(range(0, n, 100))


def test_rows_without_ids_are_spread(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("one two "), F.col("id")).alias("text"))
    out = pack(rows)
    assert out.count() == 30_000 and out.select("batch", "slot").distinct().count() == 30_000


def test_columns_of_any_name(spark):
    names = ["__key", "a.b", "row", "c0", "host", "rule", "word"]
    pages = spark.createDataFrame([(1, "https://x.example.org/es/1"), (2, None)], "page_id long, url string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = url_filter(pages)
    assert set(pages.columns) <= set(out.columns) and {(r["__key"], r["a.b"], r["row"]) for r in out.collect()} == {(0, 1, 2)}
    rule = {r["page_id"]: (r["host"], r["rule"]) for r in out.collect()}
    assert rule == {1: ("x.example.org", "example.org/es/"), 2: ("", None)}
