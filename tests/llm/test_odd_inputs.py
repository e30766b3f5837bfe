"""Texts made to collide, very long ones, many repeated rows, clashing names, ties, empty tables."""

import random
import re

import numpy as np
import pytest
from brute import SPACE, by_id, jaccard, rlz, sha, suffix
from pyspark.sql import functions as F

import corpus_pipeline
from meshwork.llm import license_scan as licences, quality, queries, rlz_dedup as lz, suffix_dedup as sa
from meshwork.llm.ann import ann
from meshwork.llm.exact_topk import exact_topk
from meshwork.llm.jaccard_join import jaccard_join, keep_first, shortened
from meshwork.llm.mixing import mix_sources
from meshwork.llm.packing import best_bounds, pack
from meshwork.llm.rlz_dedup import rlz_dedup
from meshwork.llm.suffix_dedup import multikey_sort, suffix_dedup
from meshwork.llm.url_filter import Automaton, url_filter

DOCS = "doc_id long, text string"


def removed(out):
    return [(r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept"].encode())) for r in out.collect()]


def cut_bytes(out):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) for r in out.collect()]


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_polynomial_hash_are_told_apart(spark):
    """A word of 1,024 letters and its complement, which collide modulo 2^64 under any odd base."""
    a, b = thue_morse(10)
    rows = [(1, f"{a} " * 13), (2, f"{a} " * 13), (3, f"{b} " * 13)]
    docs = spark.createDataFrame(rows, DOCS)
    assert by_id(removed(rlz_dedup(docs))) == by_id(rlz(rows, 13))
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join(docs).collect()]
    assert by_id(got) == by_id(jaccard(rows, 5, 0.8))
    assert by_id(cut_bytes(suffix_dedup(docs, width=40))) == by_id(suffix(rows, 40))


def passages(seed, n):
    rng = random.Random(seed)
    words = lambda m: [rng.choice("abcdefgh") for _ in range(m)]
    shared = [rng.choice("abcd") for _ in range(200)]
    rows = [(rng.randint(0, n), " ".join(words(rng.randint(0, 30)) + shared[rng.randint(0, 50) : rng.randint(60, 200)] + words(rng.randint(0, 30)))) for _ in range(n)]
    return rows + [(n + 7, "same " * 100)] * 20 + [(None, "same " * 90)] * 3


def test_few_references_in_a_block_and_hot_ones_held_several_times(spark, monkeypatch):
    monkeypatch.setattr(lz, "PER_BLOCK", 7)
    monkeypatch.setattr(lz, "PER_SALT", 20)
    rows = passages(5, 80)
    assert by_id(removed(rlz_dedup(spark.createDataFrame(rows, DOCS).repartition(3)))) == by_id(rlz(rows, 13))


def test_factors_name_their_reference(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(60))), (2, "x y " + " ".join(f"a{i}" for i in range(20, 50)) + " z"), (3, " ".join(f"a{i}" for i in range(10, 40)))]
    out = {r["doc_id"]: [(f["start"], f["end"], f["ref"], f["ref_start"]) for f in r["factors"]] for r in rlz_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: [], 2: [(2, 32, 1, 20)], 3: [(0, 30, 1, 10)]}


def test_long_runs_of_suffixes_are_cut_finer(spark, monkeypatch):
    monkeypatch.setattr(sa, "MOST", 3)
    monkeypatch.setattr(sa, "CHUNK", 10)
    rng = random.Random(5)
    common = "".join(rng.choice("abcd ") for _ in range(700))
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 300))) + common[rng.randint(0, 200) : rng.randint(300, 700)]) for i in range(60)]
    rows += [(900 + i, "a" * 3000 + str(i)) for i in range(3)] + [(800, "same " * 100)] * 20
    assert by_id(cut_bytes(suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(3)))) == by_id(suffix(rows, 200))


def test_multikey_sort():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    group = np.array([rng.randint(0, 3) for _ in texts])
    order, shared = multikey_sort(group, sa.as_words(texts, 30))
    padded = [t.ljust(32, b"\0") for t in texts]
    assert [(group[i], padded[i]) for i in order] == sorted(zip(group.tolist(), padded, strict=True))
    for a, b, n in zip(order, order[1:], shared[1:], strict=False):
        common = next((i for i in range(32) if padded[a][i] != padded[b][i]), 32)
        assert n == (common if group[a] == group[b] else 0)


def test_very_long_texts(spark):
    """One word of 1.5 MB, and a text of as many bytes that repeats a few words."""
    word, text = "x" * 1_500_000, "lorem ipsum dolor " * 80_000
    rows = [(1, text), (2, text[:1_200_000] + " end"), (3, "short"), (4, None), (5, word), (6, word[:1_200_000] + " end")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], DOCS + ", source string")
    n = {r[0]: len(SPACE.findall(r[1] or "")) for r in rows}
    out = {r["doc_id"]: r for r in rlz_dedup(docs).collect()}
    assert {i: r["n_words"] for i, r in out.items()} == n and out[1]["n_removed"] == out[5]["n_removed"] == 0 < out[2]["n_removed"]
    cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup(docs).collect()}
    assert cut[1] == (len(text), len(text)) and cut[3] == (5, 0) and cut[4] == (0, 0)
    assert cut[5] == (1_500_000, 1_500_000) and cut[6] == (1_200_004, 1_200_000)
    assert jaccard_join(docs).count() == licences.license_scan(docs).count() == mix_sources(docs).count() == 6
    assert pack(docs).agg(F.sum("length")).first()[0] == sum(n.values())


def test_many_repeated_rows(spark):
    """20,000 copies of one row, and as many of one text under different ids, cost no more than a pass over them."""
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(5).cast("long")).otherwise(F.col("id") + 10).alias("doc_id"), F.lit(text).alias("text"), F.lit("s").alias("source"))
    got = rlz_dedup(docs).groupBy("n_removed").count().collect()
    assert {(r["n_removed"], r["count"]) for r in got} == {(0, 20_000), (120, 20_000)}
    assert suffix_dedup(docs).where("n_removed = n_bytes").count() == 40_000
    assert jaccard_join(docs).where("n_copies = 40000 and class_id = 5").count() == 40_000


def test_names_that_operators_use_may_be_columns(spark):
    names = ["__text", "__k", "__spans", "row", "c", "k", "ord", "id", "own", "n_words", "kept", "spans", "size", "keep", "a.b"]
    base = spark.createDataFrame([(i, f"one two {i} " * 9, "s") for i in range(6)], DOCS + ", source string")
    docs = base.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    columns = set(docs.columns)
    assert columns <= set(rlz_dedup(docs).columns) and columns <= set(mix_sources(docs).columns)
    assert rlz_dedup(docs).count() == mix_sources(docs).count() == 6 and keep_first(docs).columns == docs.columns
    assert {r["__k"] for r in rlz_dedup(docs).select("__k").collect()} == {1} == {r["__k"] for r in mix_sources(docs).select("__k").collect()}
    model = quality.fit(docs, base.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("grade")))
    out = quality.classify(docs, model)
    assert columns <= set(out.columns) and out.select("`a.b`").first()[0] == 14


def test_ties_at_the_last_place_go_to_the_smaller_id(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, i / 500]) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for search, n in ((ann, 20), (exact_topk, 5)):
        got = sorted((r["rank"], r["vec_id"]) for r in search(df, df.where("vec_id = 0")).collect())
        assert got == [(i, i) for i in range(1, n + 1)]


def test_repeated_vectors_and_queries(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((60, 4)), 1)
    rows = [(i, x[i % 7].tolist() if i % 3 == 0 else x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>")
    out = ann(df, df.where("vec_id % 2 = 0")).collect()
    v = np.array([r[1] for r in rows])
    for q in range(0, 60, 2):
        s = np.einsum("ij,j->i", v, v[q])
        want = [j for j in sorted(range(60), key=lambda j: (-np.einsum("i,i->", v[j], v[q]), j)) if j != q][:20]
        got = [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(got) == 20 and np.allclose(s[got], s[want])


def test_threshold_algorithm_stops_on_skewed_vectors(spark):
    """A few large components: less than half of the vectors is scored; the result is exact."""
    rng = np.random.default_rng(0)
    n = 3000
    x = rng.standard_normal((n, 16)) * 0.01
    x[np.arange(n), rng.integers(0, 16, n)] += rng.pareto(1.5, n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    report: list = []
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk(df, df.where("vec_id % 50 = 0"), report=report).collect()}
    q = np.floor(256 * x).astype(np.int64)
    want = set()
    for i in range(0, n, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(n), -s)) if j != i][:5]
        want |= {(i, r + 1, int(j), int(s[j])) for r, j in enumerate(order)}
    assert got == want and sum(met * asked for _, met, asked in report) < 0.5 * n * (n // 50)


def test_large_components_stay_exact(spark):
    """Scores above 2^53, where doubles would tie; beyond 64 bits an error."""
    big = 2.0**20
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 3.0]), (2, [big, 2.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in sorted(exact_topk(df, df.where("vec_id = 0")).collect(), key=lambda r: r["rank"])]
    assert got == [(1, 2**56 + 3 * 2**16), (2, 2**56 + 2 * 2**16)]
    huge = spark.createDataFrame([(0, [1e18]), (1, [1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        exact_topk(huge, huge).collect()


def test_prefixes_are_shortened_to_the_recall():
    rng = np.random.default_rng(1)
    alike, mixed = np.full(100, 0.97), rng.uniform(0.8, 1, 100)
    assert shortened(alike, 0.8, 32, 8, 6, 0.9999) == 8 and shortened(np.full(9, 0.8), 0.8, 32, 8, 6, 0.9999) == 6
    assert 6 <= shortened(mixed, 0.8, 32, 8, 6, 0.9999) <= 8 and shortened(np.zeros(3), 0.8, 32, 8, 6, 0.9999) == 6


def test_recall_of_the_forest_on_many_near_copies(spark):
    """Texts with more and more words changed: links as by all pairs."""
    rng = random.Random(2)
    rows = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(80)]
        for c in range(6):
            t = list(base)
            for _ in range(c):
                t[rng.randrange(80)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(t)))
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join(spark.createDataFrame(rows, DOCS)).collect()]
    assert by_id(got) == by_id(jaccard(rows, 5, 0.8))


def test_any_number_of_grades(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(1000):
        t = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        for j in range(4 - i % 5):
            t[rng.randrange(len(t))] = f"bad{j}"
        texts.append((i, " ".join(t)))
    docs = spark.createDataFrame(texts, DOCS)
    model = quality.fit(docs, spark.createDataFrame([(i, i % 5) for i in range(700)], "doc_id long, grade int"))
    assert model.grades == 5 and (np.diff(model.thresholds) > 0).all()
    out = [r for r in quality.classify(docs, model).collect() if r["doc_id"] >= 700]
    assert np.corrcoef([r["expected_grade"] for r in out], [r["doc_id"] % 5 for r in out])[0, 1] > 0.5
    assert all(0 <= r["expected_grade"] <= 4 for r in out)


def test_inclusion_odds_differ_by_size(spark):
    """Beyond certain copies longer documents are drawn more often, and the source's target is met."""
    docs = spark.createDataFrame([(i, "x " * (4 if i % 2 else 64), "s") for i in range(8000)], DOCS + ", source string")
    out = mix_sources(docs, share=1.4)
    drawn = {r["size"]: r["share"] for r in out.groupBy("size").agg(F.avg(F.col("copies") - 1).alias("share")).collect()}
    assert drawn[64] > 1.2 * drawn[4] > 0.2
    got = out.agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("copies").alias("most")).first()
    assert abs(got["t"] - got["target"]) <= 4 and got["most"] <= 2


def test_globs_match_as_a_plain_matcher_does():
    rng = random.Random(6)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "."]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [""]
    raw = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = Automaton(globs).matches(np.frombuffer(raw, np.uint8), off)
    for j, g in enumerate(globs):
        tokens = re.findall(r"\*\*|\*|.", g)
        plain = re.compile("".join(".*" if t == "**" else "[^/]*" if t == "*" else re.escape(t) for t in tokens) + r"\Z", re.S)
        assert [bool(plain.match(t)) for t in texts] == got[:, j].tolist(), g


def test_packing_uses_the_best_bounds(spark):
    rng = random.Random(7)
    lengths = [rng.choice([1, 3, 4, 9, 10, 30, 31, 60]) for _ in range(300)]
    out = pack(spark.createDataFrame([(i, "x " * n) for i, n in enumerate(lengths)], DOCS), buckets=3).collect()
    bounds = best_bounds(sorted(set(lengths)), [lengths.count(x) for x in sorted(set(lengths))], 3)
    assert all(r["bucket"] == min(b for b in bounds if b >= r["length"]) for r in out)


def test_key_phrases_must_stand_at_their_places(spark):
    texts = ["permission is hereby granted to any person free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy", "license mit general license public", "cc0 1 0 cc0 1 0 universal"]
    out = {r["doc_id"]: r for r in licences.license_scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [out[i]["labels"] for i in range(4)] == ["", "mit", "", "cc0"]
    assert 0 < out[0]["score"] < 1 and 0 < out[1]["score"] < 1 and out[3]["score"] == 1.0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The tables of the queries, with rows and empty."""
    rng = random.Random(11)
    full, none = (str(tmp_path_factory.mktemp(x)) for x in ("full", "none"))
    docs = [(i, t, "en", "s", len(t)) for i, t in passages(3, 60)]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    made = {
        "documents": (docs, DOCS + ", lang string, source string, n_chars long"),
        "labels": ([(r[0], rng.randint(0, 1), 0) for r in docs if r[0] is not None], "doc_id long, quality int, toxic int"),
        "pages": ([(1, "http://a.org/x", "")], "page_id long, url string, html string"),
        "embeddings": (vectors, "vec_id long, embedding array<float>"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{none}/{name}.parquet")
    return full, none, docs, vectors


def test_registered_queries_agree_with_plain_versions(spark, tables):
    full, _, docs, vectors = tables
    got = [tuple(r) for r in queries.QUERIES["op4_suffix_dedup"](spark, full).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert by_id(got) == by_id(suffix(docs, 200))
    got = [tuple(r) for r in queries.QUERIES["op7_rlz_dedup"](spark, full).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert by_id(got) == by_id(rlz(docs, 13))
    x = np.array([v for _, v in vectors], np.float32).astype(float)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in queries.QUERIES["op10_ann"](spark, full).collect()}
    for q in range(0, 200, 20):
        s = x @ x[q]
        want = [j for j in np.lexsort((np.arange(200), -s)) if j != q][:20]
        assert [got[(q, r + 1)] for r in range(20)] == want


def test_empty_tables_give_empty_results(spark, tables):
    _, none, _, _ = tables
    for name, query in queries.QUERIES.items():
        assert query(spark, none).count() == 0, name
    assert corpus_pipeline.run(spark, none).count() == 0
    docs = spark.read.parquet(f"{none}/documents.parquet")
    assert quality.classify(docs, None).count() == url_filter(spark.read.parquet(f"{none}/pages.parquet")).count() == 0
