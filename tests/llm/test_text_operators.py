import pytest
from brute import SCHEMA, SPACE, WORD, by_id, corpus, jaccard, lower, rlz, sha, suffix
from pyspark.sql import functions as F

from meshwork.llm import quality
from meshwork.llm.jaccard_join import depth_for, jaccard_join, keep_first
from meshwork.llm.license_scan import BASE, license_scan
from meshwork.llm.rlz_dedup import rlz_dedup
from meshwork.llm.suffix_dedup import suffix_dedup


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("width", [200, 40])
def test_suffix_dedup(docs, rows, width):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) for r in suffix_dedup(docs, width=width).collect()]
    assert by_id(got) == by_id(suffix(rows, width))


@pytest.mark.parametrize("width", [13, 4])
def test_rlz_dedup(docs, rows, width):
    out = rlz_dedup(docs, width=width)
    assert set(docs.columns) <= set(out.columns)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept"].encode())) for r in out.collect()]
    assert by_id(got) == by_id(rlz(rows, width))


def test_rlz_reruns_agree(docs):
    one, two = ({(r["doc_id"], r["kept"]) for r in rlz_dedup(d).collect()} for d in (docs, docs.repartition(7)))
    assert one == two


def test_jaccard_join(docs, rows):
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join(docs).collect()]
    assert by_id(got) == by_id(jaccard(rows, 5, 0.8))


def test_jaccard_join_with_tiles(spark, monkeypatch):
    """A group larger than a tile gets the same links and one class."""
    import meshwork.llm.jaccard_join as j

    monkeypatch.setattr(j, "TILE", 8)
    base = [f"w{i}" for i in range(200)]
    made = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(1, 60)]
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join(spark.createDataFrame(made, "doc_id long, text string")).collect()]
    assert by_id(got) == by_id(jaccard(made, 5, 0.8))


def test_keep_first_keeps_one_of_each_class(docs, rows):
    kept = sorted((r["doc_id"] for r in keep_first(docs).collect() if SPACE.findall(r["text"] or "")), key=str)
    classes = [c for (_, c, _, _), r in zip(jaccard(rows, 5, 0.8), rows, strict=True) if SPACE.findall(r[1] or "")]
    lone = sum(c is None for c in classes)  # texts of null ids, none like another
    assert len(kept) == len(set(classes) - {None}) + lone
    empty = [r for r in rows if not SPACE.findall(r[1] or "")]
    assert keep_first(docs).count() == len(kept) + len(empty)


def test_depth_reaches_recall():
    d = depth_for(0.8, 24, 8, 0.9999)
    assert 1 - (1 - 0.8**d) ** 24 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 24


def test_license_scan(docs, rows):
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan(docs).collect()}
    want = set()
    for r in rows:
        ws = WORD.findall(lower(r[1]))
        places = [(i, label) for phrase, label in BASE for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in places]
        want.add((r[0], len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert got == want


def test_license_labels_and_score(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "gnu lesser general public license", "mit", "the license of apache", "mit license mit license"]
    out = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i]["labels"] for i in range(6)] == ["cc-by-nc", "apache,apache-2.0", "gpl,lgpl", "", "", "mit"]
    assert out[0]["score"] == out[1]["score"] == out[5]["score"] == 1.0 and 0 < out[3]["score"] < 1
    assert (out[5]["n_base"], out[5]["first_word"], out[5]["last_word"]) == (2, 0, 2)


def test_quality_learns_grades(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts, grades = [], []
    for i in range(600):
        t = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        g = i % 3
        if g == 0:
            t[rng.randrange(len(t))] = rng.choice(["awful", "nasty"])
        texts.append(" ".join(w.upper() + "!!" if g == 1 else w for w in t))
        grades.append(g)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratings = spark.createDataFrame([(i, grades[i]) for i in range(400)] + [(0, None), (None, 1)], "doc_id long, grade int")
    model = quality.fit(docs, ratings)
    assert model.thresholds[0] < model.thresholds[1]
    out = [r for r in quality.classify(docs, model).collect() if r["doc_id"] >= 400]
    right = sum(r["keep"] == (grades[r["doc_id"]] == 2) for r in out)
    assert right >= 0.95 * len(out)
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["p_good"] <= 1 for r in out)


def test_quality_without_ratings_keeps_all(docs, spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.fit(docs, none)
    assert model is None
    assert quality.classify(docs, model).where("keep").count() == docs.count()


def test_quality_of_odd_rows(docs, spark):
    ratings = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    out = quality.classify(docs, quality.fit(docs, ratings))
    assert out.count() == docs.count() and out.where("p_good is null or keep is null").count() == 0


def test_empty_tables(none):
    for f in (suffix_dedup, rlz_dedup, jaccard_join, license_scan, keep_first):
        assert f(none).count() == 0
