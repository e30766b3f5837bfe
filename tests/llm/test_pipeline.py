import random

import pytest
from brute import SPACE, corpus, jaccard, rlz, sha

import corpus_pipeline
from meshwork.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and ratings as the driver lays them out: shouting texts are poor."""
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    rows = [r[:5] for r in corpus(5, 60)]
    for i in range(100, 160):
        rows.append((i, " ".join(rng.choice(["BUY", "NOW", "CHEAP", "PILLS"]) + "!!" for _ in range(40)) + f" X{i}", "en", "ads", i))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(r[3] != "ads"), 0) for r in rows if r[0] is not None and r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def key(r):
    return (r[0] is None, str(r[0]), r[1] or "")


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append([tuple(r) for r in docs.collect()])
    good, single, cut, mixed, packed = out
    # 1: no shouting, all others stay
    words = lambda r: len(SPACE.findall(r[1] or ""))
    assert not [r for r in good if r[3] == "ads"]
    assert len(good) >= 0.95 * len([r for r in rows if r[3] != "ads"])
    # 2: one text of each class of near-duplicates, the one of the smallest id; empty texts stay
    told = jaccard(good, 5, 0.8)
    classes = {c for (_, c, _, _), r in zip(told, good, strict=True) if words(r) and c is not None}
    assert sorted(r[0] for r in single if words(r) and r[0] is not None) == sorted(classes)
    assert sum(not words(r) for r in single) == sum(not words(r) for r in good)
    # 3: the passages of earlier texts go
    want = {(r[0], sha(" ".join(SPACE.findall(r[1] or "")).encode())): t for r, t in zip(single, rlz(single, 13), strict=True)}
    left = [t for t in want.values() if t[2] == 0 or t[2] < t[1]]
    assert len(cut) == len(left)
    assert sorted(sha(" ".join(SPACE.findall(r[1] or "")).encode()) for r in cut) == sorted(t[3] for t in left)
    assert all(r[4] == len(r[1]) for r in cut if r[0] in {t[0] for t in left if t[2]})
    # 4: copies of what was there, none more than twice
    assert set(mixed) <= set(cut) and max(mixed.count(r) for r in set(mixed)) <= 2 * max(cut.count(r) for r in set(cut))
    # 5: every word of every copy has a place
    assert sum(r[3] for r in packed) == sum(map(words, mixed))


def test_run_and_queries(spark, folder):
    path, rows = folder
    assert corpus_pipeline.run(spark, path).columns == ["doc_id", "part", "start", "length", "bucket", "batch", "slot"]
    for name in ("op1_packing", "op2_license_scan", "op3_quality", "op8_mix_sources"):
        got = queries.QUERIES[name](spark, path)
        assert got.select("doc_id").distinct().count() == len({r[0] for r in rows})
