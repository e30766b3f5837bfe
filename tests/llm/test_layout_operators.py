import math
import random

import numpy as np
import pytest
from brute import SCHEMA, SPACE, corpus
from pyspark.sql import functions as F

from meshwork.llm.ann import ann, hilbert
from meshwork.llm.exact_topk import exact_topk
from meshwork.llm.mixing import mix_sources
from meshwork.llm.packing import best_bounds, pack
from meshwork.llm.url_filter import BLOCKED, RULES, url_filter


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def plain_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > most * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: most * sizes[s] for s in over}


def test_mix(docs, rows):
    out = mix_sources(docs).collect()
    assert len(out) == len(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(SPACE.findall(r[1] or ""))
    want = plain_targets(sizes)
    taken: dict = {}
    biggest: dict = {}
    for r in out:
        assert r["size"] == len(SPACE.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        biggest[r["source"]] = max(biggest.get(r["source"], 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s]
    assert sorted(map(str, out)) == sorted(map(str, mix_sources(docs.repartition(5)).collect()))


def test_mix_is_near_its_targets_over_many_bins(spark):
    rng = random.Random(3)
    made = spark.createDataFrame([(i, "x " * rng.randint(1, 40), f"s{min(9, i % 17)}") for i in range(6000)], "doc_id long, text string, source string")
    got = mix_sources(made).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 40 for r in got)
    assert mix_sources(made.limit(0)).count() == 0


def test_best_bounds_are_optimal():
    from itertools import combinations

    lengths, counts = [1, 2, 4, 7, 8, 12, 20], [5, 1, 9, 2, 2, 1, 3]
    cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
    for b in (1, 2, 3, 4):
        best = min(cost(s + (20,)) for s in combinations(lengths[:-1], b - 1))
        assert cost(best_bounds(lengths, counts, b)) == best
    assert best_bounds([], [], 3) == [] and best_bounds([5], [2], 3) == [5]


def test_pack(docs, rows):
    out = pack(docs, longest=100, buckets=4, budget=400).collect()
    words = sorted(len(SPACE.findall(r[1] or "")) for r in rows)
    assert sum(r["length"] for r in out) == sum(words)
    assert len(out) == sum(max(1, -(-n // 100)) for n in words)
    batches: dict = {}
    for r in out:
        if not r["length"]:
            assert r["bucket"] is r["batch"] is None
            continue
        assert r["length"] <= r["bucket"] <= 100 and r["start"] == r["part"] * 100
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
    for (bucket, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * bucket <= 400
    for b in {b for b, _ in batches}:
        sizes = [len(s) for (x, _), s in sorted(batches.items()) if x == b]
        assert all(n == 400 // b for n in sizes[:-1])  # only the last batch of a bucket may have room
    assert pack(docs.limit(0)).count() == 0 and pack(docs.where("text is null")).count() == 1


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def test_url_filter(spark):
    hosts = ["example.org", "a.example.org", "Example.COM", "org", "myorg", "x.org", "ads.net", "net", "", "com", "b.c.com", "éx.com"]
    paths = ["", "/", "/es/x", "/en/1", "/en/17?q=1", "/en/2", "/fr/", "/de/ü", "/de", "/x.org/", "/cgi-bin/a", "/ads/1", "/a/ads/1", "/wp-login.php#a", "?u=http://x.org/", "#/fr/"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c.org/", "http://x.org/" + "a" * 5000]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, urls[0], "x", "y")], "page_id long, url string, verdict string, html string")
    out = url_filter(pages).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        host, path = split_url(r["url"])
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit)[2:] if fit else (None, None)
        method = "block" if path.startswith(("/cgi-bin/", "/wp-login", "/ads/")) or host.startswith("ads.") else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule[0], rule[1] or method), r["url"]
    assert len(BLOCKED) == 4 and url_filter(pages.limit(0)).count() == 0


def vectors(spark, n=700, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[5:60] = x[4]  # a hot vector
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    data += [(n, None, 1), (n + 1, [], 1), (n + 2, [float("nan")] + [1.0] * (dim - 1), 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, [float("inf")] * dim, 1), (None, x[0].tolist(), 1), (n + 5, [1.0, 2.0], 1)]
    return x, spark.createDataFrame(data, "vec_id long, embedding array<float>, score int").repartition(3)


def test_exact_topk(spark):
    x, df = vectors(spark)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk(df, df.where("vec_id % 50 = 0")).collect()}
    want = set()
    for i in range(0, len(q), 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(len(q)), -s)) if j != i][:5]
        want |= {(i, rank + 1, int(j), int(s[j])) for rank, j in enumerate(order)}
    assert got == want
    assert exact_topk(df.limit(0), df).count() == 0


def test_exact_topk_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in exact_topk(df, df.where("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]


@pytest.mark.parametrize("n", [300, 6000])
def test_ann_recall(spark, n):
    x, df = vectors(spark, n)
    x = x.astype(np.float64)
    out = ann(df, df.where("vec_id % 20 = 0")).collect()
    by: dict = {}
    for r in out:
        assert math.isclose(r["score"], x[r["query_id"]] @ x[r["vec_id"]], rel_tol=1e-12, abs_tol=1e-12)
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for i in range(0, n, 20):
        s = x @ x[i]
        want = [j for j in np.lexsort((np.arange(n), -s)) if j != i][:20]
        got = sorted(by[i])
        assert [g[0] for g in got] == list(range(1, 21)) and i not in {g[1] for g in got}
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        hits, total = hits + len({g[1] for g in got} & set(want)), total + 20
    assert hits >= 0.9 * total
    assert ann(df.limit(0), df).count() == 0


def test_hilbert_is_a_curve():
    """All cells of a grid, in the order of their places, are neighbours of each other."""
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
        place = hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        ordered = cells[np.argsort(place)]
        assert (np.abs(np.diff(ordered, axis=0)).sum(1) == 1).all()
