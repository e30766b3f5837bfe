"""Whitening, certified best-fit packing and spelling variants against plain versions, and on odd inputs."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm.fit_packing import best_fit_decreasing, bin_bound, fit_pack
from meshwork.llm.spelling import spelling_variants
from meshwork.llm.tokens import tokenizer
from meshwork.llm.wavelet import WaveletTree
from meshwork.llm.whitening import lanczos, whiten

DOCS, VECTORS = "doc_id long, text string", "vec_id long, embedding array<double>"


# spelling


def plain_variants(rows):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    count = Counter()
    for i, t in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = m.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 7:
                count[w] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    by_rest = defaultdict(list)
    for w in count:
        for k in range(len(w)):
            by_rest[w[:k] + w[k + 1 :]].append((w, k))
    near = defaultdict(set)
    for rest, group in by_rest.items():
        if rest in count:
            for w, _ in group:
                near[w].add(rest)
                near[rest].add(w)
        for (a, i), (b, j) in itertools.permutations(group, 2):
            if i == j and a != b:
                near[a].add(b)
    form = {}
    for w, n in count.items():
        b = min(((-count[x], x) for x in near[w]), default=None)
        form[w] = b[1] if b and -b[0] >= 10 * n else None
    out = {}
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), count[form[w]] if form[w] else None)
    return out


def variants(df, **options):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(df, **options).collect()}


def misspelt(rng, words, letters):
    w = list(rng.choice(words))
    for _ in range(rng.randint(0, 2)):
        k, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        if kind == 0:
            w.insert(k, rng.choice(letters))
        elif k < len(w):
            w[k : k + 1] = [] if kind == 1 else [rng.choice(letters)]
    return "".join(w)


@pytest.mark.parametrize("block_bytes", [512, 4096, 1 << 20])
def test_spelling_variants(spark, block_bytes):
    """Blocks of 16 words, of some hundred, and one for all, over words whose beginnings and ends are shared by a third of all."""
    rng = random.Random(5)
    letters = "abzàÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(60)]
    base += ["commonstart" + "".join(rng.choice("ab") for _ in range(5)) for _ in range(20)] + ["aaaaaaaa", "aaaaaaaaa", "abababab"]
    rows = [(i, " ".join(misspelt(rng, base, letters) + rng.choice(["", ".", "1"]) for _ in range(60))) for i in range(60)]
    rows += [(1000, "Commonstartaaaaa " * 900 + "commonstartaaaab " * 50 + "Àbcdefg àbcdefg " * 2), (None, rows[0][1]), rows[3]]
    want = plain_variants(rows)
    assert sum(v[0] is not None for v in want.values()) > 10 and any(v[0] and v[1] != v[0] for v in want.values())
    assert variants(spark.createDataFrame(rows, DOCS).repartition(3), block_bytes=block_bytes) == want


def test_long_words_and_lengths_that_ask_each_other(spark):
    long = "x" * 3000 + "y" + "z" * 3000
    edits = [long[:5000] + long[5001:], long[:100] + "q" + long[101:], "x" + long, long.replace("y", "w"), "b" * 64, "b" * 65, "b" * 63, "b" * 32 + "c" + "b" * 32]
    rows = [(i, f"{a} {a}, {long} {long}") for i, a in enumerate(edits)]
    assert variants(spark.createDataFrame(rows, DOCS)) == plain_variants(rows)


def test_spelling_odd_inputs(spark):
    assert variants(spark.createDataFrame([], DOCS)) == {}
    assert variants(spark.createDataFrame([(1, None), (2, ""), (None, None), (3, "short 1234")], DOCS)) == {}
    rows = [(i, "letters letterz Ã©ØÃ©Øé") for i in range(5)]
    df = spark.createDataFrame(rows, DOCS).select("*", F.lit(7).alias("word"), F.lit(8).alias("n"), F.lit(9).alias("a.b"))
    assert variants(df) == plain_variants(rows)


def test_wavelet_tree():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100):
        v = rng.permutation(n)
        q = np.sort(rng.integers(0, n + 1, (50, 2, 2)), axis=2)
        query, place = WaveletTree(v).report(q[:, 0, 0], q[:, 0, 1], q[:, 1, 0], q[:, 1, 1])
        got = set(zip(query.tolist(), place.tolist(), strict=True))
        assert got == {(i, p) for i, ((a, b), (c, d)) in enumerate(q.tolist()) for p in range(a, b) if c <= v[p] < d} and len(query) == len(got)


# packing


def fewest(lengths, capacity):
    """The optimum, by search over the bins of one piece after the other."""
    best = len(lengths)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for j, r in enumerate(room):
            if r >= lengths[i] and r not in room[:j]:
                go(i + 1, [*room[:j], r - lengths[i], *room[j + 1 :]])
        go(i + 1, [*room, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_bounds_and_best_fit():
    rng = random.Random(1)
    certified = 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        at, offset, room = best_fit_decreasing(np.array(lengths), capacity)
        for b in range(len(room)):
            mine = sorted((o, n) for o, n, i in zip(offset.tolist(), lengths, at.tolist(), strict=True) if i == b)
            assert [o for o, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))] and sum(n for _, n in mine) == capacity - room[b]
        sizes, counts = np.unique(lengths, return_counts=True)
        low, best = bin_bound(sizes, counts, capacity), fewest(lengths, capacity)
        assert max(1, -(-sum(lengths) // capacity)) <= low <= best <= len(room)
        certified += low == len(room)
    assert certified > 120


def check_packing(rows, out, capacity):
    model = tokenizer("word_bpe_49k.json")[0]
    want = Counter()
    for i, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), capacity)):
            want[i, p, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= capacity
    return len(bins)


@pytest.mark.parametrize("part_bins", [4, 1000])
def test_fit_packing(spark, part_bins):
    """Partitions of about four sequences and one for all; ids are those of the tokenizer on whole texts."""
    rng = random.Random(2)
    words = ["don't", "we'll", "café", "café", "İstanbul", "ΣΣ", "\U0001f600", "a b", "x y\u0085z", "<|endoftext|>", "<|EndOfText|>", "가", "1234", "!?'s", "zzzzqqqq", "\x1c", "The", "a×b÷c", "Größe", "naïve(x)=2", "don’t", "«où»", "ªº", "e\u0301té", "x1y22z333", "--", "\u3000wide", "ß", "ŉ", "ǅ"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 9, 14, 60])))) for i in range(400)]
    rows += [(401, None), (402, ""), (None, "a"), (None, "a"), rows[5], (403, "word " * 500), (404, "x" * 5000), (405, "\n\t ")]
    report: list = []
    out = fit_pack(spark.createDataFrame(rows, DOCS).repartition(3), capacity=64, part_bins=part_bins, report=report).collect()
    n = check_packing(rows, out, 64)
    assert n == report[-1][2] + sum(r["length"] == 64 for r in out) and report[-1][2] <= report[-1][3] * (1.06 if part_bins == 4 else 1.02) + 1
    assert [r[2] for r in report] == sorted((r[2] for r in report), reverse=True)


def test_partitions_with_gaps_exchange(spark):
    """A partition's slack of less than a sequence adds up over partitions; exchange wins it back."""
    rows = [(i, "word " * (i % 40)) for i in range(3000)]
    report: list = []
    out = fit_pack(spark.createDataFrame(rows, DOCS), capacity=64, part_bins=8, report=report).collect()
    n = check_packing(rows, out, 64)
    whole = len(best_fit_decreasing(np.array([r["length"] for r in out]), 64)[2])
    assert len(report) > 1 and report[0][2] > n and whole <= n <= 1.01 * report[0][3]


def test_fit_packing_odd_inputs(spark):
    assert fit_pack(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, None)] * 3 + [(7, "")]
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in ("piece", "number", "part", "length", "a.b")])
    assert check_packing(rows, fit_pack(df).collect(), 2048) == 1


# whitening


def check_whitening(x, out, components=32):
    x = np.floor(64 * np.asarray(x, float)).astype(np.int64) + 1000000
    n = len(x)
    y = (n * x - x.sum(0)) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    got = np.zeros((n, k))
    for r in out:
        assert r["n"] == n and r["deviation"] == sum(int(v) ** 2 for v in (n * x - x.sum(0))[r["vec_id"]]) and r["identity_error"] < 1e-9
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert len(out) == n * k
    want = y @ u[:, :k] / np.sqrt(e[:k])
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8


def test_whitening(spark):
    rng = np.random.default_rng(1)
    for n, d, scale in ((300, 40, 1.0), (50, 3, 5.0), (10, 33, 1.0)):
        x = rng.standard_normal((n, d)) * np.linspace(scale, 4, d)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).repartition(4)
        check_whitening(x, whiten(df).collect())


def test_lanczos_stops_early_and_survives_breakdown():
    rng = np.random.default_rng(0)
    d = 200
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = np.concatenate([[1000.0, 500, 100], np.full(d - 3, 1.0)])  # three directions and a sphere: the third block breaks down
    report: list = []
    got, u = lanczos(lambda v: q @ (e[:, None] * (q.T @ v)), d, 20, block=8, report=report)
    assert np.allclose(got, np.sort(e)[::-1][:20]) and np.allclose(u.T @ u, np.eye(20), atol=1e-12) and report[-1][0] < d
    got, _ = lanczos(lambda v: np.zeros_like(v), 5, 3, block=2)
    assert np.allclose(got, 0)


def test_whitening_odd_inputs(spark):
    assert whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, VECTORS)).count() == 0
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((20, 3)), 2)
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 0.0, 0.0]), (94, [float("inf"), 0.0, 0.0])]
    other = [(100 + i, [float(i), float(i * i)]) for i in range(5)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad + other, VECTORS).select("*", F.lit(1).alias("x"), F.lit(2).alias("d"), F.lit(3).alias("a.b"))
    out = whiten(df).collect()
    check_whitening(x, [r for r in out if r["vec_id"] < 90])
    assert {(r["vec_id"], r["n"]) for r in out if r["vec_id"] >= 90} == {(100 + i, 5) for i in range(5)}
    large = spark.createDataFrame([(i, [1e30 * i, 1e9 * i]) for i in (1, 2, 3)] + [(None, [-1e30, 5.0])], VECTORS)
    assert {r["deviation"] for r in whiten(large).collect()} == {None}
