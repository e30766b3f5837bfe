"""Labels and scores of the licence scan against a plain version, over texts made of whole and damaged sentences."""

import math
import random

import pytest

from meshwork.llm.license_scan import BASE, POSTED, TEMPLATES, license_scan, split_words

OWN = [("house", "you may use this for good deeds only and must say thanks to the makers", ["for good deeds only", "say thanks"]), ("short", "zebra clause", "zebra"), ("twice", "keep keep keep off", "keep keep keep off")]


def plain(rows, templates):
    """(doc_id, n_base, first, last, base labels, labels, score) by trying every beginning in every text."""
    made = [(label, split_words(p), [split_words(p)], True) for p, label in BASE]
    made += [(label, split_words(s), [split_words(k)] if isinstance(k, str) else [split_words(x) for x in k], False) for label, s, k in templates]
    texts = [split_words(t or "") for _, t in rows]
    seen = [set(t) for t in texts]
    names = {w for _, s, _, _ in made for w in s}
    idf = {w: math.log((len(rows) + 1) / (sum(w in x for x in seen) + 1)) for w in names}
    out = []
    for (doc, _), words in zip(rows, texts, strict=True):
        places, base, labels, score = [], set(), set(), 0.0
        for label, sentence, keys, is_base in made:
            key, behind = [], 0
            for k in keys:
                at = next(i for i in range(behind, len(sentence)) if sentence[i : i + len(k)] == k)
                key += range(at, at + len(k))
                behind = at + len(k)
            posted = sorted(key, key=lambda i: (-idf[sentence[i]], i))[:POSTED]
            whole = sum(idf[w] for w in sentence)
            for zero in range(-len(sentence), len(words)):
                there = [0 <= zero + i < len(words) and words[zero + i] == w for i, w in enumerate(sentence)]
                if (there[posted[0]] or sum(there[i] for i in posted) > 1) and whole > 0:
                    score = max(score, sum(idf[w] for w, x in zip(sentence, there, strict=True) if x) / whole)
                if all(there[i] for i in key):
                    labels.add(label)
                    if is_base:
                        base.add(label)
                        places.append(zero)
        out.append((doc, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(min(1.0, score), 9)))
    return out


def corpus(templates, seed, n=120):
    """Texts of filler, whole sentences, sentences with words lost or changed, and phrases across borders of texts."""
    rng = random.Random(seed)
    filler = ["code", "file", "license", "the", "version", "under", "mit", "public", "xyz", "über", "x2"]
    rows = [(0, None), (1, ""), (2, "MIT"), (3, "License"), (4, "license mit license MIT-license"), (5, "keep keep keep keep keep off")]
    for i in range(len(rows), n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choices(filler, k=rng.randint(0, 6))
            sentence = split_words(rng.choice([s for _, s, _ in templates] + [p for p, _ in BASE]))
            kind = rng.randrange(4)
            if kind == 1:
                sentence.pop(rng.randrange(len(sentence)))
            elif kind == 2:
                sentence[rng.randrange(len(sentence))] = rng.choice(filler)
            elif kind == 3:
                sentence = sentence[: rng.randint(0, len(sentence))]
            words += sentence
        rows.append((i, rng.choice([" ", ", ", "\n", "-"]).join(w.upper() if rng.random() < 0.3 else w for w in words)))
    return rows


@pytest.mark.parametrize("templates", [TEMPLATES, OWN, TEMPLATES + OWN])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_beginning(spark, templates, seed):
    rows = corpus(templates, seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in license_scan(docs, templates=templates).collect()]
    assert sorted(got) == sorted(plain(rows, templates))


def test_sentence_without_its_rarest_word(spark):
    """The rarest posted word is lost: no label, but the sentence's share is still found."""
    words = "alpha beta gamma delta epsilon zeta"
    rows = [(0, "beta gamma delta epsilon zeta"), (1, words)] + [(i, "beta gamma") for i in range(2, 12)]
    out = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=[("greek", words, "alpha beta gamma")]).collect()}
    assert out[0]["labels"] == "" and 0.5 < out[0]["score"] < 1 and out[1]["labels"] == "greek" and out[1]["score"] == 1


@pytest.mark.parametrize("wrong", [("a", "some words", "other words"), ("a,b", "some words", "words"), ("a", "some words", []), ("a", "some words", "")])
def test_templates_that_make_no_sense(spark, wrong):
    with pytest.raises(ValueError):
        license_scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), templates=[wrong])


def test_no_template_but_the_base(spark):
    out = license_scan(spark.createDataFrame([(1, "the Apache License")], "doc_id long, text string"), templates=[]).first()
    assert (out["n_base"], out["first_word"], out["labels"]) == (1, 1, "apache")
