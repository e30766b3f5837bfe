"""License scans with a positional index of rare licence words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshwork.llm.scratch import small_batches
from meshwork.llm.textbytes import ALNUM, LOWER, blocks, eights, range_codes, words

#: Fixed values of the contract: phrase, label.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: The method's own: label, words of a usual sentence, and the key phrase in it that must stand word for word.
TEMPLATES = [
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "released under the isc license", "isc license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "released under the zlib license", "zlib license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "provided as is without any express or implied warranty in no event will the authors be held liable"),
]


#: A template is posted under so many of the rarest words of its key phrases.
POSTED = 3
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def split_words(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class Template:
    """A label, the words of a sentence, and the places of its mandatory key phrases (one, or several in order)."""

    def __init__(self, label: str, sentence: str, key: str | Sequence[str], base: bool = False):
        self.label, self.words, self.base = label, split_words(sentence), base
        self.key: list[int] = []
        behind = 0
        for phrase in [key] if isinstance(key, str) else key:
            k = split_words(phrase)
            at = next((i for i in range(behind, len(self.words) - len(k) + 1) if self.words[i : i + len(k)] == k), None)
            if not k or at is None:
                raise ValueError(f"key phrase {phrase!r} doesn't stand in the sentence of {label!r}")
            self.key += range(at, at + len(k))
            behind = at + len(k)
        if not self.key or "," in label:
            raise ValueError(f"a template needs a key phrase and a label without comma: {label!r}")


def made_templates(templates: Sequence[tuple]) -> list[Template]:
    return [Template(label, p, p, True) for p, label in BASE] + [Template(label, s, k) for label, s, k in templates]


class Vocabulary:
    """Finds the words of templates in a block of texts: by code, then byte by byte."""

    def __init__(self, names: list[str]):
        raw = [w.encode() for w in names]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum([len(w) for w in raw])
        start = end - [len(w) for w in raw]
        codes = range_codes(flat, start, end, 21)
        self.order = np.argsort(codes)
        self.codes, self.size = codes[self.order], (end - start)[self.order]
        self.chunks = [_chunk(eights(flat), start[self.order], self.size, i) for i in range(0, int(self.size.max()), 8)]

    def find(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of the block that are in the vocabulary, their terms, and the number of each text's first word."""
        low = LOWER[data]
        start, end, first = words(low, off, ALNUM)
        code = range_codes(low, start, end, 21)
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero((self.codes[place] == code) & (self.size[place] == end - start))
        place, view = place[hit], eights(low)
        same = np.ones(len(hit), bool)
        for i, known in enumerate(self.chunks):
            same &= _chunk(view, start[hit], self.size[place], 8 * i) == known[place]
        return hit[same], self.order[place[same]], first


def _chunk(view: np.ndarray, start: np.ndarray, size: np.ndarray, i: int) -> np.ndarray:
    """Bytes i to i+8 of the words, zeros behind a word's end."""
    left = np.clip(size - i, 0, 8)
    x = view[np.minimum(start + i, len(view) - 1)]
    return np.where(left == 8, x, x & ((np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)))


class Found(NamedTuple):
    """For each text: base places, their first and last (-1: none), base labels, labels, score."""

    n: np.ndarray
    first: np.ndarray
    last: np.ndarray
    base: list[str]
    labels: list[str]
    score: np.ndarray


class Index:
    """Positional postings: each template under the POSTED rarest words of its key phrases, with their places in it.

    A posted word of a file says where a template would begin; beginnings that all posted words of the template name are the
    intersection of its postings, and there the key phrases are verified word for word. What the rarest word alone or any two posted words name is scored as well, so a sentence
    of which the rarest word is missing still counts for its share.
    """

    def __init__(self, made: list[Template], number: dict[str, int], idf: list[float]):
        self.made, self.idf = made, np.array(idf)
        self.terms = [np.array([number[w] for w in t.words]) for t in made]
        self.posted = [sorted(t.key, key=lambda i, n=n: (-idf[n[i]], i))[:POSTED] for t, n in zip(made, self.terms, strict=True)]
        self.longest = max(len(t.words) for t in made)
        self.labels = sorted({t.label for t in made})
        self.label = [self.labels.index(t.label) for t in made]

    def beginnings(self, j: int, where: dict[int, np.ndarray], row: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts and word numbers where template j may begin, and whether all its posted words say so."""
        named = [where.get(int(self.terms[j][i]), np.zeros(0, np.int64)) for i in self.posted[j]]
        if not len(named[0]) and sum(len(x) > 0 for x in named) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        wide = int(first[-1]) + 2 * self.longest  # a code tells the text and the beginning, which may lie before the text's first word
        code = [row[x] * wide + (place[x] - i - first[row[x]] + self.longest) for x, i in zip(named, self.posted[j], strict=True)]
        one, votes = np.unique(np.concatenate(code), return_counts=True)
        one, votes = (x[(votes > 1) | np.isin(one, code[0])] for x in (one, votes))
        r = one // wide
        return r, one % wide - self.longest + first[r], votes == len(code)

    def look_up(self, place: np.ndarray, term: np.ndarray, first: np.ndarray) -> Found:
        """place: rising word numbers of the block that hold a known word, term: which; first: each text's first word."""
        n = len(first) - 1
        row = np.searchsorted(first, place, "right") - 1
        at = np.full(int(first[-1]) + 1, -1, np.int32)  # the term of each word of the block
        at[place] = term
        order = np.argsort(term, kind="stable")
        cuts = np.flatnonzero(np.diff(term[order])) + 1
        where = {int(term[x[0]]): x for x in np.split(order, cuts) if len(x)}
        score, count = np.zeros(n), np.zeros(n, np.int64)
        low, high = np.full(n, 2**62), np.full(n, -1)
        hits: dict[bool, list[np.ndarray]] = {False: [], True: []}
        for j, t in enumerate(self.made):
            r, zero, all_posted = self.beginnings(j, where, row, place, first)
            if not len(r):
                continue

            def stands(i: int, r=r, zero=zero, j=j) -> np.ndarray:
                p = zero + i
                return (p >= first[r]) & (p < first[r + 1]) & (at[np.clip(p, 0, len(at) - 1)] == self.terms[j][i])

            own = self.idf[self.terms[j]]
            if own.sum() > 0:
                share = sum(w * stands(i) for i, w in enumerate(own.tolist())) / own.sum()
                np.maximum.at(score, r, np.minimum(share, 1.0))
            fits = all_posted
            for i in t.key:
                fits = fits & stands(i)
            r = r[fits]
            hits[False].append(np.unique(r) * len(self.labels) + self.label[j])
            if t.base:
                begin = zero[fits] + t.key[0] - first[r]
                count += np.bincount(r, minlength=n)
                np.minimum.at(low, r, begin)
                np.maximum.at(high, r, begin)
                hits[True].append(hits[False][-1])
        return Found(count, np.where(count > 0, low, -1), high, self._names(n, hits[True]), self._names(n, hits[False]), score)

    def _names(self, n: int, hits: list[np.ndarray]) -> list[str]:
        """The distinct labels of each text, sorted and joined. hits: text * labels + label."""
        out: list[list[str]] = [[] for _ in range(n)]
        for x in np.unique(np.concatenate(hits)).tolist() if hits else ():
            out[x // len(self.labels)].append(self.labels[x % len(self.labels)])
        return [",".join(x) for x in out]


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: Sequence[tuple] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row.

    A first pass counts in how many files each word of a template occurs, which gives its IDF. The index posts each template under the rarest words of its key
    phrases. In the second pass each file looks up its own licence words of the highest IDF, with their places; where all posted words of a template agree on its
    beginning, the key phrases must stand word for word. score is the largest share of a template's IDF found at a beginning that its rarest word or two
    posted words name (1: a whole sentence). templates: (label, sentence, key phrase or list of key phrases in order), besides those of the base; words of sentences are told as those of
    texts. Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A null or empty text has 0 words, no
    label, score 0 and null first and last; null ids and repeated rows are kept; other columns, whatever their names, play no part.
    """
    small_batches(docs.sparkSession)
    ts = made_templates(templates)
    names = sorted({w for t in ts for w in t.words})
    number = {w: i for i, w in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, files, seen = Vocabulary(names), 0, np.zeros(len(names), np.int64)
        for batch in batches:
            files += batch.num_rows
            for _, _, data, off in blocks(batch.column("text")):
                place, term, first = known.find(data, off)
                row = np.searchsorted(first, place, "right") - 1
                seen += np.bincount(np.unique(row * len(names) + term) % len(names), minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(names))), pa.array(np.concatenate([[files], seen]))], names=["term", "files"])

    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    # a row for each word of the templates, whatever the corpus
    counts = {r["term"]: r["files"] for r in own.select("text").mapInArrow(count, "term long, files long").groupBy("term").agg(F.sum("files").alias("files")).collect()}
    idf = [math.log((counts.get(-1, 0) + 1) / (counts.get(i, 0) + 1)) for i in range(len(names))]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = Vocabulary(names), Index(ts, number, idf)
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column("text")):
                place, term, first = known.find(data, off)
                got = index.look_up(place, term, first)
                none = got.n == 0
                columns = [batch.column("id").slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(got.n), pa.array(got.first, mask=none), pa.array(got.last, mask=none), pa.array(got.base, pa.string()), pa.array(got.labels, pa.string()), pa.array(got.score)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    out = own.mapInArrow(look_up, f"id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("id", doc_id)
