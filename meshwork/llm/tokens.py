"""Token ids of whole texts by a public tokenizer, piece by piece: ids of a text are those of its pieces one after the other.

A piece is a word between white space or, where a word has only ASCII and Latin-1 letters (and no apostrophe or special token), a run of letters, a digit,
or a run of other signs in it. The tokenizer's pattern never reaches over these bounds, and its normalizer composes nothing across them. Each
distinct piece is tokenized once for each block of texts, and not again while the worker remembers it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from meshwork.llm.textbytes import text_bytes, word_array, words

#: ASCII white space (space, tab to carriage return); other kinds of white space are left to the tokenizer.
NOT_GAP = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)], bool)
#: 0: other signs, 1: letters, 2: digits, 3: signs that the tokenizer reads together with what follows, and bytes beyond Latin-1, which keep their word whole.
KIND = np.array([1 if chr(b).isalpha() and b < 128 else 2 if 48 <= b <= 57 else 3 if b >= 128 or b in b"'<" else 0 for b in range(256)], np.uint8)
#: What a word that is kept whole holds: kind 3.
ODD = re.compile(rb"['<\xC2\xC4-\xFF]|\xC3[\x97\xB7]")
#: Distinct pieces that a worker remembers, the length in bytes above which one isn't remembered, and pieces that are tokenized in one call.
REMEMBERED, LONG_PIECE, TOGETHER = 400_000, 64, 2000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, which tokens end a word, and what the worker remembers; without a folder, a file of the public vocabularies. Each worker loads it once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    model = Tokenizer.from_file(path)
    vocabulary = model.get_vocab()
    word_end = np.zeros(max(vocabulary.values()) + 1, bool)
    word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return model, word_end, {}


def pieces_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pieces, and for each text the offset of its first piece (len+1)."""
    start, end, first = words(raw, off, NOT_GAP)
    if not len(start):
        return start, end, first
    kind = KIND[raw]
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # not the signs for times and divided by
    kind[lead] = kind[lead + 1] = 1
    word = np.repeat(np.arange(len(start)), end - start)
    at = np.arange(len(word)) + np.repeat(start - (np.cumsum(end - start) - (end - start)), end - start)
    own = kind[at]
    whole = np.zeros(len(start), bool)
    whole[word[own == 3]] = True
    cut = np.ones(len(at), bool)
    same = word[1:] == word[:-1]
    cut[1:] = ~same | (((own[1:] != own[:-1]) | (own[1:] == 2)) & ~whole[word[1:]])
    begin = np.flatnonzero(cut)
    start = at[begin]
    end = at[np.append(begin[1:], len(at)) - 1] + 1
    return start, end, np.searchsorted(start, off)


def tokenized(model, word_end: np.ndarray, new: list[bytes]) -> list[bytes]:
    """Ids of pieces, as bytes. Runs of one kind are what the tokenizer's pattern calls a word, whose last token is marked, so many are told apart in one
    call; of pieces that were kept whole each is a text of its own."""
    out: list[bytes] = [b""] * len(new)
    simple, whole = [], []
    for i, w in enumerate(new):
        (whole if ODD.search(w) else simple).append(i)
    for lo in range(0, len(simple), TOGETHER):
        part = simple[lo : lo + TOGETHER]
        ids = np.array(model.encode_batch_fast([b" ".join([new[i] for i in part]).decode()], add_special_tokens=False)[0].ids, np.uint32)
        raw, a = ids.tobytes(), 0
        for i, b in zip(part, (4 * np.flatnonzero(word_end[ids]) + 4).tolist(), strict=True):
            out[i] = raw[a:b]
            a = b
    for i, e in zip(whole, model.encode_batch_fast([new[i].decode() for i in whole], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, np.uint32).tobytes()
    return out


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids (unsigned, 32 bits) and len+1 offsets into them; null counts as an empty text."""
    raw, off = text_bytes(texts)
    start, end, first = pieces_of(raw, off)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    coded = word_array(raw, start, end).dictionary_encode()
    model, word_end, known = tokenizer(path)
    distinct = coded.dictionary.to_pylist()
    ids = list(map(known.get, distinct))
    new = [i for i, x in enumerate(ids) if x is None]
    fresh = tokenized(model, word_end, [distinct[i] for i in new])
    if len(known) + len(new) > REMEMBERED:
        known.clear()
    for i, x in zip(new, fresh, strict=True):
        ids[i] = x
        if len(distinct[i]) <= LONG_PIECE:
            known[distinct[i]] = x
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(ids), np.uint32)
    code = coded.indices.to_numpy()
    many = size[code]
    place = np.zeros(len(code) + 1, np.int64)
    np.cumsum(many, out=place[1:])
    at = np.repeat(begin[code] - place[:-1], many) + np.arange(place[-1])
    return flat[at], place[first]
