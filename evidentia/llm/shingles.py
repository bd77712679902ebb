"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import itertools
import re

import numpy as np

from evidentia.llm.common import WordHashes, mix64

find_words = re.compile(r"\w+").findall
_P = np.uint64(0x9E3779B97F4A7C15)


def roll(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes."""
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for k in range(1, size):
            h = h * _P + words[k : n + k]
    return mix64(h)


def shingles(texts: list[str | None], size: int, known: WordHashes):
    """(document of each shingle, its hash, words of each document). A text of fewer words is one shingle of all of them; one of none has none."""
    words = [find_words(t.lower()) if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(words)), n)
    docs, hashes = [], []
    if len(flat) >= size:
        whole = doc[size - 1 :] == doc[: len(doc) - size + 1]
        hashes.append(roll(flat, size)[whole])
        docs.append(doc[: len(doc) - size + 1][whole])
    start = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64) if len(n) else n
    for d in np.flatnonzero((n > 0) & (n < size)):
        hashes.append(roll(flat[start[d] : start[d] + n[d]], int(n[d])))
        docs.append(np.array([d]))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), words
    return np.concatenate(docs), np.concatenate(hashes), words
