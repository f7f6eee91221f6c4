"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, word pairs, word triples, and pairs one
or two words apart, over the whole text. Training runs in one task over a bounded sample of labelled
documents (``rows``); per-coordinate rates fit rare and frequent features alike, and the L1 term
leaves a few thousand weights, which scoring broadcasts.

Defined results: null and empty texts have no feature and score the bias alone; repeated rows score
alike; without labelled rows every score is 0.5; a null id is never learned from and its ``held_out`` is null; other columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from pulsegrid.llm import labelled
from pulsegrid.llm.common import WordHashes, chain, mix

THRESHOLD = 0.3
#: At most this many labelled rows are fitted on.
TRAIN_ROWS = 12_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 or c == 39 else 32 for c in range(256))


@dataclass(frozen=True)
class Options:
    bits: int = 22
    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    epochs: int = 5
    #: Features of fewer training documents are left out: L1 would drop them anyway.
    min_documents: int = 3


def features(texts: list[bytes], hashes: WordHashes, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) arrays, one pair for each kind of feature; a feature may repeat within a row."""
    words = [t.translate(_LETTERS).split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = hashes.of([w for ws in words for w in ws])
    row = np.repeat(np.arange(len(words)), n)
    shift = np.uint64(64 - bits)
    yield row, (mix(h) >> shift).astype(np.int64)
    two = chain(h[:-1], h[1:])
    for gap, seed, left in ((1, 11, h), (2, 12, two), (2, 13, h), (3, 14, h)):
        if len(h) > gap:
            m = len(h) - gap
            same = row[:m] == row[gap:]
            x = chain(left[:m][same] + np.uint64(seed), h[gap:][same])
            yield row[:m][same], (x >> shift).astype(np.int64)


def fit(texts: list[bytes], labels: np.ndarray, o: Options = Options()) -> bytes:
    """Weights as (feature, weight) pairs; feature -1 is the bias."""
    size = 1 << o.bits
    hashes = WordHashes()
    rows: list[np.ndarray] = []
    for k in range(0, len(texts), 256):
        block = texts[k : k + 256]
        parts = list(features(block, hashes, o.bits))
        row, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        both = np.unique(row * size + x)
        row, x = both // size, both % size
        rows += np.split(x, np.searchsorted(row, np.arange(1, len(block))))
    seen = np.bincount(np.concatenate(rows), minlength=size) if rows else np.zeros(size, int)
    kept = np.flatnonzero(seen >= o.min_documents)
    at = np.full(size, -1, np.int64)
    at[kept] = np.arange(len(kept))
    rows = [i[i >= 0] for i in (at[x] for x in rows)]
    bias = len(kept)
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(i):
        w = (np.sign(z[i]) * o.l1 - z[i]) / ((o.beta + np.sqrt(n[i])) / o.alpha + o.l2)
        return np.where(np.abs(z[i]) <= o.l1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(o.epochs if len(rows) else 0):
        for k in order.permutation(len(rows)):
            i = np.append(rows[k], bias)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[k]
            root = np.sqrt(n[i] + g * g)
            z[i] += g - (root - np.sqrt(n[i])) / o.alpha * w
            n[i] += g * g
    w = weights(np.arange(bias + 1))
    model = np.zeros(np.count_nonzero(w), [("f", "<i8"), ("w", "<f8")])
    model["f"], model["w"] = np.append(kept, -1)[w != 0], w[w != 0]
    return model.tobytes()


class Scorer:
    """Scores blocks of texts; holds only the broadcast weights."""

    def __init__(self, model: bytes, bits: int):
        self.model, self.bits, self.table, self.hashes = model, bits, None, None

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self.table is None:
            m = np.frombuffer(self.model, [("f", "<i8"), ("w", "<f8")])
            self.bias = float(m["w"][m["f"] < 0].sum())
            self.table = np.zeros(1 << self.bits)
            self.table[m["f"][m["f"] >= 0]] = m["w"][m["f"] >= 0]
            self.used = self.table != 0
            self.hashes = WordHashes()
        hits = []
        for row, x in features(texts, self.hashes, self.bits):
            hit = self.used[x]
            hits.append(row[hit] << self.bits | x[hit])
        both = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        s = self.bias + np.bincount(both >> self.bits, self.table[both & ((1 << self.bits) - 1)], len(texts))
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, options: Options = Options()) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted``."""
    model = labelled.fit_once(labelled.sample(docs, labels, "toxic", rows), lambda t, y: fit(t, y, options))
    return labelled.scored(docs, Scorer(model, options.bits), threshold)
