"""Benchmark decontamination: BM25 over test items, searched with block-max WAND by every passage.

Test items form an inverted index of words whose impacts are BM25 contributions divided by the item's score for
its own words, so 1 is a full match and one threshold serves all items. Passages are windows of
``2 * unit`` words that begin every ``unit`` words and cover the whole text, so any ``unit`` words in a
row lie inside one. WAND's upper bound is taken for all passages of a block at once: impacts of an item's rarer words that a
passage has, plus the whole share of the item's common words. Passages that reach the threshold for some item by this
bound, which no match can miss, run block-max WAND and get
all items at or above the threshold, not the best few. Each hit is verified on the words: the question
(all but the last sentence) and the answer (the last sentence) must both reappear in order, as longest
common subsequences around the passage. Where the last sentence has fewer than ``MIN_WORDS`` words, it is enough
that the whole item does, as much of it as of a question.

Items are few and fixed, documents are many: the index is broadcast in shards of at most ``shard`` items,
one pass each. Items longer than ``unit`` words are indexed in parts of equal size, of at most that many words.

Defined results: null and empty texts match nothing; items of fewer than ``MIN_WORDS`` words match where
their words stand in a row, with all scores 1 at the first place; repeated documents match alike, rows with null or repeated ids are judged
by themselves; repeated items each match; extra columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import text_blocks

THRESHOLD, QUESTION, ANSWER = 0.5, 0.8, 0.6
MIN_WORDS, UNIT, SHARD, POSTING_BLOCK = 5, 64, 20_000, 32
#: Words of more than this share of the item parts, and of more than eight, count as common in the bound, as far as an
#: item's common words make up this share of its score.
COMMON, HELD = 0.04, 0.25
#: Text bytes looked at together.
TEXT_BYTES = 1 << 20
K1, B = 1.2, 0.75

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, n_words long"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def parts_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer; a single sentence is both."""
    ends = [m.end() for m in re.finditer(r"[.!?:]+\s+", text.strip())]
    for end in reversed(ends):
        question, answer = words_of(text.strip()[:end].encode()), words_of(text.strip()[end:].encode())
        if question and answer:
            return question, answer
    both = words_of(text.encode())
    return both, both


class Index:
    """Impact-ordered facts of one shard: postings by term with block maxima, and the items' words."""

    def __init__(self, items: list[tuple[int, str]], unit: int = UNIT):
        self.unit, self.items, units = unit, [], []
        self.phrases: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for item, text in items:
            words = words_of((text or "").encode())
            if item is None or not words:
                continue
            if len(words) < MIN_WORDS:
                self.phrases.setdefault(len(words), {}).setdefault(tuple(words), []).append(item)
                continue
            self.items.append((item, *parts_of(text)))
            cut = np.linspace(0, len(words), -(-len(words) // unit) + 1).astype(int).tolist()
            units += [(len(self.items) - 1, words[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
        counted = [(i, Counter(ws)) for i, ws in units]
        df = Counter(w for _, c in counted for w in c)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted(df))}
        mean = sum(sum(c.values()) for _, c in counted) / max(1, len(counted))
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.owner = [i for i, _ in counted]
        self.common, rare = np.zeros(len(counted)), defaultdict(list)
        limit = max(8, COMMON * len(counted))
        for u, (_, c) in enumerate(counted):
            norm = K1 * (1 - B + B * sum(c.values()) / mean)
            s = {w: math.log(1 + (len(counted) - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in c.items()}
            own = sum(s.values())
            for w, x in sorted(s.items(), key=lambda p: (p[1], p[0])):
                postings[w].append((u, x / own))
                if df[w] > limit and self.common[u] + x / own <= HELD:
                    self.common[u] += x / own
                else:
                    rare[w].append((u, x / own))
        self.postings = [([], [], [])] + [
            ([u for u, _ in postings[w]], [x for _, x in postings[w]], [max(x for _, x in postings[w][k : k + POSTING_BLOCK]) for k in range(0, len(postings[w]), POSTING_BLOCK)]) for w in self.vocabulary
        ]
        self.most = np.array([max(p[1], default=0.0) for p in self.postings], np.float64)
        lists = [[], *(rare[w] for w in self.vocabulary)]
        self.first = np.cumsum([0, *map(len, lists)])
        self.units = np.array([u for p in lists for u, _ in p], np.int64)
        self.impacts = np.array([x for p in lists for _, x in p], np.float64)

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Vocabulary numbers of words; 0 is a word of no item."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def hopeful(self, codes: np.ndarray, passages: np.ndarray, last: np.ndarray, threshold: float) -> np.ndarray:
        """Passages that the bound lets reach the threshold for some item.

        ``passages`` is the stretch of ``unit`` words that each word lies in, a passage is a stretch and the next one, and
        ``last`` tells which stretches begin no passage but belong to the one before.
        """
        if threshold <= HELD:
            return np.flatnonzero(~last[:-1])
        n = self.first[codes + 1] - self.first[codes]
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64)
        at = np.repeat(self.first[codes] - (np.cumsum(n) - n), n) + np.arange(total)
        size = max(1, len(self.owner))
        names, back = np.unique(np.repeat(passages, n) * size + self.units[at], return_inverse=True)
        sums = np.bincount(back, self.impacts[at])
        stretch = names // size
        own = ~last[stretch]
        before = (stretch > 0) & ~last[np.maximum(stretch, 1) - 1]
        names, back = np.unique(np.concatenate([names[own], names[before] - size]), return_inverse=True)
        bound = np.bincount(back, np.concatenate([sums[own], sums[before]]), len(names)) + self.common[names % size]
        return np.unique(names[bound >= threshold - 1e-6] // size)

    def search(self, terms: list[int], threshold: float) -> dict[int, float]:
        """Block-max WAND: every unit whose impacts over the distinct ``terms`` reach ``threshold``."""
        eps = threshold - 1e-9
        cursors = [[self.postings[t][0][0], 0, t] for t in terms]
        found: dict[int, float] = {}
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += float(self.most[c[2]])
                if bound >= eps:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            blocks, until = 0.0, None
            for c in cursors[: pivot + 1]:
                ids, _, tops = self.postings[c[2]]
                k = c[1]
                while k < len(ids) and ids[min(len(ids), (k // POSTING_BLOCK + 1) * POSTING_BLOCK) - 1] < at:
                    k = (k // POSTING_BLOCK + 1) * POSTING_BLOCK
                if k < len(ids):
                    blocks += tops[k // POSTING_BLOCK]
                    last = ids[min(len(ids), (k // POSTING_BLOCK + 1) * POSTING_BLOCK) - 1]
                    until = last if until is None else min(until, last)
            if blocks >= eps:
                if cursors[0][0] == at:
                    found_score = sum(self.postings[c[2]][1][c[1]] for c in cursors if c[0] == at)
                    if found_score >= eps:
                        found[at] = found_score
                    to = at + 1
                else:
                    to = at
            else:
                after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else None
                to = (until if until is not None else at) + 1
                to = max(at + 1, min(to, after) if after is not None else to)
            for c in cursors[: pivot + 1]:
                ids = self.postings[c[2]][0]
                while c[1] < len(ids) and ids[c[1]] < to:
                    c[1] += 1
                c[0] = ids[c[1]] if c[1] < len(ids) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


def subsequence(a: list[bytes], b: list[bytes]) -> float:
    """Longest common subsequence of two word lists as a share of ``a``."""
    code: dict[bytes, int] = {}
    x = np.array([code.setdefault(w, len(code)) for w in a])
    y = np.array([code.get(w, -1) for w in b])
    row = np.zeros(len(b) + 1, np.int32)
    for w in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == w, row[:-1] + 1, 0)))
    return float(row[-1]) / max(1, len(a))


class Searcher:
    """Finds the items in blocks of whole texts."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, question: float, answer: float, unit: int):
        self.args, self.index = (items, threshold, question, answer, unit), None

    def __getstate__(self):
        return {"args": self.args, "index": None}

    def __call__(self, ids: list, texts: list[bytes]) -> list[tuple]:
        items, threshold, least_q, least_a, unit = self.args
        if self.index is None:
            self.index = Index(items, unit)
        x = self.index
        words = [words_of(t) for t in texts]
        out: list[tuple] = []
        for doc, ws in zip(ids, words, strict=True):
            for n, phrases in x.phrases.items():
                rows = list(zip(*(ws[k:] for k in range(n))))
                for phrase in phrases.keys() & set(rows):
                    out += [(doc, item, 1.0, 1.0, 1.0, rows.index(phrase), n) for item in phrases[phrase]]
        n = np.array([len(ws) for ws in words])
        stretches = np.maximum(1, -(-n // unit))
        first = np.cumsum(stretches) - stretches
        codes = x.codes([w for ws in words for w in ws])
        inside = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
        last = np.zeros(int(stretches.sum()) + 1, bool)
        last[(first + stretches - 1)[stretches > 1]] = True
        last[-1] = True
        best: dict[tuple[int, int], tuple] = {}
        for p in x.hopeful(codes, np.repeat(first, n) + inside // unit, last, threshold).tolist():
            row = int(np.searchsorted(first, p, side="right")) - 1
            ws, s = words[row], (p - int(first[row])) * unit
            e = min(s + 2 * unit, len(ws))
            terms = [t for t in np.unique(x.codes(ws[s:e])).tolist() if t]
            for u, score in x.search(terms, threshold).items():
                i = x.owner[u]
                item, question, answer = x.items[i]
                reach = len(question) + len(answer)
                lo, hi = max(0, s - reach), min(len(ws), e + reach)
                q, a = subsequence(question, ws[lo:hi]), subsequence(answer, ws[lo:hi])
                if len(answer) < MIN_WORDS and not (q >= least_q and a >= least_a):
                    q = a = subsequence(question + answer, ws[lo:hi])
                if q >= least_q and a >= least_a and ((row, i) not in best or score > best[row, i][2]):
                    best[row, i] = (ids[row], item, score, q, a, s, e - s)
        return out + list(best.values())


def _searchers(items: DataFrame, threshold: float, question: float, answer: float, unit: int, shard: int) -> list[Searcher]:
    rows = [(r["item_id"], r["text"]) for r in items.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").collect()]
    return [Searcher(rows[k : k + shard], threshold, question, answer, unit) for k in range(0, max(1, len(rows)), shard)]


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, unit: int = UNIT, shard: int = SHARD) -> DataFrame:
    """One row per document and test item found in it: scores, overlaps and the first passage's place."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    out = None
    for searcher in _searchers(items, threshold, question, answer, unit, shard):

        def run(batches: Iterator[pa.RecordBatch], searcher: Searcher = searcher) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                for start, texts in text_blocks(b, "text", TEXT_BYTES):
                    if hits := searcher(ids[start : start + len(texts)], texts):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), kinds, strict=True)], names)

        found = docs.mapInArrow(run, _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, unit: int = UNIT, shard: int = SHARD) -> DataFrame:
    """The rows in which no test item is found, judged where they lie: no row needs an id."""
    for searcher in _searchers(items, threshold, question, answer, unit, shard):

        def run(batches: Iterator[pa.RecordBatch], searcher: Searcher = searcher) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaked = {hit[0] for start, texts in text_blocks(b, "text", TEXT_BYTES) for hit in searcher(range(start, start + len(texts)), texts)}
                yield b.filter(pa.array([i not in leaked for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
