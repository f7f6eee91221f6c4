"""Language identification by cross-parsing entropy.

Each language keeps a suffix automaton of a bounded sample of its labelled text, over all letters that it has. A document is parsed
greedily into the longest stretches that occur in that text (Ziv and Merhav's cross parsing). A phrase is worth the
logarithm of the sample's length, as naming a place in it takes that much: the language with the fewest phrases times that
logarithm wins, so a language with a small sample is not at a disadvantage. Whole texts are parsed. For speed, segments of ``segment``
characters are parsed side by side as numpy lanes; then each segment is parsed again from the state in which
the one before it ended, until it falls in step with its first parse, so phrases run across segments as in one pass.

Training reads only text and non-null lang of documents whose crc32(doc_id as text) mod 5 is not 0:
per language, however many there are, up to ``rows`` documents (the smallest by a hash of the id) and
``chars`` characters. Languages beyond ``SHARD_CHARS`` characters are scored in successive passes over a
task's texts, one shard of automata at a time, so memory grows only by the packed sample (``chars``
characters a language, compressed) and a pass's result does not depend on the other languages.

Defined results: null text and text without a letter are ``und`` with score 0; ties go to the
alphabetically first language; repeated rows agree; without training rows everything is ``und``; a null id is never learned
from and its ``held_out`` is null.
"""

from __future__ import annotations

import json
import sys
import tempfile
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import split_of

SPLIT, HELD_OUT = 5, 0
#: Bounds of the labelled sample per language.
TRAIN_ROWS, TRAIN_CHARS = 256, 60_000
#: Characters of the sample whose automata are in memory at a time; further languages wait for their own pass.
SHARD_CHARS = 600_000
SEGMENT = 512
#: Largest alphabet whose transitions are kept as a whole table.
DENSE = 64
UNKNOWN = "und"


def training_texts(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> dict[str, list[str]]:
    """lang -> at most ``rows`` texts, of each at most a sixteenth of ``chars``.

    A count per language sets a hash threshold that about four times ``rows`` ids pass; only their texts
    are read on, and the smallest hashes are kept as far as ``chars`` characters go.
    """
    rows_of = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (split_of("doc_id", SPLIT) != HELD_OUT))
    rows_of = rows_of.select("lang", "text", F.xxhash64("doc_id", F.lit("lang")).alias("_h"))
    counts = rows_of.groupBy("lang").agg(F.count("*").alias("_n"))
    unit = F.pmod(F.col("_h"), F.lit(1 << 40)) / float(1 << 40)
    few = rows_of.join(F.broadcast(counts), "lang").where(unit < F.lit(4.0 * rows) / F.col("_n"))
    ranked = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(unit, "text")))
    texts = ranked.where(F.col("_r") <= rows).select("lang", F.substring("text", 1, chars // 16).alias("t"), "_r")
    before = F.sum(F.length("t") + 1).over(Window.partitionBy("lang").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    out: dict[str, list[str]] = {}
    for r in texts.withColumn("_b", before).where(F.coalesce("_b", F.lit(0)) < chars).orderBy("lang", "_r").collect():
        out.setdefault(r["lang"], []).append(r["t"])
    return out


class Automaton:
    """Suffix automaton of a coded text; state 0 is none, 1 the start. Code 0 is in no text.

    Transitions are a (states, size) table for alphabets of up to ``DENSE`` codes. Larger ones have sorted
    keys state * size + code instead, but a table row for the start.
    """

    def __init__(self, text: np.ndarray, size: int):
        self.size = size
        steps = transitions(text)
        self.dense = size <= DENSE
        self.root = np.zeros(size, np.int32)
        self.root[list(steps[1])] = list(steps[1].values())
        if self.dense:
            table = np.zeros((len(steps), size), np.int32)
            for s, d in enumerate(steps):
                if d:
                    table[s, list(d)] = list(d.values())
            self.table = table.ravel()
        else:
            n = sum(map(len, steps))
            keys = np.fromiter((s * size + c for s, d in enumerate(steps) for c in d), np.int64, n)
            to = np.fromiter((t for d in steps for t in d.values()), np.int32, n)
            order = np.argsort(keys)
            # A last key that no state has keeps every position in range.
            self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(to[order], np.int32(0))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.dense:
            return self.table[state * np.int32(self.size) + code]
        at = state.astype(np.int64) * self.size + code
        k = np.searchsorted(self.keys, at)
        return np.where(self.keys[k] == at, self.to[k], np.int32(0))


def transitions(text: np.ndarray) -> list[dict[int, int]]:
    """Per state of the suffix automaton of ``text`` its transitions."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@lru_cache(1)
def is_letter() -> np.ndarray:
    """1 for letters and 2 for all other code points."""
    return np.array([1 if chr(i).isalpha() else 2 for i in range(sys.maxunicode + 1)], np.int32)


class Model:
    """Automata of all languages, each over all letters of its own sample: folded to lower case, non-letters as one symbol."""

    def __init__(self, sample: dict[str, list[str]], chars: int):
        self.langs = sorted(sample)
        folded = {k: " ".join(v).lower()[:chars] for k, v in sample.items()}
        # 0 ends a lane, 1 is any letter that no sample has, 2 anything that is no letter.
        self.alphabet = {c: 3 + i for i, c in enumerate(sorted({c for t in folded.values() for c in t if c.isalpha()}))}
        self.lookup = is_letter().copy()
        for c, k in self.alphabet.items():
            self.lookup[ord(c)] = k
        self.codes, self.automata = [], []
        for k in self.langs:
            text = self.encode(folded[k])
            own = np.unique(text)
            codes = np.zeros(3 + len(self.alphabet), np.int32)
            codes[own] = 1 + np.arange(len(own))
            self.codes.append(codes)
            self.automata.append(Automaton(codes[text], 1 + len(own)))
        #: What a phrase of each language costs.
        self.bits = np.log2([max(2, len(folded[k])) for k in self.langs])

    def encode(self, text: str) -> np.ndarray:
        return self.lookup[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]

    def phrases(self, texts: list[str], segment: int = SEGMENT) -> np.ndarray:
        """(texts, languages) numbers of phrases."""
        coded = [self.encode(t) for t in texts]
        lanes = np.array([-(-len(c) // segment) for c in coded], np.int64)
        owner = np.repeat(np.arange(len(texts)), lanes)
        flat = np.zeros(int(lanes.sum()) * segment, np.int32)
        at = 0
        for c, n in zip(coded, lanes.tolist(), strict=True):
            flat[at : at + len(c)] = c
            at += n * segment
        grid = flat.reshape(-1, segment)
        length = np.full(len(grid), segment)
        later = np.append(False, owner[1:] == owner[:-1])[: len(owner)]  # lanes that go on from the lane before
        if len(grid):
            ends = np.cumsum(lanes) - 1
            full = np.array([len(c) for c in coded])
            length[ends[lanes > 0]] = (full - (lanes - 1) * segment)[lanes > 0]
        order = np.argsort(-length, kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        before = where[np.flatnonzero(later) - 1]  # the lane before each such lane, both as sorted
        after = where[np.flatnonzero(later)]
        grid, length, owner = np.ascontiguousarray(grid[order].T), length[order], owner[order]
        alive = np.searchsorted(-length, -np.arange(segment), side="left")  # lanes longer than k
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for j, (codes, automaton) in enumerate(zip(self.codes, self.automata, strict=True)):
            own = codes[grid]
            states, starts = np.ones(grid.shape, np.int32), np.zeros(grid.shape, bool)
            state = np.ones(len(owner), np.int32)

            def step(now: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """A mismatch starts a phrase; a character unknown to the language is one of its own, and state 1 follows it."""
                s = automaton.step(now, c)
                fresh = s == 0
                root = automaton.root[c]
                return np.where(fresh, np.where(root == 0, 1, root), s).astype(np.int32), fresh | (now == 1)

            for k in range(segment):
                m = int(alive[k])
                if not m:
                    break
                state[:m], starts[k, :m] = step(state[:m], own[k, :m])
                states[k, :m] = state[:m]
            entered = np.ones(len(after), np.int32)
            while True:
                entry = states[segment - 1, before]
                change = np.flatnonzero(entry != entered)
                if not len(change):
                    break
                entered = entry
                lane, now = after[change], entry[change]
                for k in range(segment):
                    on = length[lane] > k
                    lane, now = lane[on], now[on]
                    if not len(lane):
                        break
                    now, starts[k, lane] = step(now, own[k, lane])
                    on = states[k, lane] != now
                    states[k, lane] = now
                    lane, now = lane[on], now[on]
            out[:, j] = np.bincount(owner, starts.sum(0), len(texts)).astype(np.int64)
        return out


def packed(sample: dict[str, list[str]], chars: int) -> list[bytes]:
    """The sample as compressed shards of whole languages in alphabetical order, of ``SHARD_CHARS`` characters or one language."""
    shards: list[dict[str, list[str]]] = []
    room = 0
    for k in sorted(sample):
        size = min(chars, sum(len(t) + 1 for t in sample[k]))
        if not shards or size > room:
            shards.append({})
            room = SHARD_CHARS
        shards[-1][k] = sample[k]
        room -= size
    return [zlib.compress(json.dumps(s).encode()) for s in shards]


_models: dict[bytes, Model] = {}


def model_of(shard: bytes, chars: int) -> Model:
    """One model at a time per worker process; the packed sample is small, its automata are not."""
    key = shard + b"%d" % chars
    if key not in _models:
        _models.clear()
        _models[key] = Model(json.loads(zlib.decompress(shard)), chars)
    return _models[key]


class Best:
    """Per text the cheapest language so far, its cost and the runner-up's."""

    def __init__(self, n: int):
        self.lang = np.zeros(n, np.int32)
        self.low, self.second = np.full(n, np.inf), np.full(n, np.inf)

    def update(self, at: int, first: int, costs: np.ndarray) -> None:
        """Costs of the texts from ``at`` for the languages from ``first``; ties stay with the earlier language."""
        rows = np.arange(len(costs))
        now = costs.astype(float)
        best = now.argmin(1)
        low = now[rows, best]
        now[rows, best] = np.inf
        part = slice(at, at + len(costs))
        less = low < self.low[part]
        self.second[part] = np.minimum(np.where(less, self.low[part], self.second[part]), np.where(less, now.min(1), low))
        self.low[part] = np.where(less, low, self.low[part])
        self.lang[part] = np.where(less, first + best, self.lang[part])


def texts_of(b: pa.RecordBatch) -> list[str]:
    return [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]


def identify(docs: DataFrame, sample: dict[str, list[str]], chars: int = TRAIN_CHARS, segment: int = SEGMENT) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, the runner-up's share of both costs times 2, less 1."""
    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    base = docs.select(*kept)
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    shards, langs = packed(sample, chars), sorted(sample)

    def score(best: Best, m: Model, first: int, texts: list[str], at: int) -> None:
        k = 0
        while k < len(texts):
            end, size = k, 0
            while end < len(texts) and (end == k or size + len(texts[end]) <= 2 << 20):
                size += len(texts[end])
                end += 1
            best.update(at + k, first, m.phrases(texts[k:end], segment) * m.bits)
            k = end

    def finished(b: pa.RecordBatch, texts: list[str], best: Best, at: int) -> pa.RecordBatch:
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for i, t in enumerate(texts):
            if langs and any(map(str.isalpha, t)):
                low, second = best.low[at + i], best.second[at + i]
                lang[i] = langs[best.lang[at + i]]
                score[i] = 1.0 if np.isinf(second) else (second - low) / max(second + low, 1.0)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(shards) < 2:
            for b in batches:
                texts = texts_of(b)
                best = Best(len(texts))
                for shard in shards:
                    score(best, model_of(shard, chars), 0, texts, 0)
                yield finished(b, texts, best, 0)
            return
        # Several passes read the task's rows again from a file that has no name and ends with the task.
        with tempfile.TemporaryFile() as spool:
            writer, n = None, 0
            for b in batches:
                writer = writer or pa.ipc.new_stream(spool, b.schema)
                writer.write_batch(b)
                n += b.num_rows
            if writer is None:
                return
            writer.close()

            def again() -> Iterator[tuple[int, pa.RecordBatch]]:
                spool.seek(0)
                at = 0
                for b in pa.ipc.open_stream(spool):
                    yield at, b
                    at += b.num_rows

            best, first = Best(n), 0
            for shard in shards:
                m = model_of(shard, chars)
                for at, b in again():
                    score(best, m, first, texts_of(b), at)
                first += len(m.langs)
            for at, b in again():
                yield finished(b, texts_of(b), best, at)

    return base.mapInArrow(run, schema).withColumn("held_out", split_of("doc_id", SPLIT) == HELD_OUT)


def language_id(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    sample = training_texts(docs, rows, chars)
    return identify(docs.drop("lang"), sample, chars)
