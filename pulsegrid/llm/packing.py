"""Best-fit packing of tokenised documents into fixed-length training sequences.

Only lengths decide a packing, and lengths are whole numbers up to the capacity, so the instance is
a histogram of at most ``capacity`` counts however many documents there are. The driver reduces that
histogram by dominance (bins that some optimal packing contains are fixed for good), packs the rest
best-fit decreasing, whole groups of equal bins at a time, and writes down which ranks of each length
go where. Every piece then finds its place by its rank among the pieces of its length: ranks come
from per-task counts, so no task ever holds a length class and nothing is sorted globally.

Defined results: null text is the empty text; an empty text is one piece that holds the separator;
repeated rows are packed once each, also with null or repeated ids; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import hash_runs, keep_for, save, text_blocks

CAPACITY = 2048
SEPARATOR_ID = 0
#: Text bytes looked at together; stretches of more bytes are not kept in the table.
TEXT_BYTES, LONG = 1 << 20, 64
#: Bytes between stretches: space, line feed, tab.
_GAPS = np.isin(np.arange(256), [32, 10, 9])
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(1)
def tokenizer_at(path: str):
    """The tokenizer, loaded once per worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _StretchIds:
    """Ids of the space-free stretches of texts, from a table by hash.

    The tokenizer's normaliser works on single characters or on runs of white space, and its splitter
    drops white space, so ids of a text are the ids of its stretches between spaces, joined. Likewise a
    letter followed by one final stop or comma always splits there, and ASCII case does not matter
    outside special tokens. Stretches not seen before are tokenised together, in one call a window; long ones are not kept.
    Words are hashed, looked up and turned into ids in numpy, a window of ``TEXT_BYTES`` at a time. A table holds at most
    ``limit`` stretches, so that two of them share a 64-bit hash with a probability below 1e-7.
    """

    def __init__(self, path: str, limit: int = 2_000_000):
        self.tokenizer, self.limit = tokenizer_at(path), limit
        self.reset()

    def _slots(self, n: int) -> None:
        self.keys, self.entries = np.zeros(n, np.uint64), 0
        self.start, self.length = np.zeros(n, np.int32), np.zeros(n, np.int32)

    def reset(self) -> None:
        self._slots(1 << 16)
        # The first id is the separator's.
        self.ids, self.used = np.full(1 << 16, SEPARATOR_ID, np.uint32), 1

    def _room(self, n: int) -> int:
        """The place of ``n`` further ids."""
        start, self.used = self.used, self.used + n
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(n, len(self.ids) // 2), np.uint32)])
        return start

    def _keep(self, names: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Enter distinct hashes that the table does not have; it stays at most half full."""
        if 2 * (self.entries + len(names)) > len(self.keys):
            full = self.keys != 0
            old = self.keys[full], self.start[full], self.length[full]
            self._slots(1 << (2 * (self.entries + len(names))).bit_length())
            self._keep(*old)
        while len(names):  # of names that want one slot the last stays, the others look on
            slot, _ = self._find(names)
            self.keys[slot] = names
            took = self.keys[slot] == names
            self.start[slot[took]], self.length[slot[took]] = starts[took], sizes[took]
            self.entries += int(took.sum())
            names, starts, sizes = names[~took], starts[~took], sizes[~took]

    def _learn(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of distinct stretches. Base forms go into the table, unless they are long."""
        bases: dict[str, int] = {".": 0, ",": 1}
        back, stops = [], []
        for c in stretches:
            s = c.lower() if c.isascii() and "<|" not in c else c
            last = s[-1]
            if (last == "." or last == ",") and len(s) > 1 and s[-2].lower().isalpha():
                s = s[:-1]
                stops.append(int(last == ","))
            else:
                stops.append(-1)
            back.append(bases.setdefault(s, len(bases)))
        order = list(bases)
        h, first, end = hash_runs(" ".join(order).encode(), _GAPS)
        h |= np.uint64(1)
        slot, known = self._find(h)
        known &= end - first <= LONG
        place, number = self.start[slot].astype(np.int64), self.length[slot].copy()
        new = np.flatnonzero(~known)
        if len(new):
            e = self.tokenizer.encode([order[i] for i in new.tolist()], is_pretokenized=True, add_special_tokens=False)
            ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(new)), side="right")
            at = self._room(len(e.ids))
            self.ids[at : self.used] = e.ids
            number[new] = np.diff(np.append(0, ends))
            place[new] = at + ends - number[new]
            short = new[end[new] - first[new] <= LONG]
            self._keep(h[short], place[short], number[short])
        back, stops = np.array(back), np.array(stops)
        place, number, marks = place[back], number[back], (place[:2], number[:2])
        full = np.flatnonzero(stops >= 0)
        if len(full):
            extra = stops[full]
            n, m = number[full].astype(np.int64), marks[1][extra].astype(np.int64)
            ends = np.cumsum(n + m)
            at = self._room(int(ends[-1]))
            to = at + ends - n - m
            for source, size, target in ((place[full], n, to), (marks[0][extra], m, to + n)):
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                self.ids[np.repeat(target, size) + step] = self.ids[np.repeat(source, size) + step]
            place[full], number[full] = to, n + m
        return place, number

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, whether it holds the key) for each hash; a slot without the key is free."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        key = self.keys[slot]
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            key = self.keys[slot[open_]]
            open_ = open_[(key != h[open_]) & (key != 0)]
        return slot, self.keys[slot] == h

    def window(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``data``, first id, number of ids) of each stretch."""
        h, first, end = hash_runs(data, _GAPS)
        h |= np.uint64(1)
        if self.entries > self.limit or self.used > 8 * self.limit:
            self.reset()
        place, number = np.zeros(len(h), np.int64), np.zeros(len(h), np.int32)
        short = end - first <= LONG
        slot, known = self._find(h)
        known &= short
        place[known], number[known] = self.start[slot[known]], self.length[slot[known]]
        new = np.flatnonzero(~known & short)
        if len(new):
            names, at, back = np.unique(h[new], return_index=True, return_inverse=True)
            starts, sizes = self._learn([data[i:j].decode() for i, j in zip(first[new[at]].tolist(), end[new[at]].tolist(), strict=True)])
            place[new], number[new] = starts[back], sizes[back]
            _, there = self._find(names)  # a stretch may be a base form itself
            self._keep(names[~there], starts[~there], sizes[~there])
        long = np.flatnonzero(~short)
        if len(long):
            place[long], number[long] = self._learn([data[i:j].decode() for i, j in zip(first[long].tolist(), end[long].tolist(), strict=True)])
        return first, place, number

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the separator at its end; where each text's ids end)."""
        data = b" ".join([*texts, b""])
        ends = np.cumsum([len(t) + 1 for t in texts])
        out, counts = [], np.zeros(len(texts), np.int64)
        at = done = 0
        while at < len(data):
            to = min(at + TEXT_BYTES, len(data))
            while to < len(data) and data[to - 1] not in b" \n\t":
                to += 1
            first, place, number = self.window(data[at:to])
            owner = np.searchsorted(ends, first + at, side="right")
            counts += np.bincount(owner, number, len(texts)).astype(np.int64)
            # Separators of the texts that end in this window.
            last = int(np.searchsorted(ends, to, side="right"))
            where = np.searchsorted(owner, np.arange(done, last), side="right")
            place, number = np.insert(place, where, 0), np.insert(number, where, 1)
            counts[done:last] += 1
            done = last
            stop = np.cumsum(number, dtype=np.int64)
            total = int(stop[-1]) if len(stop) else 0
            out.append(self.ids[np.repeat(place - (stop - number), number) + np.arange(total)])
            at = to
        return np.concatenate(out), np.cumsum(counts)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: documents' ids with the separator at the end, cut only where longer than ``capacity``."""
    tokenizer = tokenizer or default_tokenizer()
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"packing {tokenizer}"
        table = keep_for(own, lambda: _StretchIds(tokenizer))
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for row, texts in text_blocks(batch, "text", TEXT_BYTES, own):
                rows: list[tuple] = []
                ids, ends = table(texts)
                start = 0
                for doc, end in zip(docs[row : row + len(texts)], ends.tolist(), strict=True):
                    for k in range(start, end, capacity):
                        part = ids[k : min(k + capacity, end)]
                        rows.append((doc, (k - start) // capacity, k - start, len(part), zlib.crc32(part.astype("<u4", copy=False)), *([part.view(np.int32)] if with_ids else [])))
                    start = end
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(cols)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix bins that dominate every alternative (Martello and Toth), with multiplicities.

    Lengths j go from long to short; all that remains stays eligible as j's company. {j} dominates when
    nothing fits beside it. {j, y}, y the longest that fits, dominates when it fills the bin or when no
    two parts fit beside j. {j, y, b} dominates when it fills the bin, no three parts fit beside j, and
    no two parts both longer than b do: any other pair then has one part no longer than b and one no
    longer than y. Some optimal packing contains a dominating bin, so fixing it loses nothing.
    Returns the fixed patterns and the reduced instance.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> bool:
        need = {v: pattern.count(v) for v in pattern}
        n = min(left.get(v, 0) // c for v, c in need.items())
        if not n:
            return False
        fixed.append((pattern, n))
        for v, c in need.items():
            left[v] -= n * c
            if not left[v]:
                del left[v]
        return True

    def beside(used: tuple[int, ...], above: int = 0, most: int = 3) -> list[int]:
        """The shortest parts longer than ``above``, with repeats, besides what ``used`` takes."""
        out: list[int] = []
        for v in sorted(left):
            if v > above:
                out += [v] * min(most - len(out), left[v] - used.count(v))
            if len(out) == most:
                break
        return out

    def longest(limit: int, used: tuple[int, ...]) -> int:
        return next((v for v in range(limit, 0, -1) if left.get(v, 0) > used.count(v)), 0)

    for j in sorted(left, reverse=True):
        while left.get(j, 0):
            room, short = capacity - j, beside((j,))
            if not short or short[0] > room:
                take((j,))
                continue
            y = longest(room, (j,))
            if (y == room or len(short) < 2 or short[0] + short[1] > room) and take((j, y)):
                continue
            b = longest(room - y, (j, y))
            above = beside((j,), above=b, most=2)
            no_three = len(short) < 3 or sum(short) > room
            no_two_above = len(above) < 2 or sum(above) > room
            if b and y + b == room and no_three and no_two_above and take((j, y, b)):
                continue
            break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram. Bins with equal contents move as one group."""
    groups: dict[int, list[list]] = defaultdict(list)  # residual -> [pattern, number of bins]
    room = np.zeros(capacity + 1, bool)
    for v in sorted(counts, reverse=True):
        n = counts[v]
        while n:
            fits = np.flatnonzero(room[v:])
            if len(fits):
                r = int(fits[0]) + v
                pattern, bins = groups[r].pop()
                if not groups[r]:
                    room[r] = False
            else:
                r, pattern, bins = capacity, (), -(-n // (capacity // v))
            per = min(r // v, n)  # equal pieces keep choosing the bin just filled while it has room
            full = min(bins, n // per)
            parts = [(pattern + (v,) * per, full, r - per * v)]
            n -= full * per
            if n and full < bins and n < per:
                parts.append((pattern + (v,) * n, 1, r - n * v))
                full, n = full + 1, 0
            if full < bins and pattern:
                parts.append((pattern, bins - full, r))
            for p, c, rest in parts:
                if c:
                    groups[rest].append([p, c])
                    room[rest] = True
    return [(tuple(p), c) for g in groups.values() for p, c in g]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places for ranks: (length, first rank, first sequence, offset, number, repeats), and the number of sequences.

    Ranks first .. first + number - 1 of a length go ``repeats`` at a time, side by side from the offset on, to sequences in a row.
    Every pattern that is fixed uses up a length, and best fit adds at most three groups of bins a length, so
    there are at most 4 * ``capacity`` patterns of at most sqrt(2 * ``capacity``) different lengths each.
    """
    fixed, rest = dominance_reduction(counts, capacity)
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in fixed + best_fit(rest, capacity):
        offset = 0
        for v, same in groupby(pattern):
            repeats = len(list(same))
            rows.append((v, used[v], sequence, offset, n * repeats, repeats))
            used[v] += n * repeats
            offset += v * repeats
        sequence += n
    assert dict(used) == {k: v for k, v in counts.items() if v}, "a packing places every piece once"
    assert len(rows) <= 4 * capacity * math.isqrt(2 * capacity), "the number of places depends on the capacity alone"
    return rows, sequence


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: as few sequences of ``capacity`` ids as best fit reaches."""
    return place(save(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of ``cut`` (doc_id, piece, length, ids_crc32, ...) a sequence and an offset.

    ``cut`` must be a stored table. Rows are dealt by hash into groups that stay small for any length
    class; counts per (length, group), at most ``capacity`` times the number of groups, become first
    ranks by a running sum in the engine; only the histogram reaches the driver.
    """
    spark = cut.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    by_length = "PARTITION BY length ORDER BY _group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    first = sizes.withColumn("_first", F.expr(f"coalesce(sum(_n) OVER ({by_length}), 0L)")).drop("_n")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    # Every length has few stretches; one array per length keeps the lookup an equi-join on the length.
    by: dict[int, list] = defaultdict(list)
    for v, rank, sequence, offset, n, repeats in rows:
        by[v].append((rank, sequence, offset, n, repeats))
    table = spark.createDataFrame([(v, sorted(x)) for v, x in by.items()], "length long, _places array<struct<rank:long,sequence:long,offset:long,n:long,repeats:long>>")
    within = F.row_number().over(_window("length", "_group", order=("doc_id", "piece", "ids_crc32"))) - 1
    ranked = dealt.withColumn("_k", within).join(first, ["length", "_group"]).withColumn("_rank", F.col("_first") + F.col("_k"))
    # A stretch is found by an as-of step over its length's sorted starts: the last start not above the rank.
    starts = table.select("length", F.transform("_places", lambda p: p["rank"]).alias("_starts"), "_places")
    at = _last_not_above("_starts", "_rank", max((len(x) for x in by.values()), default=1).bit_length())
    found = ranked.join(F.broadcast(starts), "length").withColumn("_p", F.element_at("_places", at))
    return found.select(
        *[c for c in cut.columns],
        F.expr("_p.sequence + (_rank - _p.rank) DIV _p.repeats").alias("sequence_id"),
        F.expr("_p.offset + (_rank - _p.rank) % _p.repeats * length").alias("offset"),
    )


def _window(*by: str, order: tuple[str, ...]):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order)


def _last_not_above(starts: str, rank: str, steps: int):
    """1-based position of the last element of the ascending array not above the rank, by halving."""
    return F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 1, 'hi', size({starts})), (s, i) -> "
        f"CASE WHEN s.lo >= s.hi THEN s WHEN element_at({starts}, CAST((s.lo + s.hi + 1) DIV 2 AS INT)) <= {rank} "
        f"THEN named_struct('lo', CAST((s.lo + s.hi + 1) DIV 2 AS INT), 'hi', s.hi) "
        f"ELSE named_struct('lo', s.lo, 'hi', CAST((s.lo + s.hi + 1) DIV 2 AS INT) - 1) END, s -> s.lo)"
    )
