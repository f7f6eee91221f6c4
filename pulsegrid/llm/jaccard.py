"""N-gram Jaccard join with PartEnum signatures, and the groups its links form.

Sets are the distinct ``width``-word shingles of whole texts. Two sets link when 100 * |A & B| is at
least ``percent`` * |A | B|. Sizes fall into bands so wide that linked sets lie in one band or in
neighbours; a set takes part in its own band's instance and in the next one's. Linked sets of an instance
differ in at most k shingles. The shingle domain is hashed into n1 first-level parts, so that some part
holds at most k2 of the differences, and each part into n2 second-level parts; the subsets of n2 - k2
second-level parts are enumerated, and a signature is the projection of a set on one subset of one part. Linked sets
share a signature. (k2, n2) is chosen per band by a cost of rows written against false partners; n1 follows.

Empty projections say nothing and would gather everything in one bucket, so they are skipped. That
loses nothing for a set with more parts whose subsets are all filled than parts can be bad for any partner of
its; any other set is enumerated again with parts dealt anew, and the very few that fail ``ATTEMPTS`` times
emit their empty projections of the last attempt too, where they meet each other.

A vertex is a distinct set, named by a 64-bit hash of it, so copies are one vertex wherever they lie and need no
id. Tasks drop copies, pack signatures into binary slices and deal these out; a slice is sorted in numpy
and only signatures of two vertices or more go on. A signature that is very frequent in a task is dealt to up to 64
slices by vertex, with one vertex of each as a link between them, so no slice holds a hot signature whole.

Inside a bucket each member is paired with the first member of its stretch of vertex numbers (a tree of
fan-out about 64, the same across buckets, so pairs are few and no vertex is in very many). Each set checks its most
frequent partner first; groups are formed; then the other pairs between different groups. Buckets of
three or more that still hold several groups are compared in blocks: members outside the bucket's largest
group against all, with a bound from parity sketches (two bits a shingle, so it stays sharp at any size)
that never rejects a link. In each round a pair of groups gets its closest pair of sets checked, then sixteen, then all,
so what is left to check shrinks as groups join, and only pairs inside one group stay unchecked.

Defined results: null, empty or wordless texts have no shingle, link with nothing, and their component is
their own id. Links join rows, not ids: rows that share an id but not a text are judged apart. Rows
with a null id link like others; a component is the smallest id that is not null of its group, null if there is none.
An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop_saved, join_spread, keyed, mix, save, shingle_sets, text_blocks, word_hashes

WIDTH, PERCENT = 5, 80
#: Two-level forms to choose from, (k2, n2); a false partner costs CROWD * SHARED ** (shingles in a projection) rows.
FORMS = ((0, 1), (1, 2), (1, 3), (1, 4))
CROWD, SHARED = 1000, 0.2
ATTEMPTS = 4
#: Text bytes hashed at a time, signatures packed at a time, signatures in a slice (about).
TEXT_BYTES, FLUSH, SLICE = 1 << 20, 400_000, 2_000_000
#: A signature met so often among the packed ones is dealt out by vertex.
HEAVY = 256
#: Buckets are compared in blocks of about this many members.
BLOCK = 2048
#: At most so many keys (24 bytes each) are broadcast; beyond that both sides are shuffled.
FEW = 1 << 17
#: Closest pairs of sets checked for two groups of a bucket, by round.
TRIES = (1, 16, 1 << 40)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=8)
def band_starts(percent: int = PERCENT) -> np.ndarray:
    """First size of each band: a band ends at the largest partner its first size can have."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


@lru_cache(maxsize=4096)
def band_parameters(start: int, percent: int = PERCENT) -> tuple[int, int, int, int]:
    """(k, n1, k2, n2) of the instance whose band begins at ``start``."""
    r = start * 100 // percent
    k = 2 * r * (100 - percent) // (100 + percent)
    choices = []
    for k2, n2 in FORMS if k else FORMS[:1]:
        n1 = k // (k2 + 1) + 1
        empty = math.exp(-r / (n1 * n2))
        partial = sum(math.comb(n2, j) * (1 - empty) ** j * empty ** (n2 - j) for j in range(k2 + 1))
        if n1 > 1:
            n1 += math.ceil(partial * n1 + 2 * math.sqrt(partial * n1))
        rows = n1 * math.comb(n2, k2)
        choices.append((rows * (1 + CROWD * SHARED ** (r / n1 * (n2 - k2) / n2)), n1, k2, n2))
    return k, *min(choices)[1:]


def _instance(flat: np.ndarray, n: np.ndarray, band: int, attempt: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets (concatenated in ``flat``, ``n`` long) in one instance, their owners, and which sets need another attempt."""
    start = int(band_starts(percent)[band])
    k, n1, k2, n2 = band_parameters(start, percent)
    r, cells = start * 100 // percent, n1 * n2
    owner = np.repeat(np.arange(len(n)), n)
    h = mix(flat + np.uint64(977 * band + 13 + (attempt << 40)))
    cell = owner * cells + (h % np.uint64(n1)).astype(np.int64) * n2 + ((h >> np.uint64(40)) % np.uint64(n2)).astype(np.int64)
    value = mix(flat + np.uint64(0x51))
    # Sums of 26-bit halves stay exact in doubles, which is what bincount adds.
    low = np.bincount(cell, (value & np.uint64(0x3FFFFFF)).astype(np.float64), len(n) * cells).astype(np.uint64)
    high = np.bincount(cell, (value >> np.uint64(38)).astype(np.float64), len(n) * cells).astype(np.uint64)
    total = (low + (high << np.uint64(32)) * _SPREAD).reshape(len(n), n1, n2)
    filled = (np.bincount(cell, minlength=len(n) * cells) > 0).reshape(len(n), n1, n2)
    subsets = list(combinations(range(n2), n2 - k2))
    sums = np.stack([total[:, :, s].sum(2, dtype=np.uint64) for s in subsets], 2)
    some = np.stack([filled[:, :, s].any(2) for s in subsets], 2)
    partner = np.minimum(n * 100 // percent, r)
    most = np.minimum(k, (n + partner) * (100 - percent) // (100 + percent))
    unsafe = some.all(2).sum(1) <= most // (k2 + 1)
    if attempt == ATTEMPTS - 1:
        some[unsafe] = True
    places = np.arange(n1 * len(subsets), dtype=np.uint64).reshape(n1, len(subsets)) + np.uint64((band + 1 << 44) + (attempt << 40))
    sig = mix(mix(sums) + mix(places))
    return sig[some], np.repeat(np.arange(len(n)), some.sum((1, 2))), unsafe


def signatures_of(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, owners) of non-empty sets; sets of one band are enumerated together."""
    starts = band_starts(percent)
    n = np.array([len(s) for s in sets], np.int64)
    own = np.searchsorted(starts, n, side="right") - 1
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for band in np.unique(np.concatenate([own, own + 1])).tolist():
        who = np.flatnonzero((own == band) | (own + 1 == band))
        for attempt in range(ATTEMPTS):
            if not len(who):
                break
            sig, at, unsafe = _instance(np.concatenate([sets[i] for i in who.tolist()]), n[who], band, attempt, percent)
            sigs.append(sig)
            owners.append(who[at])
            who = who[unsafe]
    return np.concatenate(sigs), np.concatenate(owners)


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """PartEnum signatures of one set of hashes."""
    return signatures_of([s], percent)[0] if len(s) else np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles per hash slot: two sketches differ in at most as many bits as the sets in shingles.

    Slots are twice the size rounded up to a power of two, 64 at least; a longer sketch folds to a shorter one by exclusive or of its halves.
    """
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = (np.bincount((mix(s + np.uint64(0x77)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Differing bits of two sketches, at the shorter one's length."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    m, n = 8 * len(x), 8 * len(y)
    while m > n:
        m >>= 1
        a = (a >> m) ^ (a & ((1 << m) - 1))
    while n > m:
        n >>= 1
        b = (b >> n) ^ (b & ((1 << n) - 1))
    return (a ^ b).bit_count()


def word_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Shingle sets of UTF-8 texts."""
    return shingle_sets(word_hashes(texts, TEXT_BYTES), width)


def vertex(s: np.ndarray) -> int:
    """64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int]]]:
    """Slices of batches with the sets and vertices of their texts."""
    for b in batches:
        for start, texts in text_blocks(b, "text", TEXT_BYTES):
            sets = word_sets(texts, width)
            yield b.slice(start, len(texts)), sets, [vertex(s) for s in sets]


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, ``_k`` and ``_t``."""
    return keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def profiles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, _k, _t, n_shingles, v (vertex, null for no shingle) and the sketch, once per vertex and task."""

    def run(batches):
        seen: set[int] = set()
        for b, sets, vs in _sets(batches, width):
            sk = []
            for s, v in zip(sets, vs, strict=True):
                sk.append(sketch(s) if len(s) and v not in seen else None)
                seen.add(v)
            n = [len(s) for s in sets]
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "_k", "_t")]
            cols += [pa.array(n, pa.int64()), pa.array([v if m else None for v, m in zip(vs, n, strict=True)], pa.int64()), pa.array(sk, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_k", "_t", "n_shingles", "v", "sketch"])

    return identified(docs).mapInArrow(run, "doc_id long, _k long, _t long, n_shingles long, v long, sketch binary")


def _pack(sigs: np.ndarray, vs: np.ndarray, bits: int) -> pa.RecordBatch | None:
    """Signatures by slice (their first ``bits`` bits): six further bytes of each, and runs of vertices.

    Heavy signatures go by vertex too: their members whole to the slices of (signature, first six bits of the vertex),
    the first of each to the signature's own slice.
    """
    rows: list[tuple] = []
    cut = np.uint64(max(0, 16 - bits))

    def emit(key: np.ndarray, sub: int, s: np.ndarray, v: np.ndarray) -> None:
        order = np.argsort(key.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
        key, s, v = key[order], s[order], v[order]
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        start = 0
        for end in ends.tolist():
            own = v[start:end]
            turn = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
            runs = np.diff(np.append(turn, len(own))).astype(np.uint32)
            body = s[start:end].view(np.uint8).reshape(-1, 8)
            body = body if sub else body[:, :6]
            rows.append((int(key[start]), sub, body.tobytes(), own[turn].tobytes(), runs.tobytes()))
            start = end

    sigs = sigs >> cut << cut
    many = np.flatnonzero(np.bincount((sigs >> np.uint64(44)).astype(np.int64), minlength=1 << 20) >= HEAVY)
    if len(many):
        maybe = np.isin((sigs >> np.uint64(44)).astype(np.int64), many)
        names, counts = np.unique(sigs[maybe], return_counts=True)
        heavy = np.isin(sigs, names[counts >= HEAVY])
        if heavy.any():
            s, v = sigs[heavy], vs[heavy]
            sub = (v.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(58)
            order = np.lexsort((v, sub, s))
            s, v, sub = s[order], v[order], sub[order]
            first = np.append(True, (s[1:] != s[:-1]) | (sub[1:] != sub[:-1]))
            emit(mix(s + sub * _SPREAD) >> np.uint64(64 - bits), 1, s, v)
            sigs, vs = np.concatenate([sigs[~heavy], s[first]]), np.concatenate([vs[~heavy], v[first]])
    if len(sigs):
        emit(sigs >> np.uint64(64 - bits), 0, (sigs << np.uint64(bits)) >> np.uint64(16), vs)
    if not rows:
        return None
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["slice", "sub", "sigs", "vs", "runs"])


def packed_signatures(docs: DataFrame, bits: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Signatures of a task's distinct sets in packed slices."""

    def run(batches):
        seen: set[int] = set()
        sigs, owners, size = [], [], 0
        for _, sets, vs in _sets(batches, width):
            new = []
            for i, (s, v) in enumerate(zip(sets, vs, strict=True)):
                if len(s) and v not in seen:
                    seen.add(v)
                    new.append(i)
            if not new:
                continue
            sig, at = signatures_of([sets[i] for i in new], percent)
            own = np.array([vs[i] for i in new], np.int64)[at]
            for k in range(0, len(sig), FLUSH):
                sigs.append(sig[k : k + FLUSH])
                owners.append(own[k : k + FLUSH])
                size += len(sigs[-1])
                if size >= FLUSH:
                    yield _pack(np.concatenate(sigs), np.concatenate(owners), bits)
                    sigs, owners, size = [], [], 0
        if size:
            yield _pack(np.concatenate(sigs), np.concatenate(owners), bits)

    return identified(docs).mapInArrow(run, "slice int, sub int, sigs binary, vs binary, runs binary")


def _parents(s: np.ndarray, v: np.ndarray, skip: int = 0) -> np.ndarray:
    """For members sorted by (signature, vertex as unsigned): the index of each one's parent, its own for a bucket's first.

    The first ``skip`` bits of vertices are the same within a bucket.
    """
    start = np.append(True, s[1:] != s[:-1])
    first = np.flatnonzero(start)
    size = np.diff(np.append(first, len(s)))
    parent = np.repeat(first, size)
    u = v.view(np.uint64) ^ np.uint64(1 << 63)
    for b in np.flatnonzero(size > 64).tolist():
        lo, n = int(first[b]), int(size[b])
        own, levels = u[lo : lo + n], max(1, math.ceil(math.log(n / 64, 64)))
        heads = np.arange(n)
        for level in range(levels, 0, -1):
            stretch = own[heads] << np.uint64(skip) >> np.uint64(64 - 6 * level)
            turn = np.append(0, np.flatnonzero(stretch[1:] != stretch[:-1]) + 1)
            parent[lo + heads] = lo + heads[np.repeat(turn, np.diff(np.append(turn, len(heads))))]
            heads = heads[turn]
        parent[lo + heads] = lo
    return parent


def buckets(packed: DataFrame, bits: int) -> DataFrame:
    """(sig, v, parent, c, heavy) of signatures of several vertices, and of all heavy ones.

    ``parent`` is null for a bucket's first member, ``c`` is the bucket's size.
    """

    def met(rows: list[tuple], slice_: int, sub: int) -> pa.RecordBatch | None:
        v = np.repeat(np.concatenate([np.frombuffer(r[1], np.int64) for r in rows]), np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows]))
        if sub:
            s = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
        else:
            s = np.zeros((len(v), 8), np.uint8)
            s[:, :6] = np.concatenate([np.frombuffer(r[0], np.uint8) for r in rows]).reshape(-1, 6)
            s = s.reshape(-1).view(np.uint64)
            order = np.argsort(s)
            same = s[order[1:]] == s[order[:-1]]
            keep = order[np.append(same, False) | np.append(False, same)]
            s, v = s[keep], v[keep]
            s = np.uint64(slice_ << 64 - bits) | s << np.uint64(16) >> np.uint64(bits)
        if not len(s):
            return None
        u = v.view(np.uint64) ^ np.uint64(1 << 63)
        order = np.lexsort((u, u >> np.uint64(58), s)) if sub else np.lexsort((u, s))
        s, v = s[order], v[order]
        fresh = np.append(True, (s[1:] != s[:-1]) | (v[1:] != v[:-1]))
        s, v = s[fresh], v[fresh]
        group = s
        if sub:  # each stretch of a heavy signature is a bucket of its own here
            group = mix(s + ((v.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(58)) * _SPREAD)
        else:
            same = s[1:] == s[:-1]
            keep = np.append(same, False) | np.append(False, same)
            s, v = s[keep], v[keep]
            group = s
        if not len(s):
            return None
        p = _parents(group, v, 6 * sub)
        top = p == np.arange(len(p))
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        c = np.diff(np.append(first, len(group)))
        cols = [pa.array(s.view(np.int64)), pa.array(v), pa.array(v[p], mask=top), pa.array(np.repeat(c, c)), pa.array(np.full(len(s), bool(sub)))]
        return pa.RecordBatch.from_arrays(cols, ["sig", "v", "parent", "c", "heavy"])

    def run(batches):
        key, rows = None, []
        for b in batches:
            for k, sub, s, v, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, sub) != key and rows:
                    if (out := met(rows, *key)) is not None:
                        yield out
                    rows = []
                key = (k, sub)
                rows.append((s, v, r))
        if rows and (out := met(rows, *key)) is not None:
            yield out

    dealt = packed.repartitionById(1 << bits, F.col("slice")).sortWithinPartitions("slice", "sub")
    return dealt.mapInArrow(run, "sig long, v long, parent long, c long, heavy boolean")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex reachable from each vertex of ``edges`` (a, b) but the roots themselves.

    Alternating large-star and small-star steps; each round is a few joins on vertex ids, and its
    table is stored, so a lost executor costs one round.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = save(small, "edges")
        now = state(new)
        drop_saved(e)
        e = new
        if now == before:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now


def _closer(a: DataFrame, b: DataFrame) -> DataFrame:
    """The groups ``a`` joined by the links ``b``; ``a`` is a table of ``components`` that goes away."""
    out = components(b.unionByName(a.select(F.col("v").alias("a"), F.col("root").alias("b"))))
    drop_saved(a)
    return out


def _bounded(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, w) that sizes and sketches allow to link. Sets that link differ in at most (|A| + |B|)(100 - p)/(100 + p)."""

    def run(batches):
        for t in batches:
            for k in range(0, t.num_rows, 2048):
                b = t.slice(k, 2048)
                na, nb, x, y = (b.column(i).to_pylist() for i in range(3, 7))
                keep = [differing(p, q) * (100 + percent) <= (m + n) * (100 - percent) for m, n, p, q in zip(na, nb, x, y, strict=True)]
                yield b.select(["a", "b", "w"]).filter(pa.array(keep, pa.bool_()))

    one = info.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    two = info.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    sized = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.select("a", "b", "w", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, w long")


def _sets_of(docs: DataFrame, ids: DataFrame, info: DataFrame, width: int) -> DataFrame:
    """(v, set) of the vertices in ``ids``, from one row of each."""

    def run(batches):
        for b, sets, vs in _sets(batches, width):
            wanted = b.column(b.schema.get_field_index("v")).to_pylist()
            hit = [i for i, (v, w) in enumerate(zip(vs, wanted, strict=True)) if v == w]
            yield pa.RecordBatch.from_arrays([pa.array([vs[i] for i in hit], pa.int64()), pa.array([sets[i].tobytes() for i in hit], pa.binary())], ["v", "set"])

    rows = _few(ids.join(info.select("v", "_k"), "v"), "wanted")
    return identified(docs).select("_k", "text").join(rows, "_k").mapInArrow(run, "v long, set binary").dropDuplicates(["v"])


def _few(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` stored, to be broadcast where they are at most FEW and shuffled beyond that."""
    rows = save(rows, name)
    return F.broadcast(rows) if rows.count() <= FEW else rows.hint("merge")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose sets link, checked on the sets themselves: both sets of a pair meet under the pair."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches):
        last = None
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                keep = []
                for a, b, s in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns), strict=True):
                    if last is None or last[:2] != (a, b):
                        last = (a, b, s)
                        continue
                    x, y = np.frombuffer(last[2], np.uint64), np.frombuffer(s, np.uint64)
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        keep.append((a, b))
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep, strict=True)], ["a", "b"])

    ends = _few(pairs.select(F.explode(F.array("a", "b")).alias("v"), "a", "b"), "ends")
    met = sets.join(ends, "v").select("a", "b", "set").repartition(parts, "a", "b").sortWithinPartitions("a", "b")
    return met.mapInArrow(run, "a long, b long")


def _residual(members: DataFrame, stars: DataFrame, info: DataFrame, percent: int, tries: int) -> DataFrame:
    """Pairs (a, b) between different groups inside buckets of three or more ``members``, past the sketch bound.

    Many buckets have the same members: one bucket of each content is compared. A bucket's members outside its
    largest group (blocks of BLOCK) meet all its members (blocks of 8 * BLOCK), each pair of blocks by itself, so
    what a task holds is bounded. Two groups give their ``tries`` closest pairs per pair of blocks; where they have
    more, a row names the bucket in ``sig``.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    root = F.coalesce("root", "v").alias("root")
    rooted = members.join(stars, "v", "left").select("sig", "v", root)
    part = F.lit(1 << 40)
    each = rooted.groupBy("sig", "root").agg(F.count("*").alias("c"), F.sum(F.pmod(F.xxhash64("v"), part)).alias("h"), F.sum(F.pmod(F.xxhash64("v", F.lit(7)), part)).alias("k"))
    whole = each.groupBy("sig").agg(F.sum("c").alias("_c"), F.max(F.struct("c", "root")).alias("_m"), F.count("*").alias("_g"), F.sum("h").alias("_h"), F.sum("k").alias("_k"))
    mixed = whole.where("_c > 2 AND _g > 1").groupBy("_c", "_h", "_k").agg(F.min(F.struct("sig", F.col("_m.root").alias("top"), (F.col("_c") - F.col("_m.c")).alias("o"))).alias("s"))
    mixed = save(mixed.select("s.sig", "s.top", F.ceil(F.col("s.o") / F.lit(BLOCK)).cast("int").alias("_no"), F.ceil(F.col("_c") / F.lit(8 * BLOCK)).cast("int").alias("_na")), "mixed")
    rows = members.join(mixed, "sig").join(info.select("v", "n", "sketch"), "v").join(stars, "v", "left").select("sig", "top", "_no", "_na", "v", root, "n", "sketch")
    deal = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ("v", "root", "n", "sketch")
    others = rows.where("root <> top").select("sig", deal("_no").alias("_o"), every("_na").alias("_a"), F.lit(True).alias("other"), *cols)
    inside = rows.select("sig", every("_no").alias("_o"), deal("_na").alias("_a"), F.lit(False).alias("other"), *cols)
    dealt = others.unionByName(inside).repartition(parts, "sig", "_o", "_a").sortWithinPartitions("sig", "_o", "_a")

    def folded(sketches: list[bytes], words: int) -> np.ndarray:
        out = np.zeros((len(sketches), words), np.uint64)
        for i, s in enumerate(sketches):
            out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, words), 0)
        return out

    def closest(f: np.ndarray) -> tuple[np.ndarray, bool]:
        """The first ``tries`` rows of each pair of groups, by distance, and whether there were more."""
        f = np.unique(f, axis=0)
        turn = np.flatnonzero(np.append(True, (f[1:, :2] != f[:-1, :2]).any(1))) if len(f) else np.zeros(0, np.int64)
        rank = np.arange(len(f)) - np.repeat(turn, np.diff(np.append(turn, len(f))))
        return f[rank < tries], bool((rank >= tries).any())

    def compare(rows: list[tuple]) -> Iterator[tuple[np.ndarray, bool]]:
        """Pairs of one pair of blocks, a bounded number at a time; only their closest are kept where ``tries`` bounds them."""
        words = min(len(r[4]) for r in rows) // 8
        sk = folded([r[4] for r in rows], words)
        other, v, root, n = (np.array([r[i] for r in rows], t) for i, t in enumerate((bool, np.int64, np.int64, np.int64)))
        left, right = np.flatnonzero(other), np.flatnonzero(~other)
        kept, cut = np.zeros((0, 5), np.int64), False
        step = max(1, (1 << 18) // (len(right) or 1))
        for k in range(0, len(left), step):
            i = left[k : k + step]
            d = np.zeros((len(i), len(right)), np.int32)
            for w in range(words):
                d += np.bitwise_count(sk[i, w][:, None] ^ sk[right, w][None])
            ok = (d * np.int64(100 + percent) <= (n[i][:, None] + n[right][None]) * (100 - percent)) & (root[i][:, None] != root[right][None])
            ok &= np.minimum(n[i][:, None], n[right][None]) * 100 >= np.maximum(n[i][:, None], n[right][None]) * percent
            p, q = np.nonzero(ok)
            if not len(p):
                continue
            ends = np.sort(np.stack([v[i[p]], v[right[q]]], 1), 1)
            groups = np.sort(np.stack([root[i[p]], root[right[q]]], 1), 1)
            kept, more = closest(np.concatenate([kept, np.concatenate([groups, d[p, q][:, None].astype(np.int64), ends], 1)]))
            cut |= more
            if tries >= TRIES[-1]:
                yield kept[:, 3:], False
                kept = kept[:0]
        yield kept[:, 3:], cut

    def run(batches):
        key, rows, out, cut, size = None, [], [], [], 0

        def batch() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(out), axis=0)
            none = pa.nulls(len(cut), pa.int64())
            cols = [pa.chunked_array([pa.array(pairs[:, i]), none]).combine_chunks() for i in (0, 1)]
            cols.append(pa.chunked_array([pa.nulls(len(pairs), pa.int64()), pa.array(cut, pa.int64())]).combine_chunks())
            return pa.RecordBatch.from_arrays(cols, ["a", "b", "sig"])

        def compared() -> Iterator[pa.RecordBatch]:
            nonlocal out, cut, size
            for found, more in compare(rows):
                out.append(found)
                cut += [key[0]] if more else []
                size += len(found) + 1
                if size > 1 << 18:
                    yield batch()
                    out, cut, size = [], [], 0

        for t in batches:
            for k in range(0, t.num_rows, 4096):
                for s, o, a, *row in zip(*(c.to_pylist() for c in t.slice(k, 4096).columns), strict=True):
                    if (s, o, a) != key and rows:
                        yield from compared()
                        rows = []
                    key = (s, o, a)
                    rows.append(row)
        if rows:
            yield from compared()
        if out:
            yield batch()

    return dealt.mapInArrow(run, "a long, b long, sig long").distinct()


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Stored tables: ``profiles`` of all rows, and (v, root, component) of all vertices."""
    spark = docs.sparkSession
    rows = save(profiles(docs, width), "profiles")
    info = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.min("_k").alias("_k"), F.max("sketch").alias("sketch"))
    info = save(info, "vertices")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    total = info.agg(F.sum("n")).first()[0] or 0
    bits = min(24, max(1, math.ceil(math.log2(max(parts, total * 0.8 / SLICE, 2)))))
    met = save(buckets(packed_signatures(docs, bits, width, percent), bits), "buckets")

    pairs = met.where("parent IS NOT NULL").groupBy(F.col("parent").alias("a"), F.col("v").alias("b")).agg(F.count("*").alias("w"))
    pairs = save(_bounded(pairs, info, percent), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    sets = save(_sets_of(docs, ids, info, width), "sets")

    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("w"), "a")))
    stars = components(_linked(ranked.where("_r = 1"), sets, percent))

    def across(p: DataFrame, stars: DataFrame) -> DataFrame:
        one, two = stars.toDF("a", "ga"), stars.toDF("b", "gb")
        return p.join(one, "a", "left").join(two, "b", "left").where("coalesce(ga, a) <> coalesce(gb, b)").select("a", "b")

    stars = _closer(stars, _linked(across(ranked.where("_r > 1"), stars), sets, percent))
    checked = save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "checked")
    drop_saved(pairs)
    # Members of heavy signatures lie in several slices, some twice. Pairs of two-member buckets are all checked.
    members = met.where("c > 2").select("sig", "v")
    if not met.where("heavy").isEmpty():
        members = save(met.select("sig", "v").distinct(), "members")
    for tries in TRIES:
        found = save(_residual(members, stars, info, percent, tries), "found")
        more = save(found.where("a IS NOT NULL").join(checked, ["a", "b"], "left_anti").select("a", "b"), "more")
        if not more.isEmpty():
            new = more.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(sets.select("v"), "v", "left_anti")
            sets = sets.unionByName(save(_sets_of(docs, new, info, width), "sets"))
            stars = _closer(stars, _linked(more, sets, percent))
            checked = checked.unionByName(more)
        cut = found.where("sig IS NOT NULL").select("sig")
        done = cut.isEmpty()
        if not done:
            members = save(members.join(cut.distinct(), "sig", "left_semi"), "members")
        drop_saved(found)
        if done:
            break
    for t in (met, members, sets, checked):
        drop_saved(t)
    grouped = info.join(stars, "v", "left").select("v", "id", F.coalesce("root", "v").alias("root"))
    grouped = save(grouped, "grouped")
    drop_saved(stars)
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    out = save(join_spread(grouped.drop("id"), least, "root"), "components")
    drop_saved(grouped)
    drop_saved(info)
    return rows, out


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links, a document's own if none."""
    rows, found = groups(docs, width, percent)
    linked = join_spread(rows.where("v IS NOT NULL").select("doc_id", "n_shingles", "v"), found.select("v", "component_id"), "v")
    alone = rows.where("v IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the row with the smallest id, ids before null; rows without a word all stay.

    Rows are told apart by id and text; of rows equal in both one stays.
    """
    rows, found = groups(docs, width, percent)
    rooted = join_spread(rows.where("v IS NOT NULL").select("doc_id", "_k", "_t", "v"), found.select("v", "root"), "v")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "_k", "_t")).alias("m")).select("m._k", "m._t")
    first = save(first, "kept")
    named = keyed(docs)
    wordless = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = named.where(~wordless).join(first.hint("merge"), ["_k", "_t"], "left_semi").dropDuplicates(["_k", "_t"])
    return kept.unionByName(named.where(wordless)).select(*docs.columns)
