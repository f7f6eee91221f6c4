"""Shared pieces of the training-data operators: tables in the cluster's shared folder,
batches of whole texts for Arrow functions, word hashes, and the train/held-out split."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. In local mode alone, as in tests, a folder of our own stands in where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="pulsegrid-"))
        path = _own[0]
    return path.rstrip("/")


#: Arrow batches hold at most about this many bytes, or one row.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES: rows of whole texts differ by orders of magnitude, so a number of rows bounds nothing."""
    jvm = spark._jvm.org.apache.spark.network.util.JavaUtils
    if jvm.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


@contextmanager
def written_once(spark: SparkSession) -> Iterator[None]:
    """For what is written inside: shuffle files go when the write ends, as nothing runs those plans again, and Arrow batches are bounded by bytes."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", _BATCH: str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pulsegrid/{name}-{uuid.uuid4().hex}"
    with written_once(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_spread(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join of a stored table with rows of unique keys; a key may hold any share of the table's rows.

    Keys with more than one in ``share`` rows, of which there are at most ``share``, are broadcast; only the others are shuffled.
    """
    least = left.count() / share
    hot = F.broadcast(save(left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(key), "hot"))
    cold = left.join(hot, key, "left_anti").join(right.hint("merge"), key, "left")
    warm = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, "left")
    return cold.unionByName(warm)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with two keys that are never null: ``_k`` (the id, else a hash of the text) and ``_t`` (a hash of the text).

    Together they tell rows apart by id and text, where an id is missing or repeated.
    """
    hashed = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), hashed), "_t": hashed})


def drop_saved(df: DataFrame) -> None:
    """Delete the files of a table made by ``save`` that nothing will read again."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def split_of(col: str | Column, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``: the fixed train/held-out split."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


_kept: dict[str, object] = {}


def keep_for(operator: str, make: Callable[[], object]) -> object:
    """A table that the tasks of one operator share in a worker process; it goes when the worker turns to another operator's texts."""
    if operator not in _kept:
        _kept.clear()
        _kept[operator] = make()
    return _kept[operator]


def text_blocks(batch: pa.RecordBatch, column: str, block_bytes: int = BLOCK_BYTES, operator: str = "") -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of slices of a batch; null is the empty text."""
    if operator not in _kept:
        _kept.clear()
    texts = batch.column(batch.schema.get_field_index(column))
    start, size, block = 0, 0, []
    for k in range(0, len(texts), 512):
        for i, v in enumerate(texts.slice(k, 512).cast(pa.large_binary()).to_pylist(), k):
            v = v or b""
            if block and size + len(v) > block_bytes:
                yield start, block
                start, size, block = i, 0, []
            block.append(v)
            size += len(v)
    if block:
        yield start, block


class WordHashes(dict):
    """word bytes -> 64-bit hash, computed once per word; emptied when it grows past ``limit``."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, seed=self.seed)
        if len(self) >= self.limit:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2, _PHI = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence whose parts have the hashes ``a`` and ``b``; order matters."""
    return mix(a * _PHI + b)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _PHI)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)


_grown: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... mod 2^64, by doubling; kept for blocks of the usual size."""
    out = _grown.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    if len(out) <= 2 * BLOCK_BYTES:
        _grown[base] = out
    return out[:n]


def hash_runs(data: bytes, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the runs between bytes that ``gaps`` marks: polynomial hashes from one running sum over the bytes."""
    x = np.frombuffer(data, np.uint8)
    word = ~gaps[x]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[x] * _powers(_BASE, len(x)), dtype=np.uint64)])
    h = (total[end] - total[start]) * _powers(_UNBASE, len(x))[start]
    return mix(h + (end - start).astype(np.uint64) * _PHI), start, end


def word_hashes(texts: list[bytes], block_bytes: int = BLOCK_BYTES) -> list[np.ndarray]:
    """Hashes of the words of each text, ASCII letters folded, words between ASCII white space.

    Long buffers are cut between words, so memory follows ``block_bytes`` however long a text is.
    """
    data = b" ".join(texts).lower()
    sizes = np.array([len(t) + 1 for t in texts])
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + block_bytes, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        h, s, _ = hash_runs(data[at:end], _SPACE)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return [np.zeros(0, np.uint64) for _ in texts]
    bounds = np.searchsorted(np.concatenate(starts), np.cumsum(sizes)[:-1])
    return np.split(np.concatenate(hashes), bounds)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(words: list[np.ndarray], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles per text; fewer words make one shingle, no words none."""
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) for w in words])
    rolled = flat[: max(0, len(flat) - width + 1)]
    for k in range(1, width):
        rolled = chain(rolled, flat[k : k + len(rolled)])
    rolled = mix(rolled + np.uint64(width))
    out = []
    for h, end in zip(words, ends.tolist(), strict=True):
        n = len(h)
        if n >= width:
            out.append(distinct(rolled[end - n : end - width + 1]))
        elif n:
            s = h[:1]
            for k in range(1, n):
                s = chain(s, h[k : k + 1])
            out.append(mix(s + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

