"""Content-defined payload chunking for media columns.

A payload (8-bit samples) is cut where a rolling gear hash of its last 32 bytes matches a mask, within
smallest and largest chunk sizes, so equal stretches give equal chunks wherever they lie. Chunks are
compressed by themselves and stored once per digest, in a table bucketed by digest; a payload keeps the ordered list
of its chunks. So a payload's stored form (its list and its chunks' bodies) depends on nothing else in the table.
Reading back joins the lists with the store (only the lists are shuffled to the buckets), puts the chunks in order,
checks every chunk against its digest and every payload against its own, and computes features at once.

Store and reading back go in ``PASSES`` over digests and payloads, so the shuffled copy of the bodies is never
there whole. A digest that more than a thousandth of all references name is read through a broadcast join instead:
at most a thousand digests can be so, of at most ``LARGEST`` bytes each. Copies are emitted once per task and
payloads are distinct, so no other key of bodies can be hot; documents meet their payload by ``join_spread``.

Defined results: null text is the empty text; the empty payload is 64 zero bytes; repeated rows share
one stored form; rows with a null or repeated id are rows like others; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop_saved, join_spread, mix, save, text_blocks, written_once

SMALLEST, MASK_BITS, LARGEST = 1024, 12, 16384
BLOCK = 64
HOT_SHARE = 1000
#: Passes over digests when the store is written, and over payloads when they are read back.
PASSES = (2, 4)
LEVEL = 9
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_STORED = "digest binary, body binary"
_LISTS = "doc_id long, n_bytes long, payload binary, chunks array<struct<digest:binary,length:int>>"
_READ = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: bytes, block: int = BLOCK) -> bytes:
    """The text's bytes, zero-padded to a positive multiple of ``block``."""
    return text + bytes(max(block, -(-len(text) // block) * block) - len(text))


def cuts(data: bytes, smallest: int = SMALLEST, bits: int = MASK_BITS, largest: int = LARGEST) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= smallest:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for w in (1, 2, 4, 8, 16):  # h[i] = sum of gear[data[i-j]] << j over the last 32 bytes
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
    at = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    out, start = [], 0
    for c in [*at, n]:
        while c - start > largest:
            start += largest
            out.append(start)
        if c - start >= smallest or c == n:
            if c > start:
                out.append(c)
            start = c
    return out


def chunked(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks in order."""
    out, start = [], 0
    for end in cuts(data):
        out.append((hashlib.sha256(data[start:end]).digest(), data[start:end]))
        start = end
    return out


def manifest(length: int, chunks: list[tuple[bytes, int]]) -> bytes:
    """Serialised ordered chunk list: magic, payload length, then digest and length of each chunk."""
    return b"PGC1" + length.to_bytes(8, "little") + b"".join(d + n.to_bytes(4, "little") for d, n in chunks)


def feature(data: bytes, chunks: int) -> str:
    """Statistics of the samples read back: mean, root mean square about 128, zero crossings, entropy."""
    x = np.frombuffer(data, np.uint8)
    centred = x.astype(np.float64) - 128
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    return f"mean={x.mean():.4f};rms={np.sqrt((centred**2).mean()):.4f};crossings={crossings};entropy={-(p * np.log2(p)).sum():.4f};chunks={chunks}"


def chunk_lists(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload digest and the ordered chunk list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32())]))
        for b in batches:
            ids = b.column(0).to_pylist()
            for start, texts in text_blocks(b, "text", 1 << 20):
                data = [payload_of(t) for t in texts]
                lists = [[{"digest": d, "length": len(c)} for d, c in chunked(x)] for x in data]
                cols = [pa.array(ids[start : start + len(texts)], pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()), pa.array(lists, kind)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "payload", "chunks"])

    return docs.select("doc_id", "text").mapInArrow(run, _LISTS)


def store_chunks(docs: DataFrame, name: str, passes: int = PASSES[0]) -> DataFrame:
    """The chunk store ``name``: one row per digest, bodies compressed, bucketed by digest."""
    import zstandard

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    for k in range(passes):

        def emit(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            packer = zstandard.ZstdCompressor(level=LEVEL)
            for b in batches:
                for _, texts in text_blocks(b, "text", 1 << 20):
                    rows = []
                    for t in texts:
                        for d, c in chunked(payload_of(t)):
                            if d[0] % passes == k and d[:16] not in seen:
                                seen.add(d[:16])
                                rows.append((d, packer.compress(c)))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["digest", "body"])

        distinct = docs.select("text").mapInArrow(emit, _STORED).repartition(parts, "digest").dropDuplicates(["digest"])
        with written_once(spark):
            distinct.write.option("compression", "uncompressed").mode("append").bucketBy(parts, "digest").sortBy("digest").saveAsTable(name)
    return spark.table(name)


def read_back(lists: DataFrame, store: DataFrame, passes: int = PASSES[1]) -> DataFrame:
    """One row per distinct payload, rebuilt from the store and checked: digests and features of its bytes and its stored form."""
    spark = lists.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    one = lists.select("payload", "chunks").dropDuplicates(["payload"])
    refs = one.select("payload", F.posexplode("chunks").alias("seq", "c")).select("payload", "seq", F.col("c.digest").alias("digest"), F.col("c.length").alias("length"))
    refs = save(refs, "refs")
    hot = refs.groupBy("digest").agg(F.count("*").alias("_n")).where(F.col("_n") > refs.count() / HOT_SHARE).select("digest")
    few = F.broadcast(save(hot, "hot"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        key, chunks, bodies, data = None, [], [], []

        def done() -> tuple:
            whole, stored = b"".join(data), manifest(sum(n for _, n in chunks), chunks) + b"".join(bodies)
            if hashlib.sha256(whole).digest() != key:
                raise ValueError(f"payload {key.hex()} did not come back whole")
            return key, len(whole), key.hex(), zlib.crc32(whole[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(whole, len(chunks))

        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _READ.split(", ")])

        for whole_batch in batches:
            rows = []
            for start in range(0, whole_batch.num_rows, 256):
                b = whole_batch.slice(start, 256)
                for p, d, n, body in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("payload", "digest", "length", "body")), strict=True):
                    if p != key:
                        if key is not None:
                            rows.append(done())
                        key, chunks, bodies, data = p, [], [], []
                    c = unpacker.decompress(body)
                    if len(c) != n or hashlib.sha256(c).digest() != d:
                        raise ValueError(f"chunk {d.hex()} is damaged")
                    chunks.append((d, n))
                    bodies.append(body)
                    data.append(c)
            if rows:
                yield out(rows)
        if key is not None:
            yield out([done()])

    read = None
    for k in range(passes):
        some = refs.where(F.pmod(F.xxhash64("payload"), F.lit(passes)) == k)
        cold = some.join(few, "digest", "left_anti").hint("merge").join(store.hint("merge"), "digest")
        warm = some.join(F.broadcast(store.join(few, "digest", "left_semi")), "digest")
        found = cold.unionByName(warm).repartition(parts, "payload").sortWithinPartitions("payload", "seq")
        part = save(found.mapInArrow(rebuild, _READ), "media")
        read = part if read is None else read.unionByName(part)
    drop_saved(refs)
    return read


def media(docs: DataFrame, name: str | None = None) -> DataFrame:
    """Store every text as media, read it back, and return digests and features per document.

    The chunk store stays as table ``name``; without a name it is dropped when everything is read back.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lists = save(chunk_lists(docs), "lists")
    table = name or f"pulsegrid_chunks_{uuid.uuid4().hex}"
    by_payload = read_back(lists, store_chunks(docs, table))
    if name is None:
        spark.sql(f"DROP TABLE {table}")
    owners = save(lists.select("doc_id", "n_bytes", "payload"), "owners")
    drop_saved(lists)
    return join_spread(owners, by_payload, "payload").drop("payload")
