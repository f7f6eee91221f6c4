"""Bounded labelled samples and one-task fits, shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import split_of

#: Labels come from rows whose crc32(doc_id as text) mod SPLIT is not HELD_OUT.
SPLIT, HELD_OUT = 4, 2


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(_order, _label, text) of at most ``rows`` labelled training documents, the smallest by a hash of the id.

    The sample is the same for any partitioning. Its ids, at most ``rows`` of them, are broadcast, so
    the documents are read where they lie and only sampled texts go on, at most ``rows`` also where documents share an id.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (split_of("doc_id", SPLIT) != HELD_OUT))
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"), F.xxhash64("doc_id").alias("_order"))
        .orderBy("_order", "_label")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("_order", "_label", "text")
    return found.orderBy("_order", "_label", F.xxhash64("text")).limit(rows)


def fit_once(sampled: DataFrame, fit: Callable[[list[bytes], np.ndarray], bytes]) -> bytes:
    """Run ``fit(texts, labels)`` in one task over the bounded sample, in the order of the hash."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
        rows.sort(key=lambda r: (r[0], r[1], r[2] or ""))
        model = fit([(r[2] or "").encode() for r in rows], np.array([r[1] for r in rows], np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    got = sampled.coalesce(1).mapInArrow(one, "model binary").collect()
    return bytes(got[0]["model"]) if got else fit([], np.zeros(0, np.float32))


def scored(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], threshold: float) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; ``score`` gets blocks of whole UTF-8 texts."""
    from pulsegrid.llm.common import text_blocks

    kept = [c for c in docs.columns if c not in ("score", "predicted", "held_out")]
    base = docs.select(*kept)
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [score(texts) for _, texts in text_blocks(b, "text")]
            s = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return (
        base.mapInArrow(run, schema)
        .withColumn("held_out", split_of("doc_id", SPLIT) == HELD_OUT)
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
