"""One query per training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import decontam, html, jaccard, langid, media, packing, pii, quality, secrets, toxicity
from pulsegrid.llm.common import bound_batches, read


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return media.media(read(spark, sf_dir, "documents")).select(*cols)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return packing.pack(read(spark, sf_dir, "documents")).select(*cols)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(read(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = langid.language_id(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return got.select("doc_id", "held_out", "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with Arrow batches bounded by bytes, also where the caller runs the returned plan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_chunks": op1_media,
    "op2_best_fit_packing": op2_packing,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_html_text": op4_html_text,
    "op5_language_id": op5_language_id,
    "op6_toxicity_ftrl": op6_toxicity,
    "op7_personal_data": op7_personal_data,
    "op8_decontamination": op8_decontamination,
    "op9_quality_cnn": op9_quality,
    "op10_linked_secrets": op10_secrets,
}
QUERIES = {name: _bounded(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {}
