"""Adapters from the test tables to event-sequence relations keyed by track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME_RATE = 50.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, idx, time_s, confidence, downbeat_confidence from ``events``: a user is a track; events without a time come last, as in SQL."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    track = Window.partitionBy("track_id")
    e = e.select(F.col("user_id").alias("track_id"), "event_id", "event_type", "value", micros.alias("us"))
    return e.select(
        "track_id",
        (F.row_number().over(track.orderBy(F.asc_nulls_last("us"), F.asc_nulls_last("event_id"))) - 1).cast("long").alias("idx"),
        ((F.col("us") - F.min("us").over(track)) / 1e6 / 50000).alias("time_s"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        F.when(F.col("event_type") == "purchase", 0.9).otherwise(0.1).alias("downbeat_confidence"),
        F.col("value").alias("rms"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, idx, time_s (0.05 s after each beat), rms, relative_db."""
    b = beats(spark, sf_dir)
    peak = F.max("rms").over(Window.partitionBy("track_id"))
    db = F.least(F.greatest(20 * F.log10(F.greatest(F.col("rms") / peak, F.lit(1e-6))), F.lit(-120.0)), F.lit(0.0))
    return b.select("track_id", "idx", (F.col("time_s") + 0.05).alias("time_s"), "rms", db.alias("relative_db"))


def tracks(b: DataFrame) -> DataFrame:
    """track_id, duration_s: one second past the last beat."""
    return b.groupBy("track_id").agg((F.max("time_s") + 1).alias("duration_s"))


def frames(spark: SparkSession, sf_dir: str, rounded: bool = False) -> DataFrame:
    """track_id, frame, logit: ten times the embedding's elements, 50 frames a second."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), F.posexplode("embedding").alias("frame", "x"))
    logit = F.col("x").cast("double") * 10
    return e.select("track_id", F.col("frame").cast("long").alias("frame"), (F.round(logit) if rounded else logit).alias("logit"))


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recipe_id, seg, duration_s, kind, start_bpm, end_bpm: four parts make one recipe."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    kind = F.when(F.col("p_partkey") % 5 == 4, "silence").when(F.col("p_partkey") % 5 == 2, "linear_ramp").otherwise("constant")
    start = (60 + 2 * F.col("p_size")).cast("double")
    return p.select(
        F.expr("p_partkey div 4").alias("recipe_id"),
        (F.col("p_partkey") % 4).cast("long").alias("seg"),
        (6 + F.col("p_size") % 7).cast("double").alias("duration_s"),
        kind.alias("kind"),
        start.alias("start_bpm"),
        F.when(kind == "linear_ramp", (60 + 2 * ((F.col("p_size") * 7) % 50)).cast("double")).otherwise(start).alias("end_bpm"),
        F.col("p_brand").alias("tag"),
    )


def predictions(truth_beats: DataFrame) -> DataFrame:
    """Jittered truth beats with every eleventh dropped, as (recipe_id, idx, time_s)."""
    jitter = (((F.col("beat_index") * 7919) % 13) - 6) * 0.012
    p = truth_beats.where(F.col("beat_index") % 11 != 10).select("recipe_id", (F.col("time_s") + jitter).alias("time_s"), "downbeat")
    order = Window.partitionBy("recipe_id").orderBy("time_s")
    return p.select("recipe_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "time_s", "downbeat")
