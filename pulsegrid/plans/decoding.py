"""Decoder policies on frame logits: beats of every policy, their scores, and what lies around missed beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators import scoring, signal
from pulsegrid.options import DECODER_POLICIES

FRAME_RATE = 50.0


def policy_beats(frames: DataFrame, policies=DECODER_POLICIES) -> DataFrame:
    """policy, track_id, frame: peaks of all policies from one pass of windows, grouped, midpoints recovered where a policy says so."""
    w = Window.partitionBy("track_id").orderBy("frame")
    tops = {r: F.max("logit").over(w.rowsBetween(-r, r)) for r in sorted({3, *(r for _, r, _, _ in policies)})}
    f = frames.withColumns({f"t{r}": top for r, top in tops.items()})
    rules = F.array(*[F.when((F.col("logit") > th) & (F.col("logit") >= F.col(f"t{r}")), p) for p, r, th, m in policies if not m])
    peaks = f.select("track_id", F.explode(F.array_compact(rules)).alias("policy"), "frame") if any(not m for *_, m in policies) else None
    case = F.struct("policy", "track_id")
    beats = None if peaks is None else signal.dedupe_peaks(peaks.select(case.alias("track_id"), "frame")).select("track_id.policy", "track_id.track_id", "frame")
    for p, r, th, m in policies:
        if m:
            upstream, candidates = signal.dedupe_peaks(signal.local_peaks(frames, r, th)), signal.dedupe_peaks(signal.local_peaks(frames, 3, -3.0))
            own = signal.recover_midpoints(upstream, candidates).select(F.lit(p).alias("policy"), "track_id", "frame")
            beats = own if beats is None else beats.unionByName(own)
    return beats


def policy_scores(frames: DataFrame, events: DataFrame, tolerance: float | DataFrame = 0.07, policies=DECODER_POLICIES) -> DataFrame:
    """policy, track_id and beat metrics: each policy's beats match ``events`` (track_id, time_s) one to one.

    ``tolerance`` is one number, or a table (track_id, tolerance).
    """
    names = F.explode(F.array(*[F.lit(p) for p, *_ in policies]))
    case = F.struct("policy", "track_id")
    if isinstance(tolerance, DataFrame):
        tolerance = tolerance.select("track_id", "tolerance", names.alias("policy")).select(case.alias("case"), "tolerance")
    predicted = policy_beats(frames, policies).select(case.alias("case"), signal.frame_time(F.col("frame")).alias("time_s"))
    expected = events.select("track_id", "time_s", names.alias("policy")).select(case.alias("case"), "time_s")
    m = scoring.beat_metrics(scoring.match_events(predicted, expected, tolerance, "case"), "case").select("case.policy", "case.track_id", "n_predicted", "n_expected", "matched", "precision", "recall", scoring.f1(F.col("precision"), F.col("recall")).alias("f1"))
    # A case with neither beats nor events is nothing out of nothing.
    every = frames.select("track_id").distinct().select("track_id", names.alias("policy"))
    return every.join(m, ["policy", "track_id"], "left").fillna(0, ["n_predicted", "n_expected", "matched"]).fillna(1.0, ["precision", "recall", "f1"])


def evidence(frames: DataFrame, events: DataFrame, tolerance: float | DataFrame = 0.07) -> DataFrame:
    """Per event (track_id, time_s): the strongest frame and the strongest radius-3 and radius-1 peaks within the tolerance, with offsets in ms,
    the frame's probability, and the class of the evidence. A range join by bins as wide as the widest tolerance."""
    w = Window.partitionBy("track_id").orderBy("frame")
    f = frames.withColumns({f"p{r}": F.when(F.col("logit") >= F.max("logit").over(w.rowsBetween(-r, r)), F.col("logit")) for r in (3, 1)})
    f = f.withColumn("at", F.col("frame") / FRAME_RATE)
    e = events.select("track_id", "time_s").distinct()
    e = e.join(tolerance, "track_id") if isinstance(tolerance, DataFrame) else e.withColumn("tolerance", F.lit(float(tolerance)))
    size = e.agg(F.max("tolerance")).first()[0] or 1.0
    bins = F.sequence(F.floor((F.col("time_s") - F.col("tolerance")) / size), F.floor((F.col("time_s") + F.col("tolerance")) / size))
    pairs = e.withColumn("_bin", F.explode(bins)).join(f.withColumn("_bin", F.floor(F.col("at") / size)), ["track_id", "_bin"]).where(F.abs(F.col("at") - F.col("time_s")) <= F.col("tolerance") + 1e-9)
    strongest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("logit"), (-F.abs(F.col("at") - F.col("time_s"))).alias("near"), F.col("at").alias("at"))))
    g = pairs.groupBy("track_id", "time_s").agg(strongest("logit").alias("top"), strongest("p3").alias("r3"), strongest("p1").alias("r1"))
    out = e.join(g, ["track_id", "time_s"], "left")
    offset = lambda c: ((F.col(f"{c}.at") - F.col("time_s")) * 1000).alias(f"{c}_offset_ms")
    return out.select(
        "track_id", "time_s", F.col("top.logit").alias("logit"), offset("top"), (1 / (1 + F.exp(-F.col("top.logit")))).alias("probability"), F.col("r3.logit").alias("radius3_logit"), offset("r3"),
        F.col("r1.logit").alias("radius1_logit"), offset("r1"), signal.classify_evidence(F.col("top.logit"), F.col("r3.logit"), F.col("r1.logit")).alias("evidence"),
    )


def recoverability(frames: DataFrame, events: DataFrame, tolerance: float | DataFrame = 0.07) -> DataFrame:
    """``evidence`` of the events that the upstream policy (radius 3 above 0) misses."""
    p = signal.dedupe_peaks(signal.local_peaks(frames)).select("track_id", signal.frame_time(F.col("frame")).alias("time_s"))
    m = scoring.match_events(p, events, tolerance, "track_id")
    return evidence(frames, scoring.missed_events(m, "track_id"), tolerance)
