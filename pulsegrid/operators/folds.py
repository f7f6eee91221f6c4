"""Order-dependent repairs of single tracks as grouped functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import estimator as e
from pulsegrid.functions import libm
from pulsegrid.options import EstimatorOptions, estimator_policy


def polyline_knots(curve: DataFrame, o: EstimatorOptions = EstimatorOptions()) -> DataFrame:
    """Points of the curve that the simplified polyline keeps."""

    def run(pdf):
        p = pdf.sort_values(["time_s", "idx"]).reset_index(drop=True)
        return p.iloc[e.simplify(p.time_s.tolist(), p.bpm.tolist(), o.curve_tolerance_octaves)]

    return curve.select("track_id", "idx", "time_s", "bpm").groupBy("track_id").applyInPandas(run, "track_id long, idx long, time_s double, bpm double")


def tempo_segments(curve: DataFrame, tracks: DataFrame, o: EstimatorOptions = EstimatorOptions()) -> DataFrame:
    """Constant and ramp segments between the knots; a ratio of 1.03 itself is constant, as ln(1.03) in SQL has it (log1p(0.03) lies a bit below)."""
    import pandas as pd

    edge = math.log(1 + o.constant_ratio)

    def run(pdf):
        p = pdf.sort_values(["time_s", "idx"])
        s = e.build_segments(p.time_s.tolist(), p.bpm.tolist(), p.confidence.tolist(), float(p.duration_s.iloc[0]), o, edge)
        return pd.DataFrame([(p.track_id.iloc[0], i, x.start, x.end, x.kind, x.start_bpm, x.end_bpm, x.conf) for i, x in enumerate(s)], columns="track_id seg start_s end_s kind start_bpm end_bpm confidence".split())

    joined = curve.join(tracks, "track_id").select("track_id", "idx", "time_s", "bpm", "confidence", "duration_s")
    return joined.groupBy("track_id").applyInPandas(run, "track_id long, seg long, start_s double, end_s double, kind string, start_bpm double, end_bpm double, confidence double")


def segment_transitions(segments: DataFrame, o: EstimatorOptions = EstimatorOptions()) -> DataFrame:
    """Blocks of ramps, short constants between two ramps bridged, that change the tempo: islands by windows. low_s and high_s are where the segment
    before a block starts and where the one behind it ends, null without one; log_ratio is how far the tempos stand apart."""
    w = Window.partitionBy("track_id").orderBy("seg")
    ramp = F.col("kind") == "ramp"
    short = (F.col("end_s") - F.col("start_s")) * (F.col("start_bpm") + F.col("end_bpm")) / 2 / 60 < 6
    bridge = (F.lag("kind").over(w) == "ramp") & (F.lead("kind").over(w) == "ramp") & short
    s = segments.withColumns({"inside": ramp | F.coalesce(bridge, F.lit(False)), "prev": F.lag("end_bpm").over(w), "next": F.lead("start_bpm").over(w), "low_s": F.lag("start_s").over(w), "high_s": F.lead("end_s").over(w)})
    s = s.withColumn("block", F.col("seg") - F.sum(F.col("inside").cast("int")).over(w)).where("inside")
    first, last = F.min(F.struct("seg", "start_s", "start_bpm", "prev", "low_s")), F.max(F.struct("seg", "end_s", "end_bpm", "next", "high_s"))
    g = s.groupBy("track_id", "block").agg(first.alias("a"), last.alias("b"), F.avg("confidence").alias("confidence"))
    outer = [F.coalesce("a.prev", "a.start_bpm").alias("before_bpm"), F.coalesce("b.next", "b.end_bpm").alias("after_bpm")]
    inner = [F.col("a.start_bpm").alias("first_bpm"), F.col("b.end_bpm").alias("last_bpm"), F.col("a.prev").isNotNull().alias("has_before"), F.col("b.next").isNotNull().alias("has_after")]
    g = g.select("track_id", "a.start_s", "b.end_s", *outer, "confidence", *inner, F.col("a.seg").alias("first_seg"), F.col("b.seg").alias("last_seg"), "a.low_s", "b.high_s")
    # ln(1.12) as SQL has it, not log1p(0.12), which lies below the logarithm of one ratio that SQL leaves out.
    return g.withColumn("log_ratio", F.abs(libm.log(F.col("after_bpm") / F.col("before_bpm")))).where(F.col("log_ratio") >= math.log(1 + o.jump_ratio))


def transition_changes(transitions: DataFrame, o: EstimatorOptions = EstimatorOptions()) -> DataFrame:
    """track_id, time_s, kind, score, before_bpm, after_bpm: a short transition between two segments is one jump at its start, any other a ramp
    boundary at each end that has a neighbour. A jump's score takes the logarithm that found it, the C library's, since a tie at the last place shown
    follows its last bit."""
    short = F.col("has_before") & F.col("has_after") & (F.col("end_s") - F.col("start_s") <= o.jump_transition_max_s)
    score = F.least(F.greatest(F.col("confidence") * F.col("log_ratio") / 0.25, F.lit(0.0)), F.lit(1.0))

    def change(when, at, kind, score, before, after):
        return F.when(when, F.struct(F.col(at).alias("time_s"), F.lit(kind).alias("kind"), score.alias("score"), F.col(before).alias("before_bpm"), F.col(after).alias("after_bpm")))

    rows = F.array(
        change(short, "start_s", "tempo_jump", score, "before_bpm", "after_bpm"),
        change(~short & F.col("has_before"), "start_s", "ramp_boundary", F.col("confidence"), "before_bpm", "first_bpm"),
        change(~short & F.col("has_after"), "end_s", "ramp_boundary", F.col("confidence"), "last_bpm", "after_bpm"),
    )
    return transitions.select("track_id", F.explode(F.array_compact(rows)).alias("c")).select("track_id", "c.*")


def beats_beside(beats: DataFrame, transitions: DataFrame) -> DataFrame:
    """track_id, first_seg, side, time_s: beats of the segments before and after each transition, from the former's start up to the transition, and
    from behind the transition to the latter's end; no beat where there is no such segment. The transitions bring both ranges along, so segments are
    built once. A track has few transitions; the join is on the track with the two ranges."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(low).alias("low"), F.col(high).alias("high")) for side, low, high in (("left", "low_s", "start_s"), ("right", "end_s", "high_s"))])
    ranges = transitions.select("track_id", "first_seg", F.explode(sides).alias("r")).select("track_id", "first_seg", "r.*")
    t = F.col("time_s")
    within = ((F.col("side") == "left") & (t >= F.col("low")) & (t < F.col("high"))) | ((F.col("side") == "right") & (t > F.col("low")) & (t <= F.col("high")))
    return beats.select("track_id", "time_s").join(ranges, "track_id").where(within).select("track_id", "first_seg", "side", "time_s")


def repair_runs(gaps: DataFrame, o: EstimatorOptions | None = None) -> DataFrame:
    """Bounded tempos with short octave runs interpolated."""
    o = o or estimator_policy("metrical-consistency-v1")

    def run(pdf):
        p = pdf.sort_values("idx").reset_index(drop=True)
        v = p.bounded_bpm.tolist()
        e.repair_runs(v, o.max_metrical_outlier_run, o.jump_ratio, o.smoothing_window // 2)
        return p.assign(repaired_bpm=v)[["track_id", "idx", "repaired_bpm"]]

    return gaps.select("track_id", "idx", "bounded_bpm").groupBy("track_id").applyInPandas(run, "track_id long, idx long, repaired_bpm double")


def repair_jitter(gaps: DataFrame, o: EstimatorOptions = EstimatorOptions()) -> DataFrame:
    """Raw tempos with pairs of gaps around a stable period set to their mean."""

    def run(pdf):
        p = pdf.sort_values("idx").reset_index(drop=True)
        v = p.raw_bpm.tolist()
        e.repair_jitter(p.dt.tolist(), v, o.jump_ratio)
        return p.assign(repaired_bpm=v)[["track_id", "idx", "repaired_bpm"]]

    return gaps.select("track_id", "idx", "dt", "raw_bpm").groupBy("track_id").applyInPandas(run, "track_id long, idx long, repaired_bpm double")


def longest_fits(beats: DataFrame) -> DataFrame:
    """Beats of each track's longest prefix and suffix that a grid fits, null for none."""
    import pandas as pd

    def run(pdf):
        t = sorted(pdf.time_s.tolist())
        return pd.DataFrame({"track_id": [pdf.track_id.iloc[0]], "longest_prefix": pd.array([e.longest_prefix(t)], "Int64"), "longest_suffix": pd.array([e.longest_suffix(t)], "Int64")})

    return beats.select("track_id", "time_s").groupBy("track_id").applyInPandas(run, "track_id long, longest_prefix long, longest_suffix long")


def _observations(p) -> e.Observations:
    p = p.sort_values("time_s")
    beats = [e.Beat(*r) for r in zip(p.time_s, p.confidence, p.downbeat_confidence)]
    return e.Observations(float(p.duration_s.iloc[0]), beats, sorted(zip(p.activity_s, p.relative_db)))


_BEATS = "track_id long, time_s double, confidence double, downbeat_confidence double"


def _beats(beats: DataFrame, change) -> DataFrame:
    """Apply ``change`` to the observations of each track and return their beats."""
    import pandas as pd

    def run(pdf):
        o = _observations(pdf)
        change(o)
        return pd.DataFrame([(pdf.track_id.iloc[0], b.t, b.conf, b.down) for b in o.beats], columns="track_id time_s confidence downbeat_confidence".split())

    columns = ["track_id", "time_s", "confidence", "downbeat_confidence", "duration_s", "activity_s", "relative_db"]
    return beats.select(*columns).groupBy("track_id").applyInPandas(run, _BEATS)


def edge_double_time(beats: DataFrame) -> DataFrame:
    """Beats without the double-time extras at either end."""
    return _beats(beats, e.repair_edges)


def bar_level_downbeats(beats: DataFrame, o: EstimatorOptions = EstimatorOptions()) -> DataFrame:
    """Half-bar downbeat runs reduced to their stronger phase, boundary downbeats realigned."""
    return _beats(beats, lambda x: e.select_downbeats(x, o))


def recover_grids(beats: DataFrame, o: EstimatorOptions = EstimatorOptions()) -> DataFrame:
    """Beats of short transitions redrawn on the grids of the stable parts around them."""

    def change(x: e.Observations) -> None:
        if len(x.beats) < 3:
            return
        segments = e.estimate_tempo(x, o).segments
        for block in e.transitions(segments, o.jump_ratio):
            if (new := e.recover_grid(x.beats, segments, block, o)) is not None:
                x.beats = new

    return _beats(beats, change)
