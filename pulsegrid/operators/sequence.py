"""Ordered-sequence operators: native windows over one partitioning by track."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import libm
from pulsegrid.options import EstimatorOptions

OPTIONS = EstimatorOptions()


def _track(*order: str):
    """The one partitioning of all these windows."""
    w = Window.partitionBy("track_id")
    return w.orderBy(*order) if order else w


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def finite_median(column: str) -> Column:
    """Median of the values that are finite; null if none is."""
    c = F.col(column)
    return F.median(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c))


def beat_events(beats: DataFrame) -> DataFrame:
    """Confidences clamped to [0, 1]; a downbeat where its confidence is one half at least."""
    return beats.select("track_id", "time_s", clamp(F.col("confidence")).alias("confidence"), clamp(F.col("downbeat_confidence")).alias("downbeat_confidence"), (F.col("downbeat_confidence") >= 0.5).alias("downbeat"))


def mirror(beats: DataFrame, tracks: DataFrame) -> DataFrame:
    """The time axis reversed: t becomes duration - t, first becomes last."""
    n = F.count("*").over(_track())
    return beats.withColumn("idx", n - 1 - F.col("idx")).join(tracks, "track_id").withColumn("time_s", F.col("duration_s") - F.col("time_s")).drop("duration_s")


def intervals(beats: DataFrame, o: EstimatorOptions = OPTIONS) -> DataFrame:
    """One row per gap: its seconds, raw and bounded tempo; a gap of zero is infinitely fast, as in SQL. Beats at one time keep their order by idx."""
    order = _track("time_s", "idx")
    dt = F.lead("time_s").over(order) - F.col("time_s")
    raw = F.when(F.col("dt") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(60.0), F.col("dt")))
    return (
        beats.select("track_id", "idx", "time_s", "confidence", F.lead("confidence").over(order).alias("next_confidence"), dt.alias("dt"))
        .where("dt IS NOT NULL")
        .withColumn("raw_bpm", raw)
        .withColumn("bounded_bpm", clamp(F.col("raw_bpm"), o.min_bpm, o.max_bpm))
    )


def context_medians(gaps: DataFrame, value: str = "bounded_bpm", o: EstimatorOptions = OPTIONS) -> DataFrame:
    """Medians of up to ``window // 2`` values on each side, the row itself left out."""
    r = o.smoothing_window // 2
    left = F.percentile(value, F.lit(0.5)).over(_track("idx").rowsBetween(-r, -1))
    right = F.percentile(value, F.lit(0.5)).over(_track("idx").rowsBetween(1, r))
    return gaps.withColumn("left_median", left).withColumn("right_median", right)


def octave_repair(gaps: DataFrame, o: EstimatorOptions = OPTIONS) -> DataFrame:
    """A lone value an octave or more off two agreeing contexts becomes their midpoint."""
    with_context = context_medians(gaps, "bounded_bpm", o)
    edge = F.lit(math.log1p(o.jump_ratio))
    left, right, v = F.col("left_median"), F.col("right_median"), F.col("bounded_bpm")
    offset = F.log2(v) - (F.log2(left) + F.log2(right)) / 2
    agree = F.abs(F.log(left / right)) <= edge
    octave = (F.abs(F.round(offset)) >= 1) & (F.abs(offset - F.round(offset)) <= F.log2(F.lit(1 + o.jump_ratio)))
    hit = F.coalesce(left.isNotNull() & right.isNotNull() & agree & octave, F.lit(False))
    return with_context.withColumn("repaired", hit).withColumn("repaired_bpm", F.when(hit, (left + right) / 2).otherwise(v))


def smooth_tempo(gaps: DataFrame, o: EstimatorOptions = OPTIONS) -> DataFrame:
    """Geometric mean over three values where they lie within the jump ratio; elsewhere unchanged."""
    near = _track("idx").rowsBetween(-1, 1)
    fixed = octave_repair(gaps, o)
    flat = (F.max("repaired_bpm").over(near) / F.min("repaired_bpm").over(near)) <= 1 + o.jump_ratio
    three = F.when(flat & (F.count("*").over(near) == 3), F.struct(F.lag("repaired_bpm").over(_track("idx")).alias("a"), F.col("repaired_bpm").alias("b"), F.lead("repaired_bpm").over(_track("idx")).alias("c")))
    mean = libm.geometric_mean(F.col("three.a"), F.col("three.b"), F.col("three.c"))
    return fixed.withColumn("three", three).withColumn("smoothed_bpm", F.coalesce(mean, "repaired_bpm")).drop("three")


def tempo_curve(gaps: DataFrame, o: EstimatorOptions = OPTIONS) -> DataFrame:
    """Tempo at the middle of each gap; confidence falls with the distance from the unsmoothed tempo."""
    s = smooth_tempo(gaps, o)
    conf = F.least("confidence", "next_confidence") * F.exp(-8 * F.abs(F.log2(F.col("bounded_bpm") / F.col("smoothed_bpm"))))
    return s.select("track_id", "idx", (F.col("time_s") + F.col("dt") / 2).alias("time_s"), F.col("smoothed_bpm").alias("bpm"), clamp(conf).alias("confidence"))


def global_bpm(curve: DataFrame) -> DataFrame:
    return curve.groupBy("track_id").agg(F.median("bpm").alias("global_bpm"))


def tempo_hypotheses(tempo: DataFrame, o: EstimatorOptions = OPTIONS) -> DataFrame:
    """Half, same and double tempo within bounds, with relative scores."""
    levels = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(s).alias("relative_score"), F.lit(k).alias("metrical_level")) for f, s, k in ((0.5, 0.5, -1), (1.0, 1.0, 0), (2.0, 0.5, 1))])
    h = tempo.select("track_id", "global_bpm", F.explode(levels).alias("h"))
    return h.select("track_id", (F.col("global_bpm") * F.col("h.factor")).alias("bpm"), "h.relative_score", "h.metrical_level").where(F.col("bpm").between(o.min_bpm, o.max_bpm))


def tempo_jumps(curve: DataFrame, o: EstimatorOptions = OPTIONS) -> DataFrame:
    """Points where the mean of the two tempos before differs from that of this and the next."""
    n = F.count("*").over(_track())
    c = curve.select("track_id", "idx", "time_s", "bpm", "confidence", (F.row_number().over(_track("idx")) - 1).alias("k"), n.alias("n"), F.lag("bpm", 1).over(_track("idx")).alias("b1"), F.lag("bpm", 2).over(_track("idx")).alias("b2"), F.lead("bpm", 1).over(_track("idx")).alias("a1"))
    before, after = (F.col("b2") + F.col("b1")) / 2, (F.col("bpm") + F.col("a1")) / 2
    ratio = F.abs(libm.log(after / before))
    return c.where((F.col("n") >= 5) & (F.col("k") >= 2) & (F.col("k") < F.col("n") - 2)).select("track_id", "time_s", before.alias("before_bpm"), after.alias("after_bpm"), clamp((ratio - math.log1p(o.jump_ratio)) / 0.25).alias("score"), ratio.alias("_r")).where(F.col("_r") >= math.log1p(o.jump_ratio)).drop("_r")


def long_gaps(gaps: DataFrame, o: EstimatorOptions = OPTIONS) -> DataFrame:
    """Gaps of over a second that exceed the median gap by the discontinuity factor."""
    typical = gaps.groupBy("track_id").agg(F.median("dt").alias("median_dt"))
    g = gaps.join(typical, "track_id").where((F.col("dt") > 1) & (F.col("dt") > o.discontinuity_factor * F.col("median_dt")))
    return g.select("track_id", (F.col("time_s") + F.col("dt") / 2).alias("time_s"), clamp(1 - F.col("median_dt") / F.col("dt")).alias("score"))


def silence_regions(activity: DataFrame, tracks: DataFrame, o: EstimatorOptions = OPTIONS) -> DataFrame:
    """Runs at or below the threshold, widened by half the median hop, long enough to count."""
    hop = F.lead("time_s").over(_track("time_s")) - F.col("time_s")
    quiet = F.col("relative_db") <= o.silence_threshold_db
    a = activity.select("track_id", "time_s", "relative_db", hop.alias("hop"), quiet.alias("quiet"), (F.row_number().over(_track("time_s")) - F.sum(quiet.cast("int")).over(_track("time_s"))).alias("island"))
    half = activity.select("track_id", hop.alias("hop")).groupBy("track_id").agg(F.median("hop").alias("hop"))
    runs = a.where("quiet").groupBy("track_id", "island").agg(F.min("time_s").alias("first_s"), F.max("time_s").alias("last_s"), F.min("relative_db").alias("low"))
    r = runs.join(half, "track_id").join(tracks, "track_id").withColumn("half", F.coalesce(F.col("hop"), F.greatest("duration_s", F.lit(0.001))) / 2)
    r = r.select("track_id", F.greatest(F.col("first_s") - F.col("half"), F.lit(0.0)).alias("start_s"), F.least(F.col("last_s") + F.col("half"), F.col("duration_s")).alias("end_s"), F.least("low", F.lit(0.0)).alias("depth_db"))
    return r.where(F.col("end_s") - F.col("start_s") >= o.min_silence_s)


def outside_silence(beats: DataFrame, regions: DataFrame) -> DataFrame:
    """Beats outside every silence: regions of a track do not overlap, so the last one begun decides."""
    marks = beats.select("track_id", "time_s", F.lit(1).alias("is_beat"), F.lit(None).cast("double").alias("until"), F.struct(*beats.columns).alias("row"))
    starts = regions.select("track_id", F.col("start_s").alias("time_s"), F.lit(0).alias("is_beat"), F.col("end_s").alias("until"), F.lit(None).cast(marks.schema["row"].dataType).alias("row"))
    w = _track().orderBy("time_s", "is_beat").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = marks.unionByName(starts).withColumn("until", F.last("until", ignorenulls=True).over(w))
    return m.where((F.col("is_beat") == 1) & (F.col("until").isNull() | (F.col("time_s") > F.col("until")))).select("row.*")


def nearest_activity(beats: DataFrame, activity: DataFrame) -> DataFrame:
    """Beats with the level of the nearest activity point; of two equally near, the earlier.

    An as-of join both ways by union and window: n log n for any number of points in a track.
    """
    point = F.struct(F.col("time_s").alias("t"), F.col("relative_db").alias("db"))
    none = F.lit(None).cast("struct<t:double,db:double>")
    b = beats.select("track_id", "time_s", F.lit(1).alias("k"), none.alias("p"), F.struct(*beats.columns).alias("row"))
    a = activity.select("track_id", "time_s", F.lit(0).alias("k"), point.alias("p"), F.lit(None).cast(b.schema["row"].dataType).alias("row"))
    order = _track().orderBy("time_s", "k")
    u = b.unionByName(a).withColumn("before", F.last("p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("p", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("after").isNull() | (F.col("time_s") - F.col("before.t") <= F.col("after.t") - F.col("time_s")), F.col("before.db")).otherwise(F.col("after.db"))
    return u.where("k = 1").select("row.*", near.alias("near_db"))


def salience(confidence: Column, db: Column) -> Column:
    """Confidence times amplitude; 1 stands for the amplitude where there is no activity."""
    return clamp(confidence) * F.coalesce(F.pow(F.lit(10.0), db / 20), F.lit(1.0))


def phase_salience(near: DataFrame) -> DataFrame:
    """Mean salience of even and odd beats."""
    return near.groupBy("track_id", (F.col("idx") % 2).alias("phase")).agg(F.avg(salience(F.col("confidence"), F.col("near_db"))).alias("salience"), F.count("*").alias("n_beats"))


def event_evidence(near: DataFrame) -> DataFrame:
    """Mean salience plus a quarter of the downbeat confidence, per track."""
    return near.groupBy("track_id").agg(F.avg(salience(F.col("confidence"), F.col("near_db")) + 0.25 * clamp(F.col("downbeat_confidence"))).alias("evidence"))


def metrical_level(near: DataFrame, gaps: DataFrame, o: EstimatorOptions = OPTIONS) -> DataFrame:
    """Decision per track whether every other beat goes: fast enough, and one phase clearly stronger."""
    raw = gaps.groupBy("track_id").agg(F.median("raw_bpm").alias("raw_median"))
    by_phase = phase_salience(near).groupBy("track_id").agg(F.max(F.when(F.col("phase") == 0, F.col("salience"))).alias("even"), F.max(F.when(F.col("phase") == 1, F.col("salience"))).alias("odd"), F.sum("n_beats").alias("n_beats"))
    d = by_phase.join(raw, "track_id")
    kept, other = F.greatest("even", "odd"), F.least("even", "odd")
    half = F.col("raw_median") / 2
    fold = (F.col("raw_median") >= o.half_time_min_bpm) & half.between(o.preferred_min_bpm, o.preferred_max_bpm) & (F.col("n_beats") >= 8) & (kept / F.greatest(other, F.lit(1e-9)) >= o.half_time_salience_ratio)
    return d.select("track_id", "raw_median", "even", "odd", F.when(F.col("even") >= F.col("odd"), 0).otherwise(1).alias("phase"), fold.alias("fold"))


def fold_beats(beats: DataFrame, decision: DataFrame) -> DataFrame:
    """Beats of the stronger phase where the track folds, all beats elsewhere."""
    return beats.join(decision.select("track_id", F.col("phase").alias("_p"), "fold"), "track_id").where(~F.col("fold") | (F.col("idx") % 2 == F.col("_p"))).select(*beats.columns)


def transfer_downbeats(beats: DataFrame, phase: int = 0) -> DataFrame:
    """Evidence of dropped beats goes, at nine tenths, to the nearest kept neighbour, the earlier of two."""
    kept = F.col("idx") % 2 == phase
    before, after = F.col("time_s") - F.lag("time_s").over(_track("time_s")), F.lead("time_s").over(_track("time_s")) - F.col("time_s")
    to = F.when(kept, F.col("idx")).when(after.isNull() | (before <= after), F.col("idx") - 1).otherwise(F.col("idx") + 1)
    own = F.when(kept, F.col("downbeat_confidence"))
    moved = F.when(~kept & (F.col("downbeat_confidence") >= 0.5), 0.9 * F.col("downbeat_confidence"))
    m = beats.select("track_id", to.alias("idx"), F.coalesce(own, moved).alias("v"), own.alias("own"))
    return m.groupBy("track_id", "idx").agg(F.max("v").alias("downbeat_confidence"), F.max("own").alias("own_confidence"))


def downbeat_runs(beats: DataFrame) -> DataFrame:
    """Runs of downbeats exactly two beats apart, by ordinal parity inside the run."""
    d = beats.where(F.col("downbeat_confidence") >= 0.5)
    new = F.coalesce((F.col("idx") - F.lag("idx").over(_track("idx")) != 2).cast("int"), F.lit(0))
    d = d.withColumn("run", F.sum(new).over(_track("idx")))
    return d.groupBy("track_id", "run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n_downbeats"))


def downbeat_spacing(beats: DataFrame) -> DataFrame:
    """Median index distance of downbeats; below two is inconsistent."""
    d = beats.where(F.col("downbeat_confidence") >= 0.5).select("track_id", (F.col("idx") - F.lag("idx").over(_track("idx"))).alias("gap"))
    return d.groupBy("track_id").agg((F.count("gap") + 1).alias("n_downbeats"), F.median("gap").alias("spacing"))


def violations(beats: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows that break the input contract, with a code: times finite, inside the track, strictly rising."""
    prev = F.lag("time_s").over(_track("idx"))
    b = beats.withColumn("prev", prev).join(tracks, "track_id")
    t = F.col("time_s")
    code = F.when(F.isnan(t), "not_finite").when((t < 0) | (t > F.col("duration_s")), "out_of_range").when(t <= F.col("prev"), "unsorted")
    return b.select("track_id", "idx", "time_s", code.alias("code")).where("code IS NOT NULL")


def diagnostics(beats: DataFrame, near: DataFrame, gaps: DataFrame, low_db: float = -40.0) -> DataFrame:
    """Counts, levels and phase statistics of a track's observations."""
    t = near.groupBy("track_id").agg(
        F.count("*").alias("n_beats"),
        F.count_if(F.col("downbeat_confidence") >= 0.5).alias("n_downbeats"),
        F.min("near_db").alias("min_db"),
        (F.count_if(F.coalesce("near_db", F.lit(0.0)) <= low_db) / F.count("*")).alias("low_fraction"),
        F.avg(F.when(F.col("idx") % 2 == 0, F.col("confidence"))).alias("even_confidence"),
        F.avg(F.when(F.col("idx") % 2 == 1, F.col("confidence"))).alias("odd_confidence"),
    )
    return t.join(gaps.groupBy("track_id").agg(finite_median("raw_bpm").alias("raw_median_bpm")), "track_id", "left")


def dedupe_changes(changes: DataFrame, within: float = 0.75, key: str = "track_id") -> DataFrame:
    """Adjacent same-kind changes closer than ``within`` keep the stronger; a native fold in time order.

    Each is compared with the last one kept, which a stronger one replaces, time and all.
    """
    item = "struct<time_s:double,kind:string,score:double>"
    c = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("time_s", "kind", "score"))).alias("c"))
    fold = F.expr(
        f"aggregate(c, named_struct('out', CAST(array() AS array<{item}>), 'last', CAST(NULL AS {item})), (s, x) -> "
        f"CASE WHEN s.last IS NULL THEN named_struct('out', s.out, 'last', x) WHEN s.last.kind = x.kind AND x.time_s - s.last.time_s < {within!r}D THEN "
        "named_struct('out', s.out, 'last', CASE WHEN x.score > s.last.score THEN x ELSE s.last END) ELSE named_struct('out', array_append(s.out, s.last), 'last', x) END, "
        "s -> CASE WHEN s.last IS NULL THEN s.out ELSE array_append(s.out, s.last) END)"
    )
    return c.select(key, F.explode(fold).alias("x")).select(key, "x.*")


def section_boundaries(changes: DataFrame, tracks: DataFrame, within: float = 0.5, key: str = "track_id") -> DataFrame:
    """0, the changes and the end, without those closer than ``within`` to the last one kept; a native fold."""
    times = changes.groupBy(key).agg(F.collect_list("time_s").alias("t"))
    j = tracks.join(times, key, "left").select(key, F.array_sort(F.concat(F.array(F.lit(0.0), F.col("duration_s")), F.coalesce("t", F.expr("CAST(array() AS array<double>)")))).alias("t"))
    fold = F.expr(f"aggregate(t, CAST(array() AS array<double>), (s, x) -> CASE WHEN size(s) = 0 OR abs(x - element_at(s, -1)) >= {within!r}D THEN array_append(s, x) ELSE s END)")
    return j.select(key, F.posexplode(fold).alias("ord", "time_s"))


def rhythm_sections(boundaries: DataFrame, curve: DataFrame, beats: DataFrame, key: str = "track_id") -> DataFrame:
    """Median tempo, stability and beat count between boundaries, ends exclusive.

    Points find their section by union and window, so a track may have any number of sections.
    """
    w = Window.partitionBy(key).orderBy("ord")
    b = boundaries.select(key, "ord", F.col("time_s").alias("start_s"), F.lead("time_s").over(w).alias("end_s"))
    marks = b.select(key, F.col("start_s").alias("at"), F.lit(0).alias("k"), "ord", F.lit(None).cast("double").alias("bpm"))
    points = curve.select(key, F.col("time_s").alias("at"), F.lit(1).alias("k"), F.lit(None).cast("int").alias("ord"), "bpm")
    events = beats.select(key, F.col("time_s").alias("at"), F.lit(2).alias("k"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("double").alias("bpm"))
    seq = Window.partitionBy(key).orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    u = marks.unionByName(points).unionByName(events).withColumn("ord", F.last("ord", ignorenulls=True).over(seq)).where("k > 0")
    per = Window.partitionBy(key, "ord")
    u = u.withColumn("mid", F.median("bpm").over(per))
    s = u.groupBy(key, "ord").agg(F.first("mid").alias("bpm"), F.avg(F.abs(F.log2(F.col("bpm") / F.col("mid")))).alias("dev"), F.count_if(F.col("k") == 2).alias("beat_count"))
    out = b.where("end_s > start_s").join(s, [key, "ord"], "left")
    return out.select(key, "start_s", "end_s", "bpm", F.coalesce(clamp(1 - 8 * F.col("dev")), F.lit(0.0)).alias("stability"), F.coalesce("beat_count", F.lit(0)).alias("beat_count"))
