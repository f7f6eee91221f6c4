"""Frame signals: down-mixing, activity, peak picking and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.options import MidpointOptions



def _frames():
    return Window.partitionBy("track_id").orderBy("frame")


def downmix(samples: DataFrame, channels: int) -> DataFrame:
    """Interleaved samples (track_id, frame, logit) to the mean of their channels, summed in single precision."""
    total = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("frame", F.col("logit").cast("float").alias("x")))), lambda s: s["x"]), F.lit(0.0).cast("float"), lambda a, x: (a + x).cast("float"))
    return samples.groupBy("track_id", F.expr(f"frame div {channels}").alias("frame")).agg((total / F.lit(float(channels)).cast("float")).cast("float").alias("value"))


def rms_activity(samples: DataFrame, rate: int) -> DataFrame:
    """RMS in windows of rate // 10 samples about every rate // 20, and dB against the loudest window."""
    half, hop = max(1, rate // 10) // 2, max(1, rate // 20)
    w = _frames().rowsBetween(-half, half)
    r = samples.withColumn("rms", F.sqrt(F.avg(F.col("logit") * F.col("logit")).over(w))).where(F.col("frame") % hop == 0)
    peak = F.max("rms").over(Window.partitionBy("track_id"))
    db = F.when(peak <= 2.220446049250313e-16, F.lit(-120.0)).otherwise(F.least(F.greatest(20 * F.log10(F.greatest(F.col("rms") / peak, F.lit(1e-6))), F.lit(-120.0)), F.lit(0.0)))
    return r.select("track_id", "frame", (F.col("frame") / float(rate)).alias("time_s"), "rms", db.alias("relative_db"))


def local_peaks(frames: DataFrame, radius: int = 3, threshold: float = 0.0) -> DataFrame:
    """Frames above the threshold that no neighbour within ``radius`` exceeds."""
    top = F.max("logit").over(_frames().rowsBetween(-radius, radius))
    return frames.withColumn("top", top).where((F.col("logit") >= F.col("top")) & (F.col("logit") > threshold)).drop("top")


def dedupe_peaks(peaks: DataFrame, width: float = 1.0) -> DataFrame:
    """Peaks within ``width`` of the running mean of their group become that mean; a native fold."""
    p = peaks.groupBy("track_id").agg(F.array_sort(F.collect_list(F.col("frame").cast("double"))).alias("f"))
    fold = F.expr(
        "aggregate(f, named_struct('out', CAST(array() AS array<double>), 'm', CAST(NULL AS double), 'n', 0), (s, x) -> "
        f"CASE WHEN s.m IS NULL THEN named_struct('out', s.out, 'm', x, 'n', 1) WHEN x - s.m <= {width!r}D THEN named_struct('out', s.out, 'm', s.m + (x - s.m) / (s.n + 1), 'n', s.n + 1) "
        "ELSE named_struct('out', array_append(s.out, s.m), 'm', x, 'n', 1) END, s -> CASE WHEN s.m IS NULL THEN s.out ELSE array_append(s.out, s.m) END)"
    )
    return p.select("track_id", F.explode(fold).alias("frame"))


def frame_time(frame):
    """Seconds of a frame at 50 frames a second, rounded through single precision."""
    return (frame / 50.0).cast("float").cast("double")


def decode(beat_peaks: DataFrame, frames: DataFrame, downbeat_times: DataFrame | None = None) -> DataFrame:
    """Peaks to observations: time, sigmoid of the logit at the rounded frame, downbeat within 0.07 s."""
    t = beat_peaks.select("track_id", frame_time(F.col("frame")).alias("time_s"))
    last = frames.groupBy("track_id").agg(F.max("frame").alias("last"))
    t = t.join(last, "track_id").withColumn("frame", F.least(F.round(F.col("time_s") * 50).cast("long"), F.col("last")))
    o = t.join(frames, ["track_id", "frame"], "left").select("track_id", "time_s", F.coalesce(1 / (1 + F.exp(-F.col("logit"))), F.lit(0.5)).alias("confidence"))
    if downbeat_times is None:
        return o.withColumn("downbeat", F.lit(False))
    return with_downbeats(o, downbeat_times)


def with_downbeats(beats: DataFrame, downbeats: DataFrame, within: float = 0.07) -> DataFrame:
    """Whether any downbeat lies within ``within`` seconds: the nearest on each side, by union and window."""
    b = beats.select("track_id", "time_s", F.lit(1).alias("k"), F.struct(*beats.columns).alias("row"))
    d = downbeats.select("track_id", "time_s", F.lit(0).alias("k"), F.lit(None).cast(b.schema["row"].dataType).alias("row"))
    w = Window.partitionBy("track_id").orderBy("time_s", "k")
    mark = F.when(F.col("k") == 0, F.col("time_s"))
    u = b.unionByName(d).withColumn("l", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = F.coalesce(F.col("time_s") - F.col("l") <= within, F.lit(False)) | F.coalesce(F.col("r") - F.col("time_s") <= within, F.lit(False))
    return u.where("k = 1").select("row.*", near.alias("downbeat"))


def snap_downbeats(downbeats: DataFrame, beats: DataFrame) -> DataFrame:
    """Downbeats moved to the nearest beat, the earlier of two, without repeats."""
    d = downbeats.select("track_id", "time_s", F.lit(1).alias("k"))
    b = beats.select("track_id", "time_s", F.lit(0).alias("k"))
    w = Window.partitionBy("track_id").orderBy("time_s", "k")
    mark = F.when(F.col("k") == 0, F.col("time_s"))
    u = b.unionByName(d).withColumn("l", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    to = F.when(F.col("r").isNull() | (F.col("time_s") - F.col("l") <= F.col("r") - F.col("time_s")), F.col("l")).otherwise(F.col("r"))
    return u.where("k = 1").select("track_id", to.alias("time_s")).where("time_s IS NOT NULL").distinct()


def recover_midpoints(upstream: DataFrame, candidates: DataFrame, o: MidpointOptions = MidpointOptions()) -> DataFrame:
    """Peaks plus candidates near the middle of a gap where enough neighbouring gaps have one too."""
    w = Window.partitionBy("track_id").orderBy("frame")
    gaps = upstream.select("track_id", F.col("frame").alias("left_f"), F.lead("frame").over(w).alias("right_f"), (F.row_number().over(w) - 1).alias("g")).where("right_f IS NOT NULL")
    c = candidates.select("track_id", F.col("frame").alias("c"))
    u = gaps.select("track_id", F.col("left_f").alias("at"), F.lit(0).alias("k"), F.struct("left_f", "right_f", "g").alias("gap"), F.lit(None).cast("double").alias("c"))
    v = c.select("track_id", F.col("c").cast("double").alias("at"), F.lit(1).alias("k"), F.lit(None).cast(u.schema["gap"].dataType).alias("gap"), F.col("c").cast("double").alias("c"))
    seq = Window.partitionBy("track_id").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    inside = u.unionByName(v).withColumn("gap", F.last("gap", ignorenulls=True).over(seq)).where("k = 1 AND gap IS NOT NULL").select("track_id", "gap.*", "c")
    wide = F.col("right_f") - F.col("left_f")
    off = F.abs(F.col("c") - (F.col("left_f") + F.col("right_f")) / 2)
    fits = (wide > 2) & (F.col("c") > F.col("left_f") + 1) & (F.col("c") < F.col("right_f") - 1) & (off <= o.max_ratio * wide)
    best = inside.where(fits).groupBy("track_id", "g").agg(F.min_by("c", F.struct(off, F.col("c"))).alias("c"))
    near = Window.partitionBy("track_id").orderBy("g").rowsBetween(-o.radius, o.radius)
    found = gaps.join(best, ["track_id", "g"], "left").withColumn("support", F.count("c").over(near)).where((F.col("support") >= o.min_support) & F.col("c").isNotNull())
    return upstream.select("track_id", F.col("frame").cast("double").alias("frame")).unionByName(found.select("track_id", F.col("c").alias("frame"))).distinct()


def classify_evidence(strongest, radius3, radius1):
    """Why a beat was missed, from the strongest frame near it and its strongest local peaks."""
    return (
        F.when(strongest.isNull(), "no_frame")
        .when(radius3 > 0, "radius3_peak_above_0")
        .when(radius3 > -1, "radius3_peak_above_minus1")
        .when(radius3.isNotNull(), "radius3_peak_below_minus1")
        .when(radius1.isNotNull(), "radius1_only_peak")
        .otherwise("no_local_peak")
    )
