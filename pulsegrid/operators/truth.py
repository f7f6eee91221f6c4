"""Analytic truth from recipes, and what truth says at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.options import LN_TRUTH_JUMP



def _segs():
    return Window.partitionBy("recipe_id").orderBy("seg")


def timeline(recipes: DataFrame) -> DataFrame:
    """Recipe segments with their start and end on the recipe's time axis."""
    end = F.sum("duration_s").over(_segs().rowsBetween(Window.unboundedPreceding, 0))
    return recipes.withColumn("end_s", end).withColumn("start_s", F.col("end_s") - F.col("duration_s"))


def truth_beats(recipes: DataFrame, beats_per_bar: int = 4) -> DataFrame:
    """recipe_id, beat_index, time_s, downbeat: beats at whole phases of each segment, none in silence.

    A column ``beats_per_bar`` of the recipes goes before the argument.
    """
    t = timeline(recipes).where("kind <> 'silence'")
    mean = F.col("duration_s") * (F.col("start_bpm") + F.col("end_bpm")) / 120
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.floor(mean).cast("int"))).alias("k"))
    slope = (F.col("end_bpm") - F.col("start_bpm")) / F.col("duration_s")
    ramp = (-F.col("start_bpm") + F.sqrt(F.greatest(F.col("start_bpm") ** 2 + 120 * slope * F.col("k"), F.lit(0.0)))) / slope
    at = F.when((F.col("kind") == "linear_ramp") & (F.col("start_bpm") != F.col("end_bpm")), ramp).otherwise(60.0 * F.col("k") / F.col("start_bpm"))
    t = t.withColumn("at", at).where(F.col("at") < F.col("duration_s") - 1e-9)
    order = Window.partitionBy("recipe_id").orderBy("seg", "k")
    bar = F.col("beats_per_bar") if "beats_per_bar" in recipes.columns else F.lit(beats_per_bar)
    t = t.select("recipe_id", (F.row_number().over(order) - 1).cast("long").alias("beat_index"), (F.col("start_s") + F.col("at")).alias("time_s"), bar.alias("bar"))
    prev = F.lag("time_s").over(Window.partitionBy("recipe_id").orderBy("beat_index"))
    t = t.withColumn("prev", prev).where(F.col("prev").isNull() | (F.abs(F.col("time_s") - F.col("prev")) > 1e-9)).drop("prev")
    return t.withColumn("downbeat", F.col("beat_index") % F.col("bar") == 0).drop("bar")


def truth_segments(recipes: DataFrame) -> DataFrame:
    """Tempo segments on the time axis; silence has none."""
    kind = F.when(F.col("kind") == "linear_ramp", "ramp").otherwise("constant")
    return timeline(recipes).where("kind <> 'silence'").select("recipe_id", "seg", "start_s", "end_s", kind.alias("kind"), "start_bpm", "end_bpm")


def truth_changes(recipes: DataFrame) -> DataFrame:
    """Middle of each silence; at other boundaries a jump, or a ramp boundary where ramp-ness differs."""
    t = timeline(recipes)
    silent = F.col("kind") == "silence"
    island = F.row_number().over(_segs()) - F.sum(silent.cast("int")).over(_segs())
    quiet = t.withColumn("g", island).where(silent).groupBy("recipe_id", "g").agg(((F.min("start_s") + F.max("end_s")) / 2).alias("time_s")).select("recipe_id", "time_s", F.lit("rhythm_discontinuity").alias("kind"))
    b = t.withColumn("pk", F.lag("kind").over(_segs())).withColumn("pe", F.lag("end_bpm").over(_segs())).where(~silent & F.col("pk").isNotNull() & (F.col("pk") != "silence"))
    jump = F.abs(F.log(F.col("start_bpm") / F.col("pe"))) > LN_TRUTH_JUMP
    kind = F.when(jump, "tempo_jump").when((F.col("kind") == "linear_ramp") != (F.col("pk") == "linear_ramp"), "ramp_boundary")
    return quiet.unionByName(b.select("recipe_id", F.col("start_s").alias("time_s"), kind.alias("kind")).where("kind IS NOT NULL"))


def tempo_at(points: DataFrame, segments: DataFrame, key: str = "recipe_id") -> DataFrame:
    """``points`` (key, time_s, ...) with the truth tempo: first segment that holds the time, both ends included.

    Segments of a recipe do not overlap, so the two last begun by union and window are enough.
    """
    seg = F.struct("start_s", "end_s", "start_bpm", "end_bpm")
    p = points.select(key, "time_s", F.lit(1).alias("k"), F.struct(*points.columns).alias("row"))
    s = segments.select(key, F.col("start_s").alias("time_s"), F.lit(0).alias("k"), F.lit(None).cast(p.schema["row"].dataType).alias("row"), seg.alias("seg"))
    s = s.withColumn("prev", F.lag("seg").over(Window.partitionBy(key).orderBy("time_s")))
    u = s.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("time_s", "k").rowsBetween(Window.unboundedPreceding, 0)
    both = F.last(F.when(F.col("k") == 0, F.struct("seg", "prev")), ignorenulls=True).over(w)
    u = u.withColumn("both", both).where("k = 1")
    t = F.col("time_s")
    use = F.when(F.col("both.prev").isNotNull() & (t <= F.col("both.prev.end_s")), F.col("both.prev")).when(t <= F.col("both.seg.end_s"), F.col("both.seg"))
    u = u.withColumn("s", use)
    share = (t - F.col("s.start_s")) / (F.col("s.end_s") - F.col("s.start_s"))
    return u.select("row.*", (F.col("s.start_bpm") + (F.col("s.end_bpm") - F.col("s.start_bpm")) * share).alias("truth_bpm"))


def ideal_observations(truth: DataFrame) -> DataFrame:
    return truth.select("recipe_id", "time_s", F.lit(1.0).alias("confidence"), F.when(F.col("downbeat"), 1.0).otherwise(0.0).alias("downbeat_confidence"))


def recipe_violations(recipes: DataFrame, max_duration_s: float = 3600.0, max_bpm: float = 1000.0) -> DataFrame:
    """recipe_id, longest_s, code: the first thing wrong with each recipe: a sample rate below 8000 or no beats in a bar (where the recipes
    have these columns), a segment that is not finite, not positive or longer than an hour, a tempo outside (0, 1000] that is not silent."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    d = F.col("duration_s")
    loud = F.col("kind") != "silence"
    tempo = lambda c: finite(F.col(c)) & (F.col(c) > 0) & (F.col(c) <= max_bpm)
    checks = {"bad_sample_rate": F.col("sample_rate") >= 8000 if "sample_rate" in recipes.columns else F.lit(True), "bad_beats_per_bar": F.col("beats_per_bar") > 0 if "beats_per_bar" in recipes.columns else F.lit(True)}
    checks |= {"bad_duration": finite(d) & (d > 0) & (d <= max_duration_s), "bpm_out_of_range": ~loud | (tempo("start_bpm") & tempo("end_bpm"))}
    r = recipes.groupBy("recipe_id").agg(F.max("duration_s").alias("longest_s"), *[F.bool_and(F.coalesce(ok, F.lit(False))).alias(k) for k, ok in checks.items()])
    code = F.coalesce(*[F.when(~F.col(k), k) for k in checks])
    return r.select("recipe_id", "longest_s", code.alias("code")).where("code IS NOT NULL")


def segment_overlaps(segments: DataFrame) -> DataFrame:
    """Segments that begin before their predecessor ends."""
    nxt = F.lead("start_s").over(Window.partitionBy("recipe_id").orderBy("start_s"))
    return segments.withColumn("next_start", nxt).where(F.col("next_start") < F.col("end_s"))
