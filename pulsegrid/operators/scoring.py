"""Evaluation: one-to-one matches, nearest-rank percentiles, gates, slices and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d; nothing out of nothing is 1."""
    return F.when(d == 0, F.lit(1.0)).otherwise(n / d)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def nearest_rank(values: Column, q: float) -> Column:
    """Element ceil((n - 1) q) of a sorted array of values; null if empty."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), (F.ceil((n - 1) * q) + 1).cast("int")))


def _limits(both: DataFrame, tolerance: float | DataFrame, key: str) -> DataFrame:
    """``both`` with the tolerance of each key: one for all, or a table (key, tolerance)."""
    if isinstance(tolerance, DataFrame):
        return both.join(tolerance.select(key, F.col("tolerance").alias("_within")), key)
    return both.withColumn("_within", F.lit(float(tolerance)))


def match_events(predicted: DataFrame, expected: DataFrame, tolerance: float | DataFrame, key: str = "recipe_id") -> DataFrame:
    """key, pairs: greedy one-to-one matches of two ordered lists, both advanced on a match.

    A native fold over each key's arrays; both sides meet on one shuffle by key, never by a broadcast of arrays.
    """
    p = predicted.groupBy(key).agg(F.array_sort(F.collect_list("time_s")).alias("p"))
    e = expected.groupBy(key).agg(F.array_sort(F.collect_list("time_s")).alias("e"))
    both = e.join(p.hint("merge"), key, "full").select(key, F.coalesce("p", F.expr("CAST(array() AS array<double>)")).alias("p"), F.coalesce("e", F.expr("CAST(array() AS array<double>)")).alias("e"))
    fold = F.expr(
        "aggregate(sequence(0, size(p) + size(e)), named_struct('i', 0, 'j', 0, 'm', CAST(array() AS array<struct<i:int,j:int>>)), (s, k) -> "
        "CASE WHEN s.i >= size(p) OR s.j >= size(e) THEN s "
        "WHEN abs(p[s.i] - e[s.j]) <= _within THEN named_struct('i', s.i + 1, 'j', s.j + 1, 'm', array_append(s.m, named_struct('i', s.i, 'j', s.j))) "
        "WHEN p[s.i] < e[s.j] THEN named_struct('i', s.i + 1, 'j', s.j, 'm', s.m) ELSE named_struct('i', s.i, 'j', s.j + 1, 'm', s.m) END, s -> s.m)"
    )
    return _limits(both, tolerance, key).withColumn("pairs", fold).drop("_within")


def missed_events(matches: DataFrame, key: str = "recipe_id") -> DataFrame:
    """key, j, time_s: expected events of no pair, by their place in the row's own arrays.

    Without a join: planners take exploded arrays for as small as the table they come from, and broadcast them.
    """
    left = F.array_except(F.transform("e", lambda _, j: j), F.transform("pairs", lambda x: x["j"]))
    missed = matches.select(key, "e", F.explode(left).alias("j"))
    return missed.select(key, "j", F.element_at("e", F.col("j") + 1).alias("time_s"))


def beat_metrics(matches: DataFrame, key: str = "recipe_id") -> DataFrame:
    """Precision, recall, F1, and nearest-rank median and 95th percentile of the error in ms.

    F1 is one division of counts: by way of the rounded precision and recall, an F1 equal to a gate may end below it.
    """
    m, p, e = F.size("pairs"), F.size("p"), F.size("e")
    err = F.transform("pairs", lambda x: F.abs(F.element_at("p", x["i"] + 1) - F.element_at("e", x["j"] + 1)) * 1000)
    r = matches.select(key, p.cast("long").alias("n_predicted"), e.cast("long").alias("n_expected"), m.cast("long").alias("matched"), safe_ratio(m, p).alias("precision"), safe_ratio(m, e).alias("recall"), safe_ratio(2 * m, p + e).alias("f1"), err.alias("err"))
    return r.select(key, "n_predicted", "n_expected", "matched", "precision", "recall", "f1", nearest_rank(F.col("err"), 0.5).alias("median_error_ms"), nearest_rank(F.col("err"), 0.95).alias("p95_error_ms"))


def tempo_metrics(points: DataFrame, key: str = "recipe_id") -> DataFrame:
    """Percent errors of ``bpm`` against ``truth_bpm`` where truth is defined."""
    err = F.abs(F.col("bpm") - F.col("truth_bpm")) / F.col("truth_bpm") * 100
    t = points.where("truth_bpm IS NOT NULL").groupBy(key).agg(F.collect_list(err).alias("err"))
    return t.select(key, F.size("err").cast("long").alias("n_points"), nearest_rank(F.col("err"), 0.5).alias("median_error_percent"), nearest_rank(F.col("err"), 0.95).alias("p95_error_percent"))


def change_metrics(predicted: DataFrame, expected: DataFrame, tolerance: float | DataFrame, key: str = "recipe_id") -> DataFrame:
    """One-to-one matches of same-kind changes, nearest first; ties by predicted then expected order."""
    item = F.struct("time_s", "kind")
    p = predicted.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("p"))
    e = expected.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("e"))
    both = e.join(p, key, "full").select(key, F.coalesce("p", F.expr("CAST(array() AS array<struct<time_s:double,kind:string>>)")).alias("p"), F.coalesce("e", F.expr("CAST(array() AS array<struct<time_s:double,kind:string>>)")).alias("e"))
    close = F.expr(
        "array_sort(flatten(transform(p, (x, i) -> transform(filter(transform(e, (y, j) -> named_struct('d', abs(x.time_s - y.time_s), 'i', i, 'j', j, 'same', x.kind = y.kind)), "
        "z -> z.same AND z.d <= _within), z -> named_struct('d', z.d, 'i', z.i, 'j', z.j)))))"
    )
    fold = F.expr(
        "aggregate(close, named_struct('pi', CAST(array() AS array<int>), 'ej', CAST(array() AS array<int>), 'd', CAST(array() AS array<double>)), (s, c) -> "
        "CASE WHEN array_contains(s.pi, c.i) OR array_contains(s.ej, c.j) THEN s "
        "ELSE named_struct('pi', array_append(s.pi, c.i), 'ej', array_append(s.ej, c.j), 'd', array_append(s.d, c.d)) END)"
    )
    r = _limits(both, tolerance, key).withColumn("close", close).withColumn("m", fold)
    n, np_, ne = F.size("m.d"), F.size("p"), F.size("e")
    return r.select(key, n.cast("long").alias("matched"), safe_ratio(n, np_).alias("precision"), safe_ratio(n, ne).alias("recall"), nearest_rank(F.col("m.d"), 0.5).alias("median_offset_s"))


def verdicts(metrics: DataFrame) -> DataFrame:
    """Failed gates of each case: five thresholds, all named when they fail; without tempo points both tempo gates do."""
    m = metrics
    none = F.lit("tempo curve has no scorable points")
    error = lambda what, c, top: F.when(F.col(c).isNull(), none).when(F.col(c) > F.col(top), F.format_string(f"{what} tempo error %.3f%% exceeds %.3f%%", c, top))
    below = lambda what, c, low: F.when(F.col(c) < F.col(low), F.format_string(f"{what} %.4f is below %.4f", c, low))
    checks = [
        below("beat F1", "f1", "min_beat_f1"), below("downbeat F1", "downbeat_f1", "min_downbeat_f1"),
        error("median", "median_error_percent", "max_median"), error("p95", "p95_error_percent", "max_p95"),
        below("change recall", "change_recall", "min_change_recall"),
    ]
    return m.withColumn("failures", F.array_compact(F.array(*checks))).withColumn("passed", F.size("failures") == 0)


def effective_thresholds(cases: DataFrame, defaults: DataFrame) -> DataFrame:
    """A case's thresholds replace the suite's as a whole, never field by field."""
    return cases.join(F.broadcast(defaults.limit(1)), how="left").withColumn("thresholds", F.coalesce("thresholds", "default_thresholds")).drop("default_thresholds")


def attribution(cases: DataFrame) -> DataFrame:
    """Where a failure comes from: the estimator if ideal input fails, unpaired, the observations, or nowhere."""
    decision = F.when(~F.col("oracle_passed"), "estimator").when(F.col("oracle_passed").isNull(), "unpaired").when(~F.col("passed"), "observations").otherwise("none")
    return cases.withColumn("attribution", decision)


def candidate_means(cases: DataFrame) -> DataFrame:
    """Per policy: means, event count, whether every case passed."""
    return cases.groupBy("policy").agg(F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("f1").alias("mean_f1"), F.avg("n_predicted").alias("mean_events"), F.bool_and("passed").alias("passed"), F.count("*").alias("n_cases"))


def slice_means(cases: DataFrame) -> DataFrame:
    """Per policy and tag; a case counts in each of its tags."""
    return cases.select("policy", F.explode("tags").alias("tag"), "f1", "recall").groupBy("policy", "tag").agg(F.avg("f1").alias("mean_f1"), F.avg("recall").alias("mean_recall"), F.count("*").alias("n_cases"))


def policy_oracle(cases: DataFrame, key: str = "track_id") -> DataFrame:
    """Mean over cases of the best F1 that any policy reaches."""
    return cases.groupBy(key).agg(F.max("f1").alias("best")).agg(F.avg("best").alias("oracle_mean_f1"), F.count("*").alias("n_cases"))


def compare(baseline: DataFrame, candidate: DataFrame, key: str = "track_id") -> DataFrame:
    """Per case: both F1, the difference, and whether it improved, regressed or stayed."""
    j = baseline.select(key, F.col("f1").alias("baseline_f1")).join(candidate.select(key, F.col("f1").alias("candidate_f1")), key)
    d = F.col("candidate_f1") - F.col("baseline_f1")
    return j.withColumn("delta_f1", d).withColumn("outcome", F.when(d > 0, "improved").when(d < 0, "regressed").otherwise("unchanged"))


def metric_delta(oracle: DataFrame, end_to_end: DataFrame, key: str = "case_id") -> DataFrame:
    """End-to-end metrics less those of ideal observations, per case of both; null where either has none."""
    names = ("f1", "downbeat_f1", "median_error_percent", "p95_error_percent", "change_recall")
    o = oracle.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    return end_to_end.join(o, key).select(key, *[(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in names])


def suite_attribution(oracle: DataFrame, end_to_end: DataFrame, key: str = "case_id") -> DataFrame:
    """One row: where a suite's failures come from, from its cases' ``passed`` with ideal and with real observations."""
    both = end_to_end.select(key, "passed").join(oracle.select(key, F.col("passed").alias("ideal")), key, "left")
    g = both.agg(F.coalesce(F.bool_and("ideal"), F.lit(True)).alias("oracle_passed"), F.bool_or(F.col("ideal").isNull()).alias("unpaired"), F.bool_and("passed").alias("end_to_end_passed"))
    where = F.when(~F.col("oracle_passed"), "deterministic_estimator").when(F.col("unpaired"), "end_to_end_only").when(~F.col("end_to_end_passed"), "observation_path").otherwise("no_measured_bottleneck")
    return g.select((F.col("oracle_passed") & F.col("end_to_end_passed")).alias("passed"), where.alias("attribution"))
