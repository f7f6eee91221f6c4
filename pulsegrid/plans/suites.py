"""Evaluation suites: the truth of every case, analyses scored against it, and reports.

A suite is one manifest; its cases' recipes, truths, audio and predictions are files, read and scored as
DataFrames keyed by ``case_id``. Cases go in parallel; nothing but the manifest's paths reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.engine import Backend, Engine
from pulsegrid.functions.synthesis import render
from pulsegrid.operators import scoring, sequence, truth
from pulsegrid.options import EstimatorOptions
from pulsegrid.plans import analysis
from pulsegrid.sources import audio, manifests
from pulsegrid.sources.files import plain_path, write_file

LOW_ACTIVITY_DB = -40.0


class SuiteError(ValueError):
    """A suite, or a file that it names, cannot be evaluated."""


def _demand_none(violations: DataFrame, what: str) -> None:
    if found := violations.limit(20).collect():
        raise SuiteError(f"{what}: " + "; ".join(", ".join(str(x) for x in r) for r in found))


@dataclass(frozen=True)
class Suite:
    """``cases`` (case_id, tags, input, thresholds), and truth by case: ``spans`` (case_id, duration_s), ``beats``, ``segments``, ``changes``."""

    cases: DataFrame
    recipes: DataFrame
    spans: DataFrame
    beats: DataFrame
    segments: DataFrame
    changes: DataFrame

    def tracks(self) -> DataFrame:
        """case_id, track_id: the numbers that analyses go by."""
        return self.cases.select("case_id", F.xxhash64("case_id").alias("track_id"))

    def limits(self, column: str, scale: float = 1.0) -> DataFrame:
        return self.cases.select("case_id", (F.col(f"thresholds.{column}") * scale).alias("tolerance"))


def _of_recipes(cases: DataFrame, recipes: DataFrame) -> Suite:
    case = lambda df: df.withColumnRenamed("recipe_id", "case_id")
    span = recipes.groupBy("recipe_id").agg(F.sum("duration_s").alias("duration_s"))
    return Suite(cases, recipes, case(span), case(truth.truth_beats(recipes)).select("case_id", "time_s", "downbeat"), case(truth.truth_segments(recipes)).drop("seg"), case(truth.truth_changes(recipes)))


def open_recipes(spark: SparkSession, directory: str, **thresholds: float) -> Suite:
    """Every recipe of a directory as a case, under the default thresholds but those given."""
    from pulsegrid import schema

    recipes = manifests.load_recipes(spark, directory).drop("_path")
    limits = F.struct(*[F.lit(float(v)).alias(k) for k, v in (schema.THRESHOLDS | thresholds).items()])
    cases = recipes.select(F.col("recipe_id").alias("case_id")).distinct().withColumns({"tags": F.array().cast("array<string>"), "thresholds": limits})
    _demand_none(truth.recipe_violations(recipes).select("recipe_id", "code"), "recipes")
    return _of_recipes(cases, recipes)


def open_suite(spark: SparkSession, path: str) -> Suite:
    """The suite of a manifest, validated with everything that it names; truths come from recipes or truth files."""
    cases = manifests.load_suite(spark, path)
    if cases.isEmpty():
        raise SuiteError("a suite has an id and one case at least")
    _demand_none(cases.where("schema_version <> 1 OR trim(suite_id) = ''").select("suite_id", "schema_version"), "suite id or schema")
    _demand_none(manifests.suite_violations(cases).unionByName(manifests.threshold_violations(cases)), "cases")
    root = path.rsplit("/", 1)[0] if "/" in path else "."
    named = cases.select("case_id", F.coalesce("input.recipe", "input.truth").alias("file"), (F.col("input.kind") == "generated").alias("generated"))
    files = {g: sorted({f"{root}/{r['file']}" for r in named.where(F.col("generated") == g).select("file").collect()}) for g in (True, False)}

    def demand(kind: bool, have: DataFrame) -> None:
        """Each case's own file carries the case's id."""
        got = have.select(F.col("id").alias("case_id"), plain_path(F.col("_path")).alias("_at")).distinct()
        want = named.where(F.col("generated") == kind)
        away = want.join(got, "case_id", "left").where(F.col("_at").isNull() | ~F.col("_at").endswith(F.concat(F.lit("/"), F.col("file")))).select("case_id", "file")
        _demand_none(away, "the file of a case must carry its id")

    parts = []
    if files[True]:
        recipes = manifests.load_recipes(spark, files[True])
        demand(True, recipes.withColumnRenamed("recipe_id", "id"))
        recipes = recipes.drop("_path")
        _demand_none(truth.recipe_violations(recipes).select("recipe_id", "code"), "recipes")
        parts.append(_of_recipes(cases, recipes))
    if files[False]:
        t = manifests.load_truth(spark, files[False])
        demand(False, t)
        _demand_none(manifests.truth_violations(t), "truths")
        rows = lambda c: t.select(F.col("id").alias("case_id"), F.explode(c).alias("x")).select("case_id", "x.*")
        segments = rows("tempo_segments").select("case_id", "start_s", "end_s", "kind", "start_bpm", "end_bpm")
        parts.append(Suite(cases, None, t.select(F.col("id").alias("case_id"), "duration_s"), rows("beats"), segments, rows("change_points")))
    both = [(a.unionByName(b) if len(parts) > 1 else a) for a, b in zip(*[(p.spans, p.beats, p.segments, p.changes) for p in (parts * 2)[:2]], strict=True)]
    return Suite(cases, parts[0].recipes, *both)


def require_beats(suite: Suite, operation: str) -> None:
    """Decoder operations need beat times: no case may have a tempo alone."""
    _demand_none(suite.cases.select("case_id").join(suite.beats.select("case_id"), "case_id", "left_anti"), f"{operation} requires beat times; tempo-only cases")


def evaluate(suite: Suite, beats: DataFrame, curve: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per case: beat, downbeat, tempo and change metrics of an analysis, failures and verdict under the case's thresholds.

    ``beats`` (case_id, time_s, downbeat), ``curve`` (case_id, time_s, bpm), ``changes`` (case_id, time_s, kind).
    """
    within = suite.limits("beat_tolerance_ms", 0.001)
    b = scoring.beat_metrics(scoring.match_events(beats, suite.beats, within, "case_id"), "case_id")
    d = scoring.beat_metrics(scoring.match_events(beats.where("downbeat"), suite.beats.where("downbeat"), within, "case_id"), "case_id")
    t = scoring.tempo_metrics(truth.tempo_at(curve, suite.segments, "case_id"), "case_id")
    c = scoring.change_metrics(changes, suite.changes, suite.limits("change_tolerance_s"), "case_id")
    c = c.select("case_id", F.col("matched").alias("changes_matched"), F.col("precision").alias("change_precision"), F.col("recall").alias("change_recall"), "median_offset_s")
    m = suite.cases.select("case_id", "tags", "thresholds").join(b, "case_id", "left")
    m = m.join(d.select("case_id", F.col("f1").alias("downbeat_f1"), F.col("precision").alias("downbeat_precision"), F.col("recall").alias("downbeat_recall")), "case_id", "left")
    m = m.join(t, "case_id", "left").join(c, "case_id", "left")
    # Nothing out of nothing is 1.
    m = m.fillna(0, ["n_predicted", "n_expected", "matched", "n_points", "changes_matched"])
    m = m.fillna(1.0, ["precision", "recall", "f1", "downbeat_f1", "downbeat_precision", "downbeat_recall", "change_precision", "change_recall"])
    gates = {"min_beat_f1": "min_beat_f1", "min_downbeat_f1": "min_downbeat_f1", "max_median": "max_tempo_median_error_percent", "max_p95": "max_tempo_p95_error_percent", "min_change_recall": "min_change_recall"}
    return scoring.verdicts(m.withColumns({k: F.col(f"thresholds.{v}") for k, v in gates.items()})).drop(*gates, "thresholds")


def _analyses(suite: Suite, analyses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = lambda kind: analysis.part(analyses, kind).join(suite.tracks(), "track_id")
    return named("beats").select("case_id", "time_s", "downbeat"), named("curve").select("case_id", "time_s", "bpm"), named("changes").select("case_id", "time_s", "kind")


def evaluate_core(suite: Suite, policy: str | EstimatorOptions = "default") -> DataFrame:
    """The estimator alone: ideal observations of every case through it, scored."""
    ideal = truth.ideal_observations(suite.beats.withColumnRenamed("case_id", "recipe_id")).withColumnRenamed("recipe_id", "case_id")
    beats = ideal.join(suite.spans, "case_id").join(suite.tracks(), "case_id")
    return evaluate(suite, *_analyses(suite, analysis.analyze_tracks(beats, policy)))


def score_predictions(suite: Suite, directory: str) -> DataFrame:
    """Analyses made elsewhere, one ``<case-id>.json`` each, scored; every case needs one."""
    p = manifests.load_predictions(suite.cases.sparkSession, directory)
    _demand_none(suite.cases.select("case_id").join(p, "case_id", "left_anti"), "no prediction for")
    rows = lambda c: p.select("case_id", F.explode(c).alias("x")).select("case_id", "x.*")
    return evaluate(suite, rows("beats").withColumn("downbeat", F.coalesce("downbeat", F.lit(False))), rows("curve").select("case_id", "time_s", "bpm"), rows("changes"))


def sounds(suite: Suite) -> DataFrame:
    """case_id, sample_rate, wav: the recipes' beats rendered as WAV files."""
    span = suite.recipes.groupBy(F.col("recipe_id").alias("case_id")).agg(F.sum("duration_s").alias("duration_s"), F.first("sample_rate").alias("sample_rate"), F.first("audio_profile").alias("profile"))
    lists = span.join(suite.beats.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("time_s", "downbeat"))).alias("beats")), "case_id", "left")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(c, r, audio.encode_wav(render([(x["time_s"], x["downbeat"]) for x in ([] if beats is None else beats)], d, r, p), r)) for c, d, r, p, beats in zip(b.case_id, b.duration_s, b.sample_rate, b.profile, b.beats, strict=True)]
            yield pd.DataFrame(rows, columns=["case_id", "sample_rate", "wav"])

    # A case is one row of audio: a row to a batch keeps memory at one case.
    return lists.select("case_id", "duration_s", "sample_rate", "profile", "beats").mapInPandas(run, "case_id string, sample_rate int, wav binary")


def render_suite(suite: Suite, directory: str) -> None:
    """``<case-id>.wav`` and ``<case-id>.truth.json`` of every generated case below a folder that all executors share."""
    listed = lambda df, name: df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "case_id"]))).alias(name))
    t = sounds(suite).join(suite.spans, "case_id").join(listed(suite.beats, "beats"), "case_id", "left").join(listed(suite.segments, "tempo_segments"), "case_id", "left").join(listed(suite.changes, "change_points"), "case_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(t.schema[c].dataType)).alias(c)
    document = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("case_id").alias("id"), "duration_s", *map(empty, ("beats", "tempo_segments", "change_points"))))

    def write(rows) -> None:
        for r in rows:
            write_file(directory, f"{r.case_id}.wav", bytes(r.wav))
            write_file(directory, f"{r.case_id}.truth.json", r.document.encode())

    t.select("case_id", "wav", document.alias("document")).foreachPartition(write)


def case_audio(suite: Suite, directory: str | None = None, tolerance: float = 0.1) -> DataFrame:
    """case_id, sha256, samples, sample_rate: rendered for generated cases, found by digest below ``directory`` for external ones.

    Audio that cannot be found or decoded, or whose duration is off its truth's, is an error.
    """
    spark = suite.cases.sparkSession
    files = sounds(suite).select("case_id", F.col("wav").alias("content")) if suite.recipes is not None else None
    external = suite.cases.where("input.kind = 'external'") if "input" in suite.cases.columns else suite.cases.limit(0)
    if not external.isEmpty():
        if directory is None:
            raise SuiteError("external cases need an audio directory")
        have = audio.scan_audio(spark, directory)
        found = manifests.resolve_audio(external, have).join(have.select("path", "content"), "path").select("case_id", "content")
        _demand_none(external.select("case_id").join(found, "case_id", "left_anti"), "no audio with the digest of")
        files = found if files is None else files.unionByName(found)
    decoded = audio.decode_audio(files.select(F.col("case_id").alias("path"), "content")).withColumnRenamed("path", "case_id")
    _demand_none(decoded.where("error IS NOT NULL").select("case_id", "error"), "audio")
    _demand_none(audio.duration_mismatch(suite.spans, decoded, tolerance), "audio and truth differ in duration")
    return files.select("case_id", F.sha2("content", 256).alias("sha256")).join(decoded.drop("error"), "case_id")


def evaluate_backend(suite: Suite, backend: Backend, policy: str | EstimatorOptions = "default", audio_directory: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A backend's audio path beside ideal observations: (one row per case, the suite's verdict and attribution).

    Cases carry both verdicts, the differences of their metrics, and diagnostics of the observations; a tempo-only case has no ideal side.
    """
    engine = Engine(backend, policy)
    heard = case_audio(suite, audio_directory).join(suite.tracks(), "case_id")
    seen = engine.observe_pcm(heard.select("track_id", "sample_rate", F.lit(1).alias("channels"), "samples"))
    found = evaluate(suite, *_analyses(suite, engine.analyze_observations(seen)))
    ideal = evaluate_core(suite, policy).join(suite.beats.select("case_id").distinct(), "case_id", "left_semi")
    w = sequence.intervals(seen.withColumn("idx", F.row_number().over(sequence._track("time_s")) - 1))
    near = seen.withColumn("idx", F.row_number().over(sequence._track("time_s")) - 1).withColumn("near_db", F.lit(None).cast("double"))
    about = sequence.diagnostics(near, near, w, LOW_ACTIVITY_DB).join(suite.tracks(), "track_id").drop("track_id", "min_db", "low_fraction")
    cases = found.join(scoring.metric_delta(ideal, found), "case_id", "left").join(ideal.select("case_id", F.col("passed").alias("oracle_passed"), F.col("failures").alias("oracle_failures")), "case_id", "left")
    cases = cases.join(about, "case_id", "left").join(heard.select("case_id", "sha256"), "case_id", "left")
    return cases, scoring.suite_attribution(ideal, found)


def report(cases: DataFrame) -> DataFrame:
    """One row for a suite: whether all passed, how many there are, and its cases."""
    return cases.agg(F.bool_and("passed").alias("passed"), F.count("*").alias("n_cases"), F.count_if(~F.col("passed")).alias("n_failed"), F.avg("f1").alias("mean_f1"), F.sort_array(F.collect_list(F.struct("case_id", *[c for c in cases.columns if c != "case_id"]))).alias("cases"))
