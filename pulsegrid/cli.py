"""Commands: eval, eval-backend, score, render, decoder-sweep, decoder-eval, decoder-recoverability, dataset-install, model-verify, audio-inspect.

A suite is a manifest file, or a directory of recipes under the default thresholds. No model comes with this library: ``eval-backend``
takes any class with ``observe``, and the decoder commands read frame logits (case_id, frame, logit) from Parquet.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import scoring
from pulsegrid.options import DECODER_POLICIES
from pulsegrid.plans import analysis, decoding, suites
from pulsegrid.sources import audio, manifests


def open_suite(spark: SparkSession, path: str, min_f1: float | None = None) -> suites.Suite:
    return suites.open_suite(spark, path) if path.endswith(".json") else suites.open_recipes(spark, path, **({} if min_f1 is None else {"min_beat_f1": min_f1}))


def _decoder_inputs(spark: SparkSession, a, holdout: bool) -> tuple[suites.Suite, DataFrame, DataFrame, DataFrame]:
    """The suite, its frames and events by track, and tolerances; tuning commands are for calibration suites."""
    s = open_suite(spark, a.suite)
    if a.suite.endswith(".json"):
        manifests.purpose_gate(s.cases, holdout)
    suites.require_beats(s, a.command)
    frames = spark.read.parquet(a.logits).join(s.tracks(), "case_id").select("track_id", "frame", "logit")
    suites._demand_none(s.tracks().join(frames, "track_id", "left_anti").select("case_id"), "no logits of")
    return s, frames, s.beats.join(s.tracks(), "case_id").select("track_id", "time_s"), s.limits("beat_tolerance_ms", 0.001).join(s.tracks(), "case_id").select("track_id", "tolerance")


def _named(s: suites.Suite, df: DataFrame) -> DataFrame:
    return df.join(s.tracks(), "track_id").drop("track_id")


def _scored(s: suites.Suite, scores: DataFrame) -> DataFrame:
    return _named(s, scores).join(s.cases.select("case_id", "tags", F.col("thresholds.min_beat_f1").alias("least")), "case_id").withColumn("passed", F.col("f1") >= F.col("least")).drop("least")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pulsegrid", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, gate: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in places:
            c.add_argument(x)
        if gate:
            c.add_argument("--no-fail", action="store_true")
        return c

    e = command("eval", "suite", "report", gate=True)
    e.add_argument("--policy", default="default", choices=analysis.policies())
    e.add_argument("--min-f1", type=float, help="for directories of recipes")
    b = command("eval-backend", "suite", "report", gate=True)
    b.add_argument("--backend", default="pulsegrid.engine:OnsetBackend", help="module:class")
    b.add_argument("--policy", default="default", choices=analysis.policies())
    b.add_argument("--audio-dir")
    b.add_argument("--model-pack")
    b.add_argument("--model-dir")
    command("score", "suite", "predictions", "report", gate=True)
    command("render", "suite", "output")
    command("decoder-sweep", "suite", "logits", "report")
    command("decoder-eval", "suite", "logits", "policy", "report", gate=True)
    command("decoder-recoverability", "suite", "logits", "report")
    d = command("dataset-install", "lock", "mirror", "output")
    d.add_argument("--with-annotations", action="store_true")
    command("model-verify", "manifest", "root")
    command("audio-inspect", "path")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "eval":
        return manifests.write_report(suites.report(suites.evaluate_core(open_suite(spark, a.suite, a.min_f1), a.policy)), a.report, a.no_fail)
    if a.command == "score":
        return manifests.write_report(suites.report(suites.score_predictions(open_suite(spark, a.suite), a.predictions)), a.report, a.no_fail)
    if a.command == "eval-backend":
        if a.model_pack:
            suites._demand_none(manifests.model_pack_violations(spark, a.model_pack, a.model_dir), "model pack")
            suites._demand_none(manifests.feature_contract(spark, a.model_pack).where("NOT supported").select("id"), "feature contract of")
        module, _, name = a.backend.partition(":")
        cases, verdict = suites.evaluate_backend(open_suite(spark, a.suite), getattr(importlib.import_module(module), name)(), a.policy, a.audio_dir)
        return manifests.write_report(verdict.crossJoin(suites.report(cases).drop("passed")), a.report, a.no_fail)
    if a.command == "render":
        suites.render_suite(open_suite(spark, a.suite), a.output)
        return 0
    if a.command in ("decoder-sweep", "decoder-eval"):
        one = a.command == "decoder-eval"
        chosen = [x for x in DECODER_POLICIES if not one or x[0] == a.policy]
        if not chosen:
            p.error(f"unknown decoder policy {a.policy!r}")
        s, frames, events, within = _decoder_inputs(spark, a, one)
        cases = _scored(s, decoding.policy_scores(frames, events, within, chosen))
        means, slices = scoring.candidate_means(cases), scoring.slice_means(cases).groupBy("policy").agg(F.sort_array(F.collect_list(F.struct("tag", "mean_f1", "mean_recall", "n_cases"))).alias("slices"))
        return manifests.write_report(means.join(slices, "policy", "left"), a.report, not one or a.no_fail)
    if a.command == "decoder-recoverability":
        s, frames, events, within = _decoder_inputs(spark, a, False)
        _named(s, decoding.recoverability(frames, events, within)).write.mode("overwrite").json(a.report)
        return 0
    if a.command == "dataset-install":
        bad = manifests.install_assets(spark, a.lock, a.mirror, a.output, a.with_annotations)
        bad.show(truncate=False)
        return int(not bad.isEmpty())
    if a.command == "model-verify":
        bad = manifests.model_pack_violations(spark, a.manifest, a.root)
        bad.show(truncate=False)
        return int(not bad.isEmpty())
    audio.inspect_audio(spark, a.path).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
