"""Suites by file: truth, scoring, a backend, decoder commands, installs; sounds and repairs by value."""

import hashlib
import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import cli
from pulsegrid.engine import OnsetBackend
from pulsegrid.functions import estimator as e
from pulsegrid.functions.synthesis import noises, render
from pulsegrid.plans import decoding, suites
from pulsegrid.sources import audio, manifests

RIGHTS = {"audio_license": "CC0-1.0", "annotation_license": "CC0-1.0", "redistributable": True, "commercial_evaluation_allowed": True}


@pytest.fixture(scope="module")
def suite_dir(tmp_path_factory):
    """A suite of two generated cases and an external one, with the external case's audio."""
    d = tmp_path_factory.mktemp("suite")
    (d / "recipes").mkdir()
    (d / "audio").mkdir()
    segments = {"steady": [(16, 120)], "step": [(10, 120), (9, 160)]}
    for name, s in segments.items():
        (d / "recipes" / f"{name}.json").write_text(json.dumps({"schema_version": 1, "id": name, "sample_rate": 8000, "beats_per_bar": 3, "segments": [{"duration_s": t, "kind": "constant", "bpm": b} for t, b in s]}, indent=1))
    beats = [{"time_s": 0.5 * k, "downbeat": k % 4 == 0} for k in range(24)]
    (d / "own.json").write_text(json.dumps({"schema_version": 1, "id": "own", "duration_s": 12.0, "beats": beats, "tempo_segments": [{"start_s": 0.0, "end_s": 12.0, "kind": "constant", "start_bpm": 120.0, "end_bpm": 120.0}], "change_points": []}, indent=1))
    wav = audio.encode_wav(render([(b["time_s"], b["downbeat"]) for b in beats], 12.0, 8000), 8000)
    (d / "audio" / "x.wav").write_bytes(wav)
    case = lambda name, **x: {"id": name, "tags": ["t"], **x}
    cases = [case(n, input={"kind": "generated", "recipe": f"recipes/{n}.json"}, provenance={"kind": "generated", **RIGHTS}) for n in segments]
    cases.append(case("own", input={"kind": "external", "truth": "own.json", "audio": {"sha256": hashlib.sha256(wav).hexdigest()}}, provenance={"kind": "public", **RIGHTS}, thresholds={"beat_tolerance_ms": 30.0, "change_tolerance_s": 0.5, "min_beat_f1": 0.9, "max_tempo_median_error_percent": 2.0, "max_tempo_p95_error_percent": 4.0, "min_change_recall": 0.5}))
    (d / "suite.json").write_text(json.dumps({"schema_version": 1, "id": "s", "description": "x", "purpose": "calibration", "cases": cases}, indent=1))
    return d


def test_truth_of_a_suite(spark, suite_dir):
    s = suites.open_suite(spark, f"{suite_dir}/suite.json")
    assert {r.case_id: r.duration_s for r in s.spans.collect()} == {"steady": 16.0, "step": 19.0, "own": 12.0}
    assert {r.case_id: r.n for r in s.beats.where("downbeat").groupBy("case_id").agg(F.count("*").alias("n")).collect()} == {"steady": 11, "step": 15, "own": 6}
    assert {r.case_id: r.tolerance for r in s.limits("beat_tolerance_ms").collect()} == {"steady": 70.0, "step": 70.0, "own": 30.0}
    cases = {r.case_id: r for r in suites.evaluate_core(s).collect()}
    assert all(r.passed and r.downbeat_f1 == 1.0 and r.f1 == 1.0 for r in cases.values())
    assert cases["step"].change_recall == 1.0


def broken(suite_dir, change):
    """The suite with ``change`` made to its manifest, as another file beside it."""
    m = json.loads((suite_dir / "suite.json").read_text())
    change(m)
    path = suite_dir / "broken.json"
    path.write_text(json.dumps(m, indent=1))
    return str(path)


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda m: m["cases"][0].update(id="step"), "repeated_id"),
        (lambda m: m["cases"][0].update(id="other"), "carry its id"),
        (lambda m: m["cases"][0]["input"].update(recipe="../x.json"), "unsafe_path"),
        (lambda m: m["cases"][2]["thresholds"].update(min_beat_f1=1.5), "bad_min_beat_f1"),
        (lambda m: m["cases"][2]["thresholds"].update(beat_tolerance_ms=0.0), "bad_beat_tolerance_ms"),
        (lambda m: m["cases"][2]["thresholds"].update(max_tempo_p95_error_percent=-1.0), "bad_max_tempo_p95"),
        (lambda m: m["cases"][2]["input"]["audio"].update(sha256="x"), "bad_sha256"),
        (lambda m: m["cases"][0]["provenance"].update(kind="public"), "provenance"),
        (lambda m: m.update(schema_version=2), "schema"),
    ],
)
def test_broken_suites_are_refused(spark, suite_dir, change, said):
    with pytest.raises(suites.SuiteError, match=said):
        suites.open_suite(spark, broken(suite_dir, change))


def test_broken_truths(spark, tmp_path):
    good = {"schema_version": 1, "id": "a", "duration_s": 4.0, "beats": [{"time_s": 1.0}, {"time_s": 2.0}], "tempo_segments": [{"start_s": 0.0, "end_s": 2.0, "kind": "constant", "start_bpm": 60.0, "end_bpm": 60.0}, {"start_s": 2.0, "end_s": 4.0, "kind": "constant", "start_bpm": 60.0, "end_bpm": 60.0}], "change_points": [{"time_s": 1.0, "kind": "tempo_jump"}, {"time_s": 2.0, "kind": "tempo_jump"}]}
    changes = {
        "ok": {}, "unsupported_schema": {"schema_version": 3}, "no_id_or_duration": {"duration_s": 0.0}, "beat_out_of_range": {"beats": [{"time_s": 5.0}]}, "beats_not_rising": {"beats": [{"time_s": 1.0}, {"time_s": 1.0}]},
        "segment_bounds": {"tempo_segments": [good["tempo_segments"][0] | {"end_s": 9.0}]}, "bpm_out_of_range": {"tempo_segments": [good["tempo_segments"][0] | {"end_bpm": 0.0}]}, "segments_overlap": {"tempo_segments": [good["tempo_segments"][0], good["tempo_segments"][1] | {"start_s": 1.0}]},
        "change_out_of_range": {"change_points": [{"time_s": -1.0, "kind": "x"}]}, "changes_not_ordered": {"change_points": good["change_points"][::-1]},
    }
    for k, x in changes.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(good | {"id": k} | x, indent=1))
    found = {r.id: r.code for r in manifests.truth_violations(manifests.load_truth(spark, str(tmp_path))).collect()}
    assert found == {k: k for k in changes if k != "ok"}


def test_broken_recipes(spark):
    from pulsegrid.operators import truth

    rows = [("ok", "constant", 3600.0, 120.0, 8000, 4), ("ok", "silence", 1.0, None, 8000, 4), ("bad_duration", "constant", 3600.5, 120.0, 8000, 4), ("bad_duration", "constant", 1.0, 120.0, 8000, 4)]
    rows += [("bpm_out_of_range", "linear_ramp", 1.0, 1001.0, 8000, 4), ("bad_sample_rate", "constant", 1.0, 60.0, 7999, 4), ("bad_beats_per_bar", "constant", 1.0, 60.0, 8000, 0)]
    r = spark.createDataFrame([(i, k, d, b, b, n, m) for i, k, d, b, n, m in rows], "recipe_id string, kind string, duration_s double, start_bpm double, end_bpm double, sample_rate int, beats_per_bar int")
    assert sorted((x.recipe_id, x.code) for x in truth.recipe_violations(r).collect()) == sorted((k, k) for k in {r[0] for r in rows} - {"ok"})


def test_predictions_are_scored(spark, suite_dir, tmp_path):
    s = suites.open_suite(spark, f"{suite_dir}/suite.json")
    truth = {}
    for r in s.beats.orderBy("time_s").collect():
        truth.setdefault(r.case_id, []).append({"time_s": r.time_s, "downbeat": r.downbeat})
    changes = [r.asDict() for r in s.changes.collect()]
    for k, beats in truth.items():
        curve = [{"time_s": (a["time_s"] + b["time_s"]) / 2, "bpm": 60 / (b["time_s"] - a["time_s"])} for a, b in zip(beats, beats[1:])]
        if k == "own":
            beats = [b | {"time_s": b["time_s"] + 0.05, "downbeat": False} for b in beats]
        (tmp_path / f"{k}.json").write_text(json.dumps({"beats": beats, "tempo_curve": curve, "change_points": [{"time_s": c["time_s"], "kind": c["kind"]} for c in changes if c["case_id"] == k]}, indent=1))
    got = {r.case_id: r for r in suites.score_predictions(s, str(tmp_path)).collect()}
    assert got["steady"].passed and got["step"].passed
    # Off by 50 ms: outside the case's own 30 ms, and no downbeat found.
    assert got["own"].f1 == 0.0 and got["own"].failures == ["beat F1 0.0000 is below 0.9000"] and got["own"].downbeat_f1 == 0.0
    assert cli.main(["score", f"{suite_dir}/suite.json", str(tmp_path), f"{tmp_path}/report"]) == 1
    assert cli.main(["score", f"{suite_dir}/suite.json", str(tmp_path), f"{tmp_path}/report", "--no-fail"]) == 0
    report = spark.read.json(f"{tmp_path}/report").first()
    assert (report.passed, report.n_cases, report.n_failed) == (False, 3, 1)
    (tmp_path / "own.json").unlink()
    with pytest.raises(suites.SuiteError, match="own"):
        suites.score_predictions(s, str(tmp_path))


def test_backend_beside_ideal_observations(spark, suite_dir, tmp_path):
    s = suites.open_suite(spark, f"{suite_dir}/suite.json")
    cases, verdict = suites.evaluate_backend(s, OnsetBackend(), audio_directory=f"{suite_dir}/audio")
    got = {r.case_id: r for r in cases.collect()}
    assert len(got) == 3 and all(r.oracle_passed and r.n_beats > 15 and len(r.sha256) == 64 for r in got.values())
    assert all(abs(r.delta_f1 - (r.f1 - 1.0)) < 1e-12 for r in got.values())
    assert verdict.first().attribution in ("no_measured_bottleneck", "observation_path")
    assert verdict.first().passed == all(r.passed for r in got.values())
    with pytest.raises(suites.SuiteError, match="audio directory"):
        suites.evaluate_backend(s, OnsetBackend())
    assert cli.main(["render", f"{suite_dir}/suite.json", f"{tmp_path}/out"]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["steady.truth.json", "steady.wav", "step.truth.json", "step.wav"]
    t = json.loads((tmp_path / "out" / "step.truth.json").read_text())
    assert t["id"] == "step" and len(t["beats"]) == 44 and [c["kind"] for c in t["change_points"]] == ["tempo_jump"]
    assert manifests.truth_violations(manifests.load_truth(spark, f"{tmp_path}/out/*.json")).isEmpty()
    x = audio.inspect_audio(spark, f"{tmp_path}/out").orderBy("duration_s").collect()
    assert [(r.sample_rate, r.channels, r.duration_s) for r in x] == [(8000, 1, 16.0), (8000, 1, 19.0)]


def test_decoder_commands(spark, suite_dir, tmp_path):
    s = suites.open_suite(spark, f"{suite_dir}/suite.json")
    rows = []
    for r in s.spans.collect():
        at = {round(b.time_s * 50): i for i, b in enumerate(s.beats.where(F.col("case_id") == r.case_id).orderBy("time_s").collect())}
        rows += [(r.case_id, f, (-0.7 if at[f] % 5 == 0 else 3.0) if f in at else -6.0) for f in range(int(r.duration_s * 50))]
    spark.createDataFrame(rows, "case_id string, frame long, logit double").write.parquet(f"{tmp_path}/logits")
    args = [f"{suite_dir}/suite.json", f"{tmp_path}/logits"]
    assert cli.main(["decoder-sweep", *args, f"{tmp_path}/sweep"]) == 0
    sweep = {r.policy: r for r in spark.read.json(f"{tmp_path}/sweep").collect()}
    assert len(sweep) == 10 and sweep["radius3-logit-minus-1"].mean_recall == 1.0 > sweep["radius3-logit-0"].mean_recall
    assert cli.main(["decoder-eval", *args, "radius3-logit-0", f"{tmp_path}/eval"]) == 1
    assert cli.main(["decoder-eval", *args, "radius3-logit-minus-1", f"{tmp_path}/eval"]) == 0
    assert cli.main(["decoder-recoverability", *args, f"{tmp_path}/missed"]) == 0
    missed = spark.read.json(f"{tmp_path}/missed").collect()
    assert {r.evidence for r in missed} == {"radius3_peak_above_minus1"} and all(abs(r.probability - 1 / (1 + math.exp(0.7))) < 1e-9 and abs(r.r3_offset_ms) <= 10 for r in missed)
    assert len(missed) == s.beats.count() - sum(r.n for r in s.beats.groupBy("case_id").agg(F.sum(F.lit(1)).alias("n")).select((F.col("n") - F.ceil(F.col("n") / 5)).alias("n")).collect())
    m = json.loads((suite_dir / "suite.json").read_text()) | {"purpose": "holdout"}
    (suite_dir / "holdout.json").write_text(json.dumps(m, indent=1))
    with pytest.raises(ValueError, match="holdout"):
        cli.main(["decoder-sweep", f"{suite_dir}/holdout.json", args[1], f"{tmp_path}/x"])
    assert cli.main(["decoder-eval", f"{suite_dir}/holdout.json", args[1], "radius3-logit-minus-1", f"{tmp_path}/eval"]) == 0


def test_tempo_only_cases(spark, suite_dir):
    t = json.loads((suite_dir / "own.json").read_text()) | {"beats": []}
    (suite_dir / "tempo.json").write_text(json.dumps(t | {"id": "tempo"}, indent=1))

    def change(m):
        m["cases"][2].update(id="tempo")
        m["cases"][2]["input"].update(truth="tempo.json")

    s = suites.open_suite(spark, broken(suite_dir, change))
    with pytest.raises(suites.SuiteError, match="tempo"):
        suites.require_beats(s, "decoder-sweep")
    cases, verdict = suites.evaluate_backend(s, OnsetBackend(), audio_directory=f"{suite_dir}/audio")
    one = {r.case_id: r for r in cases.collect()}["tempo"]
    assert one.oracle_passed is None and one.delta_f1 is None and one.n_points > 0
    assert verdict.first().attribution == "end_to_end_only"


def test_gap_evidence_by_tolerance(spark):
    """The window is each event's tolerance, not a number of frames; plain loops give the same."""
    rng = np.random.default_rng(5)
    v = rng.normal(-1, 1.5, 200).round(1)
    frames = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "track_id long, frame long, logit double")
    events = spark.createDataFrame([(1, float(x)) for x in (0.0, 0.33, 1.011, 2.5, 3.98, 9.0)], "track_id long, time_s double")
    for tol in (0.03, 0.1):
        for r in decoding.evidence(frames, events, tol).collect():
            near = [i for i in range(200) if abs(i / 50 - r.time_s) <= tol + 1e-9]
            peak = {k: [v[i] for i in near if v[i] == v[max(0, i - k) : i + k + 1].max()] for k in (3, 1)}
            assert r.logit == (max(v[i] for i in near) if near else None)
            assert (r.radius3_logit, r.radius1_logit) == (max(peak[3], default=None), max(peak[1], default=None))
            assert (r.evidence == "no_frame") == (not near)


def test_installs_are_verified(spark, tmp_path):
    for d in ("mirror", "out"):
        (tmp_path / d).mkdir()
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/b.txt", "bbb")
    (tmp_path / "mirror" / "a.bin").write_bytes(b"aa")
    (tmp_path / "mirror" / "z.zip").write_bytes(z.getvalue())
    asset = lambda path, data, size=None, role="audio": {"path": path, "url": "https://x", "sha256": hashlib.sha256(data).hexdigest(), "size_bytes": size or len(data), "role": role}
    lock = [asset("d/a.bin", b"aa"), asset("b.txt", b"bbb"), asset("c.bin", b"none"), asset("notes.txt", b"n", role="annotation_source"), asset("w.bin", b"aa", 7)]
    z2 = io.BytesIO()
    with zipfile.ZipFile(z2, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("deep/er.txt", "range " * 50)
    (tmp_path / "mirror" / "big.archive").write_bytes(z2.getvalue())  # found by its size alone
    lock.append(asset("er.txt", b"range " * 50) | {"zip_member": {"archive_size_bytes": len(z2.getvalue()), "member_path": "deep/er.txt"}})
    (tmp_path / "lock.json").write_text(json.dumps({"schema_version": 1, "id": "x", "assets": lock}, indent=1))
    bad = {r.path: r.code for r in manifests.install_assets(spark, f"{tmp_path}/lock.json", f"{tmp_path}/mirror", f"{tmp_path}/out").collect()}
    assert bad == {"c.bin": "not_in_mirror", "w.bin": "wrong_size"}
    assert (tmp_path / "out" / "d" / "a.bin").read_bytes() == b"aa" and (tmp_path / "out" / "b.txt").read_text() == "bbb"
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a.bin", "b.txt", "er.txt"]


def test_sounds_by_value():
    def plain(seed, n):
        s, out = (seed + 0x9E3779B97F4A7C15) % 2**64, []
        for _ in range(n):
            s ^= s << 13 & (1 << 64) - 1
            s ^= s >> 7
            s ^= s << 17 & (1 << 64) - 1
            out.append((s >> 48) / 65535 * 2 - 1)
        return out

    seeds = [0, 1, 10_003, 2**64 - 5]
    assert np.allclose(noises(seeds, 50), [plain(s, 50) for s in seeds], atol=0)
    rate = 1000
    click = render([(0.1004, True), (0.3, False)], 0.5, rate)
    t = np.arange(35) / rate
    assert len(click) == 500 and np.allclose(click[100:135], 0.8 * np.sin(2 * np.pi * 1760 * t) * np.exp(-80 * t), atol=1e-6) and not click[135:300].any()
    drumless = render([(0.0, False)], 0.4, rate, "drumless")
    t = np.arange(320) / rate
    want = sum(0.22 * g * np.sin(2 * np.pi * 220 * r * t) for r, g in ((1, 1), (1.25, 0.5), (1.5, 0.35))) * np.exp(-7 * t)
    assert np.allclose(drumless[:320], want, atol=1e-5)
    beats = [(0.0, True), (0.4, False)]
    drums = render(beats, 1.0, rate, "percussion")
    between = np.array(plain(10_000, 35)) * 0.12 * np.exp(-45 * np.arange(35) / rate)
    pitch = 0.16 * math.sin(2 * math.pi * 220 * 0.21) * math.exp(-12 * 0.21)  # the first beat's kick is over by then
    assert abs(drums[210] - (pitch + between[10])) < 1e-5
    assert len(render([], 0.0105, 100)) == 2


def test_edge_repair_needs_a_last_grid_beat():
    """Pulse 0..29 turned double at the end: extras go where the track ends on the grid, and stay where it ends on an extra."""
    level = [(0.5 * k, 0.0 if k % 2 == 0 else -20.0) for k in range(70)]
    beats = lambda extras: [e.Beat(t, 1.0, 0.0) for t in sorted([float(k) for k in range(30)] + extras)]
    inside = [k + 0.5 for k in range(13, 29)]
    assert e.double_time_extras(beats(inside), level) == {i for i, b in enumerate(beats(inside)) if b.t % 1}
    assert e.double_time_extras(beats([*inside, 29.5]), level) == set()
    o = e.Observations(31.0, beats([*inside, 29.5]), level)
    assert not e.repair_edges(o) and len(o.beats) == 47


def test_recovered_beats_take_their_confidence_from_inside_the_span():
    p = e.EstimatorOptions()
    left = [0.5 * k for k in range(20)]
    beats = [e.Beat(t, 0.9, 0.0) for t in [*left, 9.7, 9.9]] + [e.Beat(10.3 + 0.4 * k, 0.8, 0.0) for k in range(20)]
    segments = [e.Segment(0, 9.5, "constant", 120, 120, 1), e.Segment(9.5, 10.3, "ramp", 120, 150, 0.6), e.Segment(10.3, 18.0, "constant", 150, 150, 1)]
    (block,) = e.transitions(segments, p.jump_ratio)
    new = e.recover_grid(beats, segments, block, p)
    assert new is not None and all(b > a for a, b in zip([x.t for x in new], [x.t for x in new][1:]))
    assert not e.transitions(segments, 0.5), "a larger jump ratio asks for larger changes"


def test_constants_follow_the_options():
    curve = ([0.0, 1.0, 2.0], [100.0, 104.0, 104.0], [1.0] * 3)
    kinds = lambda **o: [s.kind for s in e.build_segments(*curve, 3.0, e.EstimatorOptions(curve_tolerance_octaves=0.001, **o))]
    assert kinds() == ["ramp", "constant"] and kinds(constant_ratio=0.05) == ["constant", "constant"]
