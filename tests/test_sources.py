import io
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from pulsegrid import cli
from pulsegrid.engine import Engine, OnsetBackend, analyze_timing
from pulsegrid.functions.synthesis import noises, render
from pulsegrid.sources import audio, manifests
from pulsegrid.streaming.windows import windowed_rate


def test_wav_round_trip_and_scan(spark, tmp_path):
    x = render([(0.5 * k, k % 4 == 0) for k in range(16)], 8.0, 22_050)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.WAV").write_bytes(audio.encode_wav(x, 22_050))
    (tmp_path / "a" / "y.mp3").write_bytes(b"no audio")
    (tmp_path / "a" / "note.txt").write_text("no")
    got = {r.path[-5:]: r for r in audio.decode_audio(audio.scan_audio(spark, str(tmp_path))).collect()}
    assert len(got) == 2 and got["y.mp3"].error and np.allclose(got["x.WAV"].samples, x, atol=1e-4)
    assert abs(noises([1, 2], 2000).mean()) < 0.1


def test_engine_finds_the_pulse(spark):
    rate = 8000
    x = render([(0.5 * k, k % 4 == 0) for k in range(24)], 12.0, rate)
    stereo = np.repeat(x, 2).tolist()
    pcm = spark.createDataFrame([(7, rate, 2, stereo)], "track_id long, sample_rate int, channels int, samples array<float>")
    a = Engine(OnsetBackend()).analyze_pcm(pcm).first()
    assert abs(a.global_bpm - 120) < 2
    bad = spark.createDataFrame([(1, rate, 2, [0.0, 0.0, 0.0])], pcm.schema)
    assert audio.pcm_violations(bad).first().code == "broken_frame"


def test_host_timing(spark):
    b = spark.createDataFrame([(1, 0.5 * k) for k in range(20)], "track_id long, time_s double")
    a = analyze_timing(b, b.where("time_s % 2 = 0").withColumn("time_s", F.col("time_s") + 0.03), b.groupBy("track_id").agg(F.lit(10.0).alias("duration_s"))).first()
    assert [x.time_s for x in a.beats if x.downbeat] == [0.0, 2.0, 4.0, 6.0, 8.0] and abs(a.global_bpm - 120) < 1e-9


def test_model_pack_and_zip(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "mel.onnx").write_bytes(b"abc")
    art = {"role": "mel_frontend", "file": "mel.onnx", "sha256": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", "size_bytes": 3, "download_url": "https://x"}
    m = tmp_path / "pack.json"
    m.write_text(json.dumps({"schema_version": 1, "id": "p", "backend": "b", "feature_contract": {"sample_rate_hz": 22050, "mel_bands": 128, "frame_rate_hz": 50.0}, "artifacts": [art]}, indent=1))
    assert [(r.role, r.code) for r in manifests.model_pack_violations(spark, str(m), str(root)).collect()] == [("beat_model", "role_absent")]
    assert manifests.feature_contract(spark, str(m)).first().supported
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("d/a.txt", "abc")
    files = spark.createDataFrame([("z", bytearray(z.getvalue()))], "path string, content binary")
    assert [(r.member, bytes(r.content)) for r in audio.zip_members(files).collect()] == [("d/a.txt", b"abc")]


def test_recipe_suite_by_command(spark, tmp_path):
    d = tmp_path / "recipes"
    d.mkdir()
    for name, segs in {"c": [(16, 120)], "s": [(10, 120), (9, 160)]}.items():
        (d / f"{name}.json").write_text(json.dumps({"schema_version": 1, "id": name, "segments": [{"duration_s": t, "kind": "constant", "bpm": b} for t, b in segs]}, indent=1))
    assert cli.main(["eval", str(d), str(tmp_path / "report")]) == 0
    assert cli.main(["render", str(d), str(tmp_path)]) == 0 and (tmp_path / "s.wav").exists()


def test_stream(spark, tmp_path):
    e = spark.range(100).select((F.col("id") % 3).alias("track_id"), (F.timestamp_seconds(F.col("id") * 3600)).alias("ts"), F.lit(1.0).alias("value"))
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windowed_rate(s).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert spark.table("rates").agg(F.sum("n_events")).first()[0] == 100
