"""Explicit schemas of the JSON documents."""

RECIPE = (
    "schema_version INT, id STRING, sample_rate INT, beats_per_bar INT, audio_profile STRING, "
    "segments ARRAY<STRUCT<duration_s: DOUBLE, kind: STRING, bpm: DOUBLE, start_bpm: DOUBLE, end_bpm: DOUBLE>>"
)
TRUTH = (
    "schema_version INT, id STRING, duration_s DOUBLE, beats ARRAY<STRUCT<time_s: DOUBLE, downbeat: BOOLEAN>>, "
    "tempo_segments ARRAY<STRUCT<start_s: DOUBLE, end_s: DOUBLE, kind: STRING, start_bpm: DOUBLE, end_bpm: DOUBLE>>, change_points ARRAY<STRUCT<time_s: DOUBLE, kind: STRING>>"
)
#: Default thresholds of a suite.
THRESHOLDS = {"beat_tolerance_ms": 70.0, "change_tolerance_s": 1.0, "min_beat_f1": 0.99, "min_downbeat_f1": 0.0, "max_tempo_median_error_percent": 5.0, "max_tempo_p95_error_percent": 15.0, "min_change_recall": 0.5}
_THRESHOLDS = "STRUCT<beat_tolerance_ms: DOUBLE, change_tolerance_s: DOUBLE, min_beat_f1: DOUBLE, min_downbeat_f1: DOUBLE, max_tempo_median_error_percent: DOUBLE, max_tempo_p95_error_percent: DOUBLE, min_change_recall: DOUBLE>"
SUITE = (
    f"schema_version INT, id STRING, description STRING, purpose STRING, thresholds {_THRESHOLDS}, cases ARRAY<STRUCT<id: STRING, "
    "input: STRUCT<kind: STRING, recipe: STRING, truth: STRING, audio: STRUCT<sha256: STRING, local_file_hint: STRING>>, tags: ARRAY<STRING>, "
    "provenance: STRUCT<kind: STRING, audio_license: STRING, annotation_license: STRING, redistributable: BOOLEAN, commercial_evaluation_allowed: BOOLEAN, attribution: STRING, source_url: STRING>, "
    f"thresholds: {_THRESHOLDS}>>"
)
MODEL_PACK = (
    "schema_version INT, id STRING, version STRING, backend STRING, source STRUCT<repository: STRING, revision: STRING, license: STRING>, "
    "feature_contract STRUCT<sample_rate_hz: INT, mel_bands: INT, frame_rate_hz: DOUBLE, chunk_duration_s: DOUBLE>, "
    "artifacts ARRAY<STRUCT<role: STRING, file: STRING, sha256: STRING, size_bytes: LONG, download_url: STRING>>"
)
DATASET_LOCK = (
    "schema_version INT, id STRING, version STRING, homepage_url STRING, license STRING, attribution STRING, "
    "assets ARRAY<STRUCT<path: STRING, url: STRING, sha256: STRING, size_bytes: LONG, role: STRING, zip_member: STRUCT<archive_size_bytes: LONG, member_path: STRING>>>"
)
