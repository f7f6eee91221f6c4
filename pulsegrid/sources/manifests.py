"""JSON manifests as DataFrames, and the queries that find what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import schema


def _json(spark: SparkSession, path: str | list[str], ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path).withColumn("_path", F.col("_metadata.file_path"))


def load_recipes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Recipe segments in the form the truth generator takes, defaults filled in."""
    r = _json(spark, path, schema.RECIPE).select("id", F.coalesce("sample_rate", F.lit(44100)).alias("sample_rate"), F.coalesce("beats_per_bar", F.lit(4)).alias("beats_per_bar"), F.coalesce("audio_profile", F.lit("click")).alias("audio_profile"), "_path", F.posexplode("segments").alias("seg", "s"))
    start = F.coalesce("s.bpm", "s.start_bpm")
    return r.select(F.col("id").alias("recipe_id"), F.col("seg").cast("long").alias("seg"), "s.duration_s", "s.kind", start.alias("start_bpm"), F.coalesce("s.bpm", "s.end_bpm").alias("end_bpm"), "sample_rate", "beats_per_bar", "audio_profile", "_path")


def load_truth(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _json(spark, path, schema.TRUTH)


def _thresholds(own: str, suite: str) -> Column:
    """A case's thresholds, else the suite's, else the defaults, each as a whole; downbeats need no F1 unless told."""
    defaults = F.struct(*[F.lit(v).alias(k) for k, v in schema.THRESHOLDS.items()])
    t = F.coalesce(F.col(own), F.col(suite), defaults)
    return t.withField("min_downbeat_f1", F.coalesce(t["min_downbeat_f1"], F.lit(schema.THRESHOLDS["min_downbeat_f1"])))


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """One row per case; the purpose defaults to regression, a case's thresholds replace the suite's whole."""
    s = _json(spark, path, schema.SUITE).select("schema_version", F.col("id").alias("suite_id"), F.coalesce("purpose", F.lit("regression")).alias("purpose"), F.col("thresholds").alias("suite_thresholds"), F.explode("cases").alias("c"))
    s = s.withColumn("own", F.col("c.thresholds")).withColumn("thresholds", _thresholds("own", "suite_thresholds"))
    return s.select("schema_version", "suite_id", "purpose", F.col("c.id").alias("case_id"), F.col("c.input").alias("input"), F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"), "c.provenance", "thresholds")


def threshold_violations(cases: DataFrame) -> DataFrame:
    """case_id, code: tolerances that are not positive, shares outside [0, 1], negative error budgets."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    t = {k: F.col(f"thresholds.{k}") for k in schema.THRESHOLDS}
    code = F.lit(None).cast("string")
    for k in ("max_tempo_p95_error_percent", "max_tempo_median_error_percent"):
        code = F.when(~(finite(t[k]) & (t[k] >= 0)), f"bad_{k}").otherwise(code)
    for k in ("min_change_recall", "min_downbeat_f1", "min_beat_f1"):
        code = F.when(~(finite(t[k]) & t[k].between(0, 1)), f"bad_{k}").otherwise(code)
    for k in ("change_tolerance_s", "beat_tolerance_ms"):
        code = F.when(~(finite(t[k]) & (t[k] > 0)), f"bad_{k}").otherwise(code)
    return cases.select("case_id", code.alias("code")).where("code IS NOT NULL")


def truth_violations(truths: DataFrame) -> DataFrame:
    """id, code: the first thing wrong with each external truth (schema, duration, beats, tempo segments, changes)."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    d = F.col("duration_s")
    inside = lambda c: finite(c) & (c >= 0) & (c <= d)
    none = F.array()
    beats, parts, changes = F.coalesce("beats", none.cast("array<struct<time_s:double,downbeat:boolean>>")), F.col("tempo_segments"), F.col("change_points")
    parts = F.coalesce(parts, none.cast(truths.schema["tempo_segments"].dataType))
    changes = F.coalesce(changes, none.cast(truths.schema["change_points"].dataType))
    neighbours = lambda a: F.when(F.size(a) > 1, F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.struct(F.element_at(a, i).alias("x"), F.element_at(a, i + 1).alias("y")))).otherwise(F.array().cast(f"array<struct<x:{{0}},y:{{0}}>>".format(truths.select(a.alias("a")).schema["a"].dataType.elementType.simpleString())))
    code = (
        F.when(F.col("schema_version") != 1, "unsupported_schema")
        .when((F.trim(F.coalesce("id", F.lit(""))) == "") | ~finite(d) | (d <= 0), "no_id_or_duration")
        .when(F.exists(beats, lambda b: ~inside(b["time_s"])), "beat_out_of_range")
        .when(F.exists(neighbours(beats), lambda p: p["y"]["time_s"] <= p["x"]["time_s"]), "beats_not_rising")
        .when(F.exists(parts, lambda s: ~inside(s["start_s"]) | ~inside(s["end_s"]) | (s["end_s"] <= s["start_s"])), "segment_bounds")
        .when(F.exists(parts, lambda s: ~(finite(s["start_bpm"]) & finite(s["end_bpm"]) & (F.least(s["start_bpm"], s["end_bpm"]) > 0) & (F.greatest(s["start_bpm"], s["end_bpm"]) <= 1000))), "bpm_out_of_range")
        .when(F.exists(neighbours(parts), lambda p: p["y"]["start_s"] < p["x"]["end_s"]), "segments_overlap")
        .when(F.exists(changes, lambda c: ~inside(c["time_s"])), "change_out_of_range")
        .when(F.exists(neighbours(changes), lambda p: p["y"]["time_s"] < p["x"]["time_s"]), "changes_not_ordered")
    )
    return truths.select("id", code.alias("code")).where("code IS NOT NULL")


def load_predictions(spark: SparkSession, directory: str) -> DataFrame:
    """Analyses of ``<case-id>.json`` files: case_id, beats, curve, changes."""
    point, change = "ARRAY<STRUCT<time_s: DOUBLE, bpm: DOUBLE, confidence: DOUBLE>>", "ARRAY<STRUCT<time_s: DOUBLE, kind: STRING>>"
    p = _json(spark, directory, f"beats ARRAY<STRUCT<time_s: DOUBLE, downbeat: BOOLEAN>>, curve {point}, tempo_curve {point}, changes {change}, change_points {change}")
    return p.select(F.regexp_extract(F.url_decode("_path"), r"([^/]+)\.json$", 1).alias("case_id"), "beats", F.coalesce("curve", "tempo_curve").alias("curve"), F.coalesce("changes", "change_points").alias("changes"))


def lower_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def safe_relative(path: Column) -> Column:
    """Not empty, not absolute, no step upwards."""
    return (path != "") & ~path.startswith("/") & ~F.exists(F.split(path, r"[/\\]"), lambda p: p == "..")


def suite_violations(cases: DataFrame) -> DataFrame:
    """case_id, code: repeated ids, provenance that contradicts the input, bad digests, private yet redistributable."""
    repeated = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("repeated_id").alias("code"))
    generated = F.col("input.kind") == "generated"
    code = (
        F.when(generated != (F.col("provenance.kind") == "generated"), "provenance_contradicts_input")
        .when(~generated & ~F.coalesce(lower_sha256(F.col("input.audio.sha256")), F.lit(False)), "bad_sha256")
        .when((F.col("provenance.kind") == "private") & F.col("provenance.redistributable"), "private_but_redistributable")
        .when(~F.coalesce(safe_relative(F.coalesce("input.recipe", "input.truth")), F.lit(False)), "unsafe_path")
        .when(~safe_relative(F.coalesce("input.audio.local_file_hint", F.lit("x"))), "unsafe_path")
        .when(F.trim("case_id") == "", "empty_id")
    )
    return repeated.unionByName(cases.select("case_id", code.alias("code")).where("code IS NOT NULL"))


def purpose_gate(cases: DataFrame, holdout_allowed: bool = False) -> None:
    """Candidate evaluations run on calibration suites, on holdouts only when allowed."""
    allowed = {"calibration", *(["holdout"] if holdout_allowed else [])}
    found = {r.purpose for r in cases.select("purpose").distinct().collect()}
    if not found <= allowed:
        raise ValueError(f"suite purpose {sorted(found - allowed)} may not be used here")


def model_pack_violations(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """role, code: what the files under ``root`` lack against the manifest: presence, size, digest, link, roles."""
    a = _json(spark, manifest, schema.MODEL_PACK).select(F.explode("artifacts").alias("a")).select("a.*")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("found_size"), F.sha2("content", 256).alias("found_sha256"))
    code = (
        F.when(~safe_relative(F.col("file")), "unsafe_path")
        .when(~lower_sha256(F.col("sha256")), "bad_sha256")
        .when(~F.col("download_url").startswith("https://"), "not_https")
        .when(F.col("found_size").isNull(), "missing")
        .when(F.col("found_size") != F.col("size_bytes"), "wrong_size")
        .when(F.col("found_sha256") != F.col("sha256"), "wrong_digest")
    )
    bad = a.join(files, "file", "left").select("role", code.alias("code")).where("code IS NOT NULL")
    need = spark.createDataFrame([("mel_frontend",), ("beat_model",)], "role string")
    absent = need.join(a.select("role"), "role", "left_anti").withColumn("code", F.lit("role_absent"))
    twice = a.groupBy("role").agg(F.count("*").alias("n")).where("n > 1").select("role", F.lit("role_repeated").alias("code"))
    return bad.unionByName(absent).unionByName(twice)


def path_for_role(spark: SparkSession, manifest: str, root: str, role: str) -> str | None:
    """Where the artifact of ``role`` lies below ``root``; None if the pack has none."""
    a = _json(spark, manifest, schema.MODEL_PACK).select(F.explode("artifacts").alias("a")).where(F.col("a.role") == role).select("a.file").first()
    return f"{root.rstrip('/')}/{a['file']}" if a else None


def feature_contract(spark: SparkSession, manifest: str) -> DataFrame:
    """Whether a pack feeds 22,050 Hz, 128 bands, 50 frames a second."""
    c = F.col("feature_contract")
    ok = (c["sample_rate_hz"] == 22050) & (c["mel_bands"] == 128) & (c["frame_rate_hz"] == 50.0)
    return _json(spark, manifest, schema.MODEL_PACK).select("id", "backend", ok.alias("supported"))


def lock_violations(spark: SparkSession, lock: str) -> DataFrame:
    a = _json(spark, lock, schema.DATASET_LOCK).select(F.explode("assets").alias("a")).select("a.*")
    code = F.when(~safe_relative(F.col("path")), "unsafe_path").when(~F.col("url").startswith("https://"), "not_https").when(~lower_sha256(F.col("sha256")), "bad_sha256").when(F.col("size_bytes") <= 0, "bad_size").when(~F.col("role").isin("audio", "annotation_source"), "unknown_role")
    return a.select("path", code.alias("code")).where("code IS NOT NULL")


def assets_to_fetch(spark: SparkSession, lock: str, directory: str, with_annotations: bool = False) -> DataFrame:
    """Assets of a lock that no verified file under ``directory`` covers yet."""
    a = _json(spark, lock, schema.DATASET_LOCK).select(F.explode("assets").alias("a")).select("a.*")
    wanted = a if with_annotations else a.where("role <> 'annotation_source'")
    have = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select(F.sha2("content", 256).alias("sha256"))
    return wanted.join(have, "sha256", "left_anti")


def install_assets(spark: SparkSession, lock: str, mirror: str, directory: str, with_annotations: bool = False) -> DataFrame:
    """Verify what a lock still lacks against the files of a local ``mirror`` and write it below ``directory``: path, code.

    Assets are found by digest, as files or as members of ZIP archives. A member that the lock names is read by ranges from an archive of the
    size that it gives, however large; other archives are searched whole. Size and digest are checked before a file gets its name.
    Without a mirror nothing can be had here: this library opens no connection.
    """
    from pulsegrid.sources import audio
    from pulsegrid.sources.files import write_file, zip_member

    def members(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"content": [zip_member(path, name) for path, name in zip(b.path, b.member, strict=True)]})

    wanted = assets_to_fetch(spark, lock, directory, with_annotations)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(mirror)
    zipped = audio.zip_members(files.where(F.lower("path").endswith(".zip")).select("path", "content")).where("content IS NOT NULL").select("content")
    named = wanted.where("zip_member IS NOT NULL").select(F.col("zip_member.member_path").alias("member"), F.col("zip_member.archive_size_bytes").alias("length"))
    ranged = files.select("path", "length").join(named, "length").mapInPandas(members, "content binary").where("content IS NOT NULL")
    have = files.select("content").unionByName(zipped).unionByName(ranged).withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    found = wanted.join(have, "sha256", "left").select("path", "size_bytes", "content")
    bad = found.select("path", F.when(F.col("content").isNull(), "not_in_mirror").when(F.length("content") != F.col("size_bytes"), "wrong_size").when(~safe_relative(F.col("path")), "unsafe_path").alias("code"))

    def write(rows) -> None:
        for r in rows:
            write_file(directory, r.path, bytes(r.content))

    found.where(F.col("content").isNotNull() & (F.length("content") == F.col("size_bytes")) & safe_relative(F.col("path"))).foreachPartition(write)
    return bad.where("code IS NOT NULL")


def resolve_audio(cases: DataFrame, files: DataFrame) -> DataFrame:
    """case_id, path: the file with the wanted digest, the hinted name first, then the first path."""
    want = cases.select("case_id", F.col("input.audio.sha256").alias("sha256"), F.col("input.audio.local_file_hint").alias("hint"))
    away = F.when(F.col("hint").isNotNull() & F.col("path").endswith(F.concat(F.lit("/"), F.col("hint"))), 0).otherwise(1)
    return want.join(files.select("path", "sha256"), "sha256").groupBy("case_id").agg(F.min_by("path", F.struct(away, F.col("path"))).alias("path"))


def write_report(report: DataFrame, path: str, no_fail: bool = False) -> int:
    """JSON report; the exit code is 1 when any row failed, unless ``no_fail``."""
    report.write.mode("overwrite").json(path)
    written = report.sparkSession.read.schema("passed boolean").json(path)
    return int(not no_fail and not written.where("NOT passed").isEmpty())
