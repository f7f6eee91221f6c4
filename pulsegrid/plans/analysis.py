"""Whole analyses of many tracks: one group per track, one nested row out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pulsegrid.functions.estimator import Beat, Observations, ObservationError, analyze
from pulsegrid.options import ANALYSIS_SCHEMA_VERSION, ESTIMATOR_POLICIES, EstimatorOptions, estimator_policy

PARTS = {
    "beats": "array<struct<time_s:double,confidence:double,downbeat_confidence:double,downbeat:boolean>>",
    "hypotheses": "array<struct<bpm:double,relative_score:double,metrical_level:int>>",
    "curve": "array<struct<time_s:double,bpm:double,confidence:double>>",
    "segments": "array<struct<start_s:double,end_s:double,kind:string,start_bpm:double,end_bpm:double,confidence:double>>",
    "changes": "array<struct<time_s:double,kind:string,score:double,before_bpm:double,after_bpm:double>>",
    "sections": "array<struct<start_s:double,end_s:double,bpm:double,stability:double,beat_count:long>>",
}
SCHEMA = "track_id long, schema_version int, duration_s double, global_bpm double, " + ", ".join(f"{k} {v}" for k, v in PARTS.items()) + ", warnings array<string>, error string"


def analyze_tracks(beats: DataFrame, policy: str | EstimatorOptions = "default", strict: bool = False) -> DataFrame:
    """One row per track of (track_id, duration_s, time_s, confidence, downbeat_confidence[, activity_s, relative_db, frame_rate]).

    A track that breaks the input contract becomes a row with ``error`` set, or raises when ``strict``.
    """
    options = policy if isinstance(policy, EstimatorOptions) else estimator_policy(policy)
    columns = [c for c in ("track_id", "duration_s", "time_s", "confidence", "downbeat_confidence", "activity_s", "relative_db", "frame_rate") if c in beats.columns]
    names = {k: [f.split(":")[0] for f in v.removeprefix("array<struct<").removesuffix(">>").split(",")] for k, v in PARTS.items()}

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def one(key, table):
        c = table.to_pydict()
        rows = [Beat(*r) for r in sorted(zip(c["time_s"], c["confidence"], c["downbeat_confidence"]))]
        duration = c["duration_s"][0]
        activity = [(t, db) for t, db in sorted(zip(c["activity_s"], c["relative_db"])) if t <= duration] if "activity_s" in c else []
        rate = c["frame_rate"][0] if "frame_rate" in c else None
        row = {"track_id": key[0].as_py(), "schema_version": ANALYSIS_SCHEMA_VERSION, "duration_s": duration, "global_bpm": None, "warnings": [], "error": None, **{k: [] for k in PARTS}}
        try:
            a = analyze(Observations(duration, rows, activity, rate), options)
            row |= {"global_bpm": a["global_bpm"], "warnings": a["warnings"]}
            row |= {k: [dict(zip(names[k], x)) for x in a[k]] for k in PARTS}
        except ObservationError as e:
            if strict:
                raise
            row["error"] = str(e)
        return pa.Table.from_pylist([row], schema=arrow)

    return beats.select(*columns).groupBy("track_id").applyInArrow(one, SCHEMA)


def part(analyses: DataFrame, name: str) -> DataFrame:
    """One part of the analyses as rows."""
    return analyses.select("track_id", F.posexplode(name).alias("ord", "x")).select("track_id", "ord", "x.*")


def to_json(analyses: DataFrame) -> DataFrame:
    """The versioned JSON document of each track."""
    return analyses.where("error IS NULL").select("track_id", F.to_json(F.struct(*[c for c in analyses.columns if c not in ("track_id", "error")])).alias("document"))


def policies() -> list[str]:
    return list(ESTIMATOR_POLICIES)
