"""Named queries over the test tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators import folds, scoring, sequence, signal, truth
from pulsegrid.options import DECODER_POLICIES, EstimatorOptions
from pulsegrid.plans import analysis, decoding
from pulsegrid.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
QUIET = EstimatorOptions(silence_threshold_db=-20.0)


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places as SQL does it, counts as long.

    The scaled double is rounded: 0.026887499999999998, a mean of 0.0268875, gives 26887.5 and goes up. Spark's own round takes the digits.
    """
    out: list[Column] = []
    for name, kind in df.dtypes:
        out.append((F.round(F.col(name).cast("double") * 1e6) / 1e6).alias(name) if kind in ("double", "float") else F.col(name).cast("long").alias(name) if kind in ("int", "tinyint", "smallint") else F.col(name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: r6(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add




_CHANGES = """SELECT recipe_id, (min(start_s) + max(end_s)) / 2 AS time_s, 'rhythm_discontinuity' AS kind FROM (SELECT *, row_number() OVER w - sum(CASE WHEN kind = 'silence' THEN 1 ELSE 0 END) OVER w AS g FROM timeline WINDOW w AS (PARTITION BY recipe_id ORDER BY seg)) WHERE kind = 'silence' GROUP BY recipe_id, g
    UNION ALL SELECT recipe_id, start_s, CASE WHEN abs(ln(start_bpm / pe)) > 0.009950330853168083::DOUBLE THEN 'tempo_jump' ELSE 'ramp_boundary' END FROM (SELECT *, lag(kind) OVER w AS pk, lag(end_bpm) OVER w AS pe FROM timeline WINDOW w AS (PARTITION BY recipe_id ORDER BY seg))
    WHERE kind <> 'silence' AND pk <> 'silence' AND (abs(ln(start_bpm / pe)) > 0.009950330853168083::DOUBLE OR (kind = 'linear_ramp') <> (pk = 'linear_ramp'))"""


def _deduped(key: str, peaks: str) -> str:
    """Peaks within one frame of the running mean of their group, as that mean."""
    return f"""SELECT {key}, emit AS frame FROM (WITH RECURSIVE pk AS (SELECT {key}, list(frame::DOUBLE ORDER BY frame) AS f FROM {peaks} GROUP BY ALL),
        s AS (SELECT {key}, f, 1 AS i, f[1] AS m, 1 AS n, NULL::DOUBLE AS emit FROM pk UNION ALL SELECT {key}, f, i + 1, CASE WHEN i < len(f) AND f[i+1] - m <= 1 THEN m + (f[i+1] - m) / (n + 1) ELSE f[i+1] END, CASE WHEN i < len(f) AND f[i+1] - m <= 1 THEN n + 1 ELSE 1 END, CASE WHEN i >= len(f) OR f[i+1] - m > 1 THEN m END FROM s WHERE i <= len(f))
        SELECT {key}, emit FROM s WHERE emit IS NOT NULL)"""


# Relations of the oracle side, named as the operators name them.
_CTE = {
    "beats": """SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
        (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE / 50000 AS time_s,
        least(value / 500, 1.0::DOUBLE) AS confidence, CASE WHEN event_type = 'purchase' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS downbeat_confidence, value AS rms FROM events""",
    "tracks": "SELECT track_id, max(time_s) + 1 AS duration_s FROM beats GROUP BY track_id",
    "activity": """SELECT track_id, idx, time_s + 0.05::DOUBLE AS time_s, rms,
        least(greatest(20 * log10(greatest(rms / max(rms) OVER (PARTITION BY track_id), 1e-6::DOUBLE)), -120.0::DOUBLE), 0.0::DOUBLE) AS relative_db FROM beats""",
    "gaps": """SELECT *, least(greatest(raw_bpm, 40.0::DOUBLE), 320.0::DOUBLE) AS bounded_bpm FROM (SELECT *, 60.0::DOUBLE / dt AS raw_bpm FROM (
        SELECT track_id, idx, time_s, confidence, lead(confidence) OVER w AS next_confidence, lead(time_s) OVER w - time_s AS dt FROM beats WINDOW w AS (PARTITION BY track_id ORDER BY time_s)) WHERE dt IS NOT NULL)""",
    "context": """SELECT *, median(bounded_bpm) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS left_median,
        median(bounded_bpm) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS right_median FROM gaps""",
    "repair": """SELECT *, CASE WHEN repaired THEN (left_median + right_median) / 2 ELSE bounded_bpm END AS repaired_bpm FROM (SELECT *, coalesce(
        left_median IS NOT NULL AND right_median IS NOT NULL AND abs(ln(left_median / right_median)) <= 0.11332868530700317::DOUBLE
        AND abs(round(log2(bounded_bpm) - (log2(left_median) + log2(right_median)) / 2)) >= 1
        AND abs(log2(bounded_bpm) - (log2(left_median) + log2(right_median)) / 2 - round(log2(bounded_bpm) - (log2(left_median) + log2(right_median)) / 2)) <= log2(1.12::DOUBLE), false) AS repaired FROM context)""",
    "smooth": """SELECT *, CASE WHEN count(*) OVER w = 3 AND max(repaired_bpm) OVER w / min(repaired_bpm) OVER w <= 1.12::DOUBLE THEN pow(2, avg(log2(repaired_bpm)) OVER w) ELSE repaired_bpm END AS smoothed_bpm
        FROM repair WINDOW w AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    "curve": """SELECT track_id, idx, time_s + dt / 2 AS time_s, smoothed_bpm AS bpm, least(greatest(least(confidence, next_confidence) * exp(-8 * abs(log2(bounded_bpm / smoothed_bpm))), 0.0::DOUBLE), 1.0::DOUBLE) AS confidence FROM smooth""",
    "near": """SELECT * EXCLUDE (k) FROM (SELECT b.*, a.relative_db AS near_db, row_number() OVER (PARTITION BY b.track_id, b.idx ORDER BY abs(a.time_s - b.time_s), a.idx) AS k FROM beats b JOIN activity a USING (track_id)) WHERE k = 1""",
    "regions": """SELECT track_id, start_s, end_s, depth_db FROM (SELECT r.track_id, greatest(first_s - hop / 2, 0.0::DOUBLE) AS start_s, least(last_s + hop / 2, duration_s) AS end_s, least(low, 0.0::DOUBLE) AS depth_db FROM (
        SELECT track_id, g, min(time_s) AS first_s, max(time_s) AS last_s, min(relative_db) AS low FROM (SELECT *, idx - sum(CASE WHEN relative_db <= -20 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY time_s) AS g FROM activity) WHERE relative_db <= -20 GROUP BY track_id, g) r
        JOIN (SELECT track_id, median(hop) AS hop FROM (SELECT track_id, lead(time_s) OVER (PARTITION BY track_id ORDER BY time_s) - time_s AS hop FROM activity) GROUP BY track_id) USING (track_id) JOIN tracks USING (track_id)) WHERE end_s - start_s >= 0.8""",
    "recipes": """SELECT p_partkey // 4 AS recipe_id, p_partkey % 4 AS seg, (6 + p_size % 7)::DOUBLE AS duration_s, CASE WHEN p_partkey % 5 = 4 THEN 'silence' WHEN p_partkey % 5 = 2 THEN 'linear_ramp' ELSE 'constant' END AS kind,
        (60 + 2 * p_size)::DOUBLE AS start_bpm, CASE WHEN p_partkey % 5 = 2 THEN (60 + 2 * ((p_size * 7) % 50))::DOUBLE ELSE (60 + 2 * p_size)::DOUBLE END AS end_bpm, p_brand AS tag FROM part""",
    "timeline": "SELECT *, end_s - duration_s AS start_s FROM (SELECT *, sum(duration_s) OVER (PARTITION BY recipe_id ORDER BY seg) AS end_s FROM recipes)",
    "truth_raw": """SELECT recipe_id, seg, k, start_s, CASE WHEN kind = 'linear_ramp' AND start_bpm <> end_bpm
        THEN (-start_bpm + sqrt(greatest(start_bpm ** 2 + 120 * ((end_bpm - start_bpm) / duration_s) * k, 0.0::DOUBLE))) / ((end_bpm - start_bpm) / duration_s) ELSE 60.0::DOUBLE * k / start_bpm END AS pos, duration_s
        FROM (SELECT *, unnest(range(0, floor(duration_s * (start_bpm + end_bpm) / 120)::BIGINT + 1)) AS k FROM timeline WHERE kind <> 'silence')""",
    "truth_beats": """SELECT recipe_id, beat_index, time_s, beat_index % 4 = 0 AS downbeat FROM (SELECT *, lag(time_s) OVER (PARTITION BY recipe_id ORDER BY beat_index) AS prev FROM (
        SELECT recipe_id, row_number() OVER (PARTITION BY recipe_id ORDER BY seg, k) - 1 AS beat_index, start_s + pos AS time_s FROM truth_raw WHERE pos < duration_s - 1e-9)) WHERE prev IS NULL OR abs(time_s - prev) > 1e-9""",
    "segments": "SELECT recipe_id, seg, start_s, end_s, CASE WHEN kind = 'linear_ramp' THEN 'ramp' ELSE 'constant' END AS kind, start_bpm, end_bpm FROM timeline WHERE kind <> 'silence'",
    "pred": """SELECT recipe_id, row_number() OVER (PARTITION BY recipe_id ORDER BY time_s) - 1 AS idx, time_s, downbeat FROM (
        SELECT recipe_id, time_s + (((beat_index * 7919) % 13) - 6) * 0.012::DOUBLE AS time_s, downbeat FROM truth_beats WHERE beat_index % 11 <> 10)""",
    "matches": """SELECT recipe_id, i, j, p.time_s AS pt, e.time_s AS et FROM (WITH RECURSIVE pl AS (SELECT recipe_id, list(time_s ORDER BY time_s) AS p FROM pred GROUP BY 1), el AS (SELECT recipe_id, list(time_s ORDER BY time_s) AS e FROM truth_beats GROUP BY 1),
        s AS (SELECT recipe_id, 0 AS i, 0 AS j, false AS hit, -1 AS mi, -1 AS mj, p, e FROM pl JOIN el USING (recipe_id)
        UNION ALL SELECT recipe_id, CASE WHEN abs(p[i+1] - e[j+1]) <= 0.07::DOUBLE OR p[i+1] < e[j+1] THEN i + 1 ELSE i END, CASE WHEN abs(p[i+1] - e[j+1]) <= 0.07::DOUBLE OR p[i+1] >= e[j+1] THEN j + 1 ELSE j END, abs(p[i+1] - e[j+1]) <= 0.07::DOUBLE, i, j, p, e FROM s WHERE i < len(p) AND j < len(e))
        SELECT recipe_id, mi AS i, mj AS j FROM s WHERE hit) m JOIN pred p USING (recipe_id) JOIN (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY time_s) - 1 AS jj FROM truth_beats) e USING (recipe_id) WHERE p.idx = m.i AND e.jj = m.j""",
    "counts": """SELECT recipe_id, n_predicted, n_expected, coalesce(matched, 0) AS matched, errs FROM (SELECT recipe_id, count(*) AS n_expected FROM truth_beats GROUP BY 1) JOIN (SELECT recipe_id, count(*) AS n_predicted FROM pred GROUP BY 1) USING (recipe_id)
        LEFT JOIN (SELECT recipe_id, count(*) AS matched, list(abs(pt - et) * 1000 ORDER BY abs(pt - et)) AS errs FROM matches GROUP BY 1) USING (recipe_id)""",
    "metrics": """SELECT recipe_id, n_predicted, n_expected, matched, matched / n_predicted AS precision, matched / n_expected AS recall, CASE WHEN matched = 0 THEN 0 ELSE 2.0::DOUBLE * matched / (n_predicted + n_expected) END AS f1,
        errs[ceil((len(errs) - 1) * 0.5::DOUBLE)::INT + 1] AS median_error_ms, errs[ceil((len(errs) - 1) * 0.95::DOUBLE)::INT + 1] AS p95_error_ms FROM counts""",
    "pgaps": "SELECT recipe_id, idx, time_s + (lead(time_s) OVER w - time_s) / 2 AS mid, 60.0::DOUBLE / (lead(time_s) OVER w - time_s) AS bpm FROM pred WINDOW w AS (PARTITION BY recipe_id ORDER BY time_s)",
    "scored": """SELECT * EXCLUDE (k) FROM (SELECT g.recipe_id, g.idx, g.mid AS time_s, g.bpm, s.start_bpm + (s.end_bpm - s.start_bpm) * ((g.mid - s.start_s) / (s.end_s - s.start_s)) AS truth_bpm, row_number() OVER (PARTITION BY g.recipe_id, g.idx ORDER BY s.start_s) AS k
        FROM (SELECT * FROM pgaps WHERE mid IS NOT NULL) g LEFT JOIN segments s ON g.recipe_id = s.recipe_id AND g.mid >= s.start_s AND g.mid <= s.end_s) WHERE k = 1""",
    "knots": """SELECT DISTINCT track_id, unnest([a, b]) AS k FROM (WITH RECURSIVE l AS (SELECT track_id, list(time_s ORDER BY time_s) AS t, list(log2(bpm) ORDER BY time_s) AS y FROM curve GROUP BY 1),
        s AS (SELECT track_id, t, y, 1::BIGINT AS a, len(t) AS b FROM l UNION ALL SELECT track_id, t, y, unnest([a, w.i]), unnest([w.i, b]) FROM (SELECT *, list_max(list_transform(range(a + 1, b), lambda i: {'d': abs(y[i] - (y[a] + (y[b] - y[a]) / (t[b] - t[a]) * (t[i] - t[a]))), 'i': i})) AS w FROM s WHERE b > a + 1 AND t[b] - t[a] > 2.220446049250313e-16) WHERE w.d > 0.04::DOUBLE) SELECT * FROM s)""",
    "tempo_parts": """SELECT track_id, row_number() OVER w - 1 AS seg, CASE WHEN row_number() OVER w = 1 THEN 0.0::DOUBLE ELSE t[a] END AS start_s, CASE WHEN lead(a) OVER w IS NULL THEN duration_s ELSE t[b] END AS end_s, CASE WHEN abs(ln(v[b] / v[a])) <= ln(1.03::DOUBLE) THEN 'constant' ELSE 'ramp' END AS kind,
        v[a] AS start_bpm, v[b] AS end_bpm, list_avg(c[a:b]) AS confidence FROM (SELECT track_id, k AS a, coalesce(lead(k) OVER (PARTITION BY track_id ORDER BY k), CASE WHEN count(*) OVER (PARTITION BY track_id) = 1 THEN k END) AS b FROM knots)
        JOIN (SELECT track_id, list(time_s ORDER BY time_s) AS t, list(bpm ORDER BY time_s) AS v, list(confidence ORDER BY time_s) AS c FROM curve GROUP BY 1) USING (track_id) JOIN tracks USING (track_id) WHERE b IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY a)""",
    "changes": f"{_CHANGES}",
    "frames": "SELECT vec_id AS track_id, unnest(range(0, len(embedding))) AS frame, unnest(embedding)::DOUBLE * 10 AS logit FROM embeddings",
    "rounded": "SELECT track_id, frame, round(logit) AS logit FROM frames",
    "peaks": "SELECT track_id, frame, logit FROM (SELECT *, max(logit) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM frames) WHERE logit >= top AND logit > 0",
    "low_peaks": "SELECT track_id, frame, logit FROM (SELECT *, max(logit) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM frames) WHERE logit >= top AND logit > -3",
    "upstream": _deduped("track_id", "peaks"),
    "candidates": _deduped("track_id", "low_peaks"),
    "midpoints": """SELECT track_id, frame FROM upstream UNION SELECT track_id, c FROM (SELECT *, count(c) OVER (PARTITION BY track_id ORDER BY g ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sup FROM (SELECT g.track_id, g.g, (SELECT arg_min(c.frame, abs(c.frame - (l + r) / 2) * 1000 + c.frame / 1000) FROM candidates c
        WHERE c.track_id = g.track_id AND c.frame > l + 1 AND c.frame < r - 1 AND r - l > 2 AND abs(c.frame - (l + r) / 2) <= 0.15::DOUBLE * (r - l)) AS c FROM (SELECT track_id, frame AS l, lead(frame) OVER w AS r, row_number() OVER w - 1 AS g FROM upstream WINDOW w AS (PARTITION BY track_id ORDER BY frame)) g WHERE r IS NOT NULL)) WHERE sup >= 3 AND c IS NOT NULL""",
    "ptimes": "SELECT track_id, frame, (frame / 50.0::DOUBLE)::FLOAT::DOUBLE AS time_s FROM peaks",
    "policies": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {r}, {th}::DOUBLE)" for p, r, th, m in DECODER_POLICIES if not m) + ") AS x(policy, radius, threshold)",
    "decoded": f"{_deduped('policy, track_id', 'policy_peaks')} UNION ALL SELECT 'supported-midpoint', track_id, frame FROM midpoints",
    "policy_peaks": """SELECT p.policy, f.track_id, f.frame FROM (SELECT *, max(logit) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS t3, max(logit) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t1 FROM frames) f
        JOIN policies p ON f.logit > p.threshold AND f.logit >= CASE WHEN p.radius = 3 THEN f.t3 ELSE f.t1 END""",
    "policy_hits": """SELECT policy, track_id, len(p) AS n_predicted, max(n) AS matched FROM (WITH RECURSIVE pl AS (SELECT policy, track_id, list((frame / 50.0::DOUBLE)::FLOAT::DOUBLE ORDER BY frame) AS p FROM decoded GROUP BY ALL), el AS (SELECT track_id, list(frame / 50.0::DOUBLE ORDER BY frame) FILTER (frame % 7 = 3) AS e FROM frames GROUP BY 1),
        s AS (SELECT policy, track_id, 1 AS i, 1 AS j, 0 AS n, p, coalesce(e, []) AS e FROM pl JOIN el USING (track_id)
        UNION ALL SELECT policy, track_id, CASE WHEN abs(p[i] - e[j]) <= 0.07::DOUBLE OR p[i] < e[j] THEN i + 1 ELSE i END, CASE WHEN abs(p[i] - e[j]) <= 0.07::DOUBLE OR p[i] >= e[j] THEN j + 1 ELSE j END, CASE WHEN abs(p[i] - e[j]) <= 0.07::DOUBLE THEN n + 1 ELSE n END, p, e FROM s WHERE i <= len(p) AND j <= len(e)) SELECT * FROM s) GROUP BY policy, track_id, p""",
    "cases": """SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (SELECT c.policy, c.track_id, coalesce(n_predicted, 0) AS n_predicted, coalesce(matched, 0) AS matched,
        CASE WHEN coalesce(n_predicted, 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(matched, 0) / n_predicted END AS precision, coalesce(matched, 0) / n_expected AS recall, label
        FROM (SELECT policy, vec_id AS track_id, label, (SELECT count(*) FROM range(0, len(embedding)) x(i) WHERE i % 7 = 3) AS n_expected FROM embeddings CROSS JOIN (SELECT policy FROM policies UNION ALL SELECT 'supported-midpoint')) c LEFT JOIN policy_hits USING (policy, track_id))""",
}
_NEEDS = {
    "tracks": ["beats"], "activity": ["beats"], "gaps": ["beats"], "context": ["gaps"], "repair": ["context"], "smooth": ["repair"], "curve": ["smooth"], "near": ["activity"], "regions": ["activity", "tracks"],
    "timeline": ["recipes"], "truth_raw": ["timeline"], "truth_beats": ["truth_raw"], "segments": ["timeline"], "pred": ["truth_beats"], "matches": ["pred"], "counts": ["matches"], "metrics": ["counts"], "pgaps": ["pred"],
    "scored": ["pgaps", "segments"], "rounded": ["frames"], "peaks": ["frames"], "low_peaks": ["frames"], "ptimes": ["peaks"], "policy_peaks": ["frames", "policies"], "upstream": ["peaks"], "candidates": ["low_peaks"],
    "midpoints": ["upstream", "candidates"], "decoded": ["policy_peaks", "midpoints"], "policy_hits": ["decoded"], "cases": ["policy_hits"], "knots": ["curve"], "tempo_parts": ["knots", "tracks"], "changes": ["timeline"],
}


def sql(select: str, *relations: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _NEEDS.get(name, []):
            visit(n)
        if name not in order:
            order.append(name)

    for name in relations:
        visit(name)
    return "WITH " + ", ".join(f"{n} AS ({_CTE[n]})" for n in order) + " " + select


def rounded(columns: str) -> str:
    """``name=expression`` items: doubles to six places, ``!name`` columns as they are."""
    out = []
    for item in columns.split(", "):
        out.append(item[1:] if item[0] == "!" else f"round({item}::DOUBLE, 6) AS {item}")
    return ", ".join(out)


def plain(name: str, columns: str, relation: str, where: str = "") -> str:
    return sql(f"SELECT {rounded(columns)} FROM {relation} {where}", relation)


# --- Sequences over the events table -------------------------------------------------------------

_c = "least(greatest({0}, 0.0::DOUBLE), 1.0::DOUBLE)"


@query("beat_events", sql(f"SELECT track_id, round(time_s, 6) AS time_s, round({_c.format('confidence')}, 6) AS confidence, round({_c.format('downbeat_confidence')}, 6) AS downbeat_confidence, downbeat_confidence >= 0.5 AS downbeat FROM beats", "beats"))
def _(s, d):
    return sequence.beat_events(t.beats(s, d))


@query("downbeat_filter", plain("x", "!track_id, !idx, time_s", "beats", "WHERE downbeat_confidence >= 0.5"))
def _(s, d):
    return t.beats(s, d).where("downbeat_confidence >= 0.5").select("track_id", "idx", "time_s")


@query("phase_rows", plain("x", "!track_id, !idx, time_s", "beats", "WHERE idx % 2 = 1"))
def _(s, d):
    return t.beats(s, d).where("idx % 2 = 1").select("track_id", "idx", "time_s")


@query("mirrored_beats", sql("SELECT track_id, count(*) OVER (PARTITION BY track_id) - 1 - idx AS idx, round(duration_s - time_s, 6) AS time_s, round(confidence, 6) AS confidence FROM beats JOIN tracks USING (track_id)", "tracks"))
def _(s, d):
    b = t.beats(s, d)
    return sequence.mirror(b, t.tracks(b)).select("track_id", "idx", "time_s", "confidence")


@query("intervals", plain("x", "!track_id, !idx, dt, raw_bpm, bounded_bpm", "gaps"))
def _(s, d):
    return sequence.intervals(t.beats(s, d)).select("track_id", "idx", "dt", "raw_bpm", "bounded_bpm")


@query("context_medians", plain("x", "!track_id, !idx, left_median, right_median", "context"))
def _(s, d):
    return sequence.context_medians(sequence.intervals(t.beats(s, d))).select("track_id", "idx", "left_median", "right_median")


@query("octave_repair", plain("x", "!track_id, !idx, !repaired, repaired_bpm", "repair"))
def _(s, d):
    return sequence.octave_repair(sequence.intervals(t.beats(s, d))).select("track_id", "idx", "repaired", "repaired_bpm")


@query("smooth_tempo", plain("x", "!track_id, !idx, smoothed_bpm", "smooth"))
def _(s, d):
    return sequence.smooth_tempo(sequence.intervals(t.beats(s, d))).select("track_id", "idx", "smoothed_bpm")


def _curve(s, d):
    return sequence.tempo_curve(sequence.intervals(t.beats(s, d)))


@query("tempo_curve", plain("x", "!track_id, !idx, time_s, bpm, confidence", "curve"))
def _(s, d):
    return _curve(s, d)


@query("global_bpm", sql("SELECT track_id, round(median(bpm), 6) AS global_bpm FROM curve GROUP BY track_id", "curve"))
def _(s, d):
    return sequence.global_bpm(_curve(s, d))


@query("tempo_hypotheses", sql("SELECT track_id, round(g * f, 6) AS bpm, sc AS relative_score, lv AS metrical_level FROM (SELECT track_id, median(bpm) AS g FROM curve GROUP BY 1) CROSS JOIN (VALUES (0.5::DOUBLE, 0.5::DOUBLE, -1::BIGINT), (1, 1, 0), (2, 0.5, 1)) x(f, sc, lv) WHERE g * f BETWEEN 40 AND 320", "curve"))
def _(s, d):
    return sequence.tempo_hypotheses(sequence.global_bpm(_curve(s, d)))


@query("tempo_jumps", sql("SELECT track_id, round(time_s, 6) AS time_s, round(b, 6) AS before_bpm, round(a, 6) AS after_bpm, round(least(greatest((abs(ln(a / b)) - 0.11332868530700317::DOUBLE) / 0.25, 0), 1), 6) AS score FROM (SELECT track_id, time_s, (lag(bpm, 2) OVER w + lag(bpm) OVER w) / 2 AS b, (bpm + lead(bpm) OVER w) / 2 AS a, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY track_id) AS n FROM curve WINDOW w AS (PARTITION BY track_id ORDER BY idx)) WHERE n >= 5 AND k >= 2 AND k < n - 2 AND abs(ln(a / b)) >= 0.11332868530700317::DOUBLE", "curve"))
def _(s, d):
    return sequence.tempo_jumps(_curve(s, d))


@query("long_gaps", sql("SELECT track_id, round(time_s + dt / 2, 6) AS time_s, round(least(greatest(1 - m / dt, 0), 1), 6) AS score FROM gaps JOIN (SELECT track_id, median(dt) AS m FROM gaps GROUP BY 1) USING (track_id) WHERE dt > 1 AND dt > 3.5 * m", "gaps"))
def _(s, d):
    return sequence.long_gaps(sequence.intervals(t.beats(s, d)))


def _regions(s, d):
    return sequence.silence_regions(t.activity(s, d), t.tracks(t.beats(s, d)), QUIET)


@query("silence_regions", plain("x", "!track_id, start_s, end_s, depth_db", "regions"))
def _(s, d):
    return _regions(s, d)


@query("silence_changes", sql("SELECT track_id, round((start_s + end_s) / 2, 6) AS time_s, round(least(greatest((-depth_db - 20) / 60, 0), 1), 6) AS score FROM regions", "regions"))
def _(s, d):
    return _regions(s, d).select("track_id", ((F.col("start_s") + F.col("end_s")) / 2).alias("time_s"), sequence.clamp((-F.col("depth_db") - 20) / 60).alias("score"))


@query("silence_anti_join", sql("SELECT track_id, idx, round(time_s, 6) AS time_s FROM beats b WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.track_id = b.track_id AND b.time_s BETWEEN r.start_s AND r.end_s)", "regions"))
def _(s, d):
    return sequence.outside_silence(t.beats(s, d), _regions(s, d)).select("track_id", "idx", "time_s")


def _near(s, d):
    return sequence.nearest_activity(t.beats(s, d), t.activity(s, d))


@query("nearest_activity", plain("x", "!track_id, !idx, near_db", "near"))
def _(s, d):
    return _near(s, d).select("track_id", "idx", "near_db")


_SAL = "least(greatest(confidence, 0.0::DOUBLE), 1.0::DOUBLE) * pow(10, near_db / 20)"


@query("phase_salience", sql(f"SELECT track_id, idx % 2 AS phase, round(avg({_SAL}), 6) AS salience, count(*) AS n_beats FROM near GROUP BY ALL", "near"))
def _(s, d):
    return sequence.phase_salience(_near(s, d))


@query("event_evidence", sql(f"SELECT track_id, round(avg({_SAL} + 0.25 * downbeat_confidence), 6) AS evidence FROM near GROUP BY 1", "near"))
def _(s, d):
    return sequence.event_evidence(_near(s, d))


@query("metrical_level", sql(f"SELECT track_id, round(m, 6) AS raw_median, round(even, 6) AS even, round(odd, 6) AS odd, CASE WHEN even >= odd THEN 0 ELSE 1 END::BIGINT AS phase, m >= 150 AND m / 2 BETWEEN 70 AND 180 AND n >= 8 AND greatest(even, odd) / greatest(least(even, odd), 1e-9) >= 1.35 AS fold FROM (SELECT track_id, avg({_SAL}) FILTER (idx % 2 = 0) AS even, avg({_SAL}) FILTER (idx % 2 = 1) AS odd, count(*) AS n FROM near GROUP BY 1) JOIN (SELECT track_id, median(raw_bpm) AS m FROM gaps GROUP BY 1) USING (track_id)", "near", "gaps"))
def _(s, d):
    return sequence.metrical_level(_near(s, d), sequence.intervals(t.beats(s, d)))


@query("transfer_downbeats", sql("SELECT track_id, idx, round(max(v), 6) AS downbeat_confidence FROM (SELECT track_id, idx, downbeat_confidence AS v FROM beats WHERE idx % 2 = 0 UNION ALL SELECT track_id, CASE WHEN nxt IS NULL OR time_s - prv <= nxt - time_s THEN idx - 1 ELSE idx + 1 END, 0.9::DOUBLE * downbeat_confidence FROM (SELECT *, lag(time_s) OVER w AS prv, lead(time_s) OVER w AS nxt FROM beats WINDOW w AS (PARTITION BY track_id ORDER BY time_s)) WHERE idx % 2 = 1 AND downbeat_confidence >= 0.5) GROUP BY ALL", "beats"))
def _(s, d):
    return sequence.transfer_downbeats(t.beats(s, d)).where("own_confidence IS NOT NULL").drop("own_confidence")


@query("downbeat_runs", sql("SELECT track_id, run::BIGINT AS run, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_downbeats FROM (SELECT track_id, idx, sum(CASE WHEN g <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY idx) AS run FROM (SELECT track_id, idx, idx - lag(idx) OVER (PARTITION BY track_id ORDER BY idx) AS g FROM beats WHERE downbeat_confidence >= 0.5)) GROUP BY ALL", "beats"))
def _(s, d):
    return sequence.downbeat_runs(t.beats(s, d))


@query("downbeat_spacing", sql("SELECT track_id, count(g) + 1 AS n_downbeats, round(median(g), 6) AS spacing FROM (SELECT track_id, idx - lag(idx) OVER (PARTITION BY track_id ORDER BY idx) AS g FROM beats WHERE downbeat_confidence >= 0.5) GROUP BY 1", "beats"))
def _(s, d):
    return sequence.downbeat_spacing(t.beats(s, d))


@query("validate_observations", sql("SELECT track_id, idx, round(time_s, 6) AS time_s, code FROM (SELECT *, CASE WHEN time_s < 0 OR time_s > lim THEN 'out_of_range' WHEN time_s <= lag(time_s) OVER (PARTITION BY track_id ORDER BY idx) THEN 'unsorted' END AS code FROM (SELECT b.track_id, idx, CASE WHEN idx % 17 = 16 THEN time_s - 1.5 ELSE time_s END AS time_s, duration_s - 3 AS lim FROM beats b JOIN tracks USING (track_id))) WHERE code IS NOT NULL", "tracks"))
def _(s, d):
    b = t.beats(s, d)
    moved = b.withColumn("time_s", F.when(F.col("idx") % 17 == 16, F.col("time_s") - 1.5).otherwise(F.col("time_s")))
    return sequence.violations(moved, t.tracks(b).withColumn("duration_s", F.col("duration_s") - 3))


@query("observation_diagnostics", sql("SELECT track_id, n_beats, n_downbeats, round(min_db, 6) AS min_db, round(low_fraction, 6) AS low_fraction, round(ec + 1e-9, 6) AS even_confidence, round(oc + 1e-9, 6) AS odd_confidence, round(m, 6) AS raw_median_bpm FROM (SELECT track_id, count(*) AS n_beats, count(*) FILTER (downbeat_confidence >= 0.5) AS n_downbeats, min(near_db) AS min_db, count(*) FILTER (near_db <= -20) / count(*) AS low_fraction, avg(confidence) FILTER (idx % 2 = 0) AS ec, avg(confidence) FILTER (idx % 2 = 1) AS oc FROM near GROUP BY 1) JOIN (SELECT track_id, median(raw_bpm) AS m FROM gaps GROUP BY 1) USING (track_id)", "near", "gaps"))
def _(s, d):
    # Confidences have few decimals, so their means may lie on a rounding boundary; a billionth moves them off.
    x = sequence.diagnostics(t.beats(s, d), _near(s, d), sequence.intervals(t.beats(s, d)), -20.0)
    return x.withColumn("even_confidence", F.col("even_confidence") + 1e-9).withColumn("odd_confidence", F.col("odd_confidence") + 1e-9)


@query("curve_quantiles", sql("SELECT track_id, round(list_sort(list(bpm))[ceil((count(*) - 1) * 0.95::DOUBLE)::INT + 1], 6) AS p95, round(list_sort(list(bpm))[ceil((count(*) - 1) * 0.5::DOUBLE)::INT + 1], 6) AS p50 FROM curve GROUP BY 1", "curve"))
def _(s, d):
    return _curve(s, d).groupBy("track_id").agg(F.collect_list("bpm").alias("v")).select("track_id", scoring.nearest_rank(F.col("v"), 0.95).alias("p95"), scoring.nearest_rank(F.col("v"), 0.5).alias("p50"))


@query("grid_fit", sql("SELECT track_id, n, round(p, 6) AS period, round(o, 6) AS origin, round(e, 6) AS max_error FROM (SELECT track_id, count(*) AS n, any_value(p) AS p, any_value(o) AS o, max(abs(time_s - (o + idx * p))) AS e FROM beats JOIN (SELECT track_id, regr_slope(time_s, idx) AS p, regr_intercept(time_s, idx) AS o FROM beats GROUP BY 1) USING (track_id) GROUP BY 1) WHERE n >= 6 AND p > 0", "beats"))
def _(s, d):
    b = t.beats(s, d)
    w = Window.partitionBy("track_id")
    mi, mt = F.avg("idx").over(w), F.avg("time_s").over(w)
    c = b.select("track_id", "idx", "time_s", mi.alias("mi"), mt.alias("mt"))
    g = c.groupBy("track_id").agg((F.sum((F.col("idx") - F.col("mi")) * (F.col("time_s") - F.col("mt"))) / F.sum((F.col("idx") - F.col("mi")) ** 2)).alias("period"), F.first("mi").alias("mi"), F.first("mt").alias("mt"), F.count("*").alias("n"))
    g = g.select("track_id", "n", "period", (F.col("mt") - F.col("period") * F.col("mi")).alias("origin"))
    e = b.join(g, "track_id").groupBy("track_id").agg(F.max(F.abs(F.col("time_s") - (F.col("origin") + F.col("idx") * F.col("period")))).alias("max_error"))
    return g.join(e, "track_id").where("n >= 6 AND period > 0")


@query("missed_events", sql("SELECT track_id, idx, round(dt / m, 6) AS multiple FROM gaps JOIN (SELECT track_id, median(dt) AS m FROM gaps GROUP BY 1) USING (track_id) WHERE NOT abs(dt / m - 1) <= 0.2 AND dt / m BETWEEN 1.6 AND 3.25 AND abs(dt / m - round(dt / m)) <= 0.15", "gaps"))
def _(s, d):
    g = sequence.intervals(t.beats(s, d))
    m = F.col("dt") / F.col("m")
    return g.join(g.groupBy("track_id").agg(F.median("dt").alias("m")), "track_id").where(~(F.abs(m - 1) <= 0.2) & m.between(1.6, 3.25) & (F.abs(m - F.round(m)) <= 0.15)).select("track_id", "idx", m.alias("multiple"))


_JUMPS = "SELECT track_id, time_s, 'tempo_jump' AS kind, least(greatest((abs(ln(a / b)) - 0.11332868530700317::DOUBLE) / 0.25, 0), 1) AS score FROM (SELECT track_id, time_s, (lag(bpm, 2) OVER w + lag(bpm) OVER w) / 2 AS b, (bpm + lead(bpm) OVER w) / 2 AS a, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY track_id) AS n FROM curve WINDOW w AS (PARTITION BY track_id ORDER BY idx)) WHERE n >= 5 AND k >= 2 AND k < n - 2 AND abs(ln(a / b)) >= 0.11332868530700317::DOUBLE"
_KEPT = f"""WITH RECURSIVE l AS (SELECT track_id, list({{'t': time_s, 's': score}} ORDER BY time_s, score) AS c FROM ({_JUMPS}) GROUP BY 1), s AS (SELECT track_id, c, 1 AS i, c[1] AS last, NULL::STRUCT(t DOUBLE, s DOUBLE) AS emit FROM l
    UNION ALL SELECT track_id, c, i + 1, CASE WHEN i < len(c) AND c[i+1].t - last.t < 0.75 THEN CASE WHEN c[i+1].s > last.s THEN c[i+1] ELSE last END ELSE c[i+1] END, CASE WHEN i >= len(c) OR c[i+1].t - last.t >= 0.75 THEN last END FROM s WHERE i <= len(c))
    SELECT track_id, emit.t AS time_s, emit.s AS score FROM s WHERE emit IS NOT NULL"""
_BOUNDS = f"""WITH RECURSIVE l AS (SELECT track_id, list_sort(list_concat([0.0::DOUBLE, any_value(duration_s)], coalesce(list(time_s) FILTER (time_s IS NOT NULL), []))) AS t FROM tracks LEFT JOIN ({_KEPT}) USING (track_id) GROUP BY track_id),
    s AS (SELECT track_id, t, 1 AS i, t[1] AS last, true AS hit, 0 AS ord FROM l UNION ALL SELECT track_id, t, i + 1, CASE WHEN abs(t[i+1] - last) >= 0.5 THEN t[i+1] ELSE last END, abs(t[i+1] - last) >= 0.5, ord + CASE WHEN abs(t[i+1] - last) >= 0.5 THEN 1 ELSE 0 END FROM s WHERE i < len(t))
    SELECT track_id, ord, last AS time_s FROM s WHERE hit"""


def _kept(s, d):
    jumps = sequence.tempo_jumps(_curve(s, d)).select("track_id", "time_s", F.lit("tempo_jump").alias("kind"), "score")
    return sequence.dedupe_changes(jumps)


@query("change_dedup", sql(f"SELECT track_id, round(time_s, 6) AS time_s, round(score, 6) AS score FROM ({_KEPT})", "curve"))
def _(s, d):
    return _kept(s, d).drop("kind")


@query("section_boundaries", sql(f"SELECT track_id, ord::BIGINT AS ord, round(time_s, 6) AS time_s FROM ({_BOUNDS})", "curve", "tracks"))
def _(s, d):
    return sequence.section_boundaries(_kept(s, d), t.tracks(t.beats(s, d)))


@query("rhythm_sections", sql(f"SELECT track_id, round(a, 6) AS start_s, round(b, 6) AS end_s, round(m, 6) AS bpm, CASE WHEN m IS NULL THEN 0.0 ELSE round(least(greatest(1 - 8 * (SELECT avg(abs(log2(c.bpm / m))) FROM curve c WHERE c.track_id = x.track_id AND c.time_s >= a AND c.time_s < b), 0), 1), 6) END AS stability, (SELECT count(*) FROM beats e WHERE e.track_id = x.track_id AND e.time_s >= a AND e.time_s < b) AS beat_count FROM (SELECT *, (SELECT median(c.bpm) FROM curve c WHERE c.track_id = y.track_id AND c.time_s >= a AND c.time_s < b) AS m FROM (SELECT track_id, time_s AS a, lead(time_s) OVER (PARTITION BY track_id ORDER BY ord) AS b FROM ({_BOUNDS})) y WHERE b IS NOT NULL) x", "curve", "tracks"))
def _(s, d):
    b = t.beats(s, d)
    return sequence.rhythm_sections(sequence.section_boundaries(_kept(s, d), t.tracks(b)), _curve(s, d), b)


# --- Truth from recipes, and scoring --------------------------------------------------------------


def _truth(s, d):
    return truth.truth_beats(t.recipes(s, d))


def _pred(s, d):
    return t.predictions(_truth(s, d))


@query("truth_beats", plain("x", "!recipe_id, !beat_index, time_s, !downbeat", "truth_beats"))
def _(s, d):
    return _truth(s, d)


@query("truth_segments", plain("x", "!recipe_id, !seg, start_s, end_s, !kind, start_bpm, end_bpm", "segments"))
def _(s, d):
    return truth.truth_segments(t.recipes(s, d))


@query("truth_changes", sql(f"SELECT recipe_id, round(time_s, 6) AS time_s, kind FROM ({_CHANGES})", "timeline"))
def _(s, d):
    return truth.truth_changes(t.recipes(s, d))


@query("ideal_observations", sql("SELECT recipe_id, round(time_s, 6) AS time_s, 1.0::DOUBLE AS confidence, CASE WHEN downbeat THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS downbeat_confidence FROM truth_beats", "truth_beats"))
def _(s, d):
    return truth.ideal_observations(_truth(s, d))


def _scored(s, d):
    p = _pred(s, d)
    w = Window.partitionBy("recipe_id").orderBy("time_s")
    dt = F.lead("time_s").over(w) - F.col("time_s")
    g = p.select("recipe_id", "idx", "time_s", dt.alias("dt")).where("dt IS NOT NULL").select("recipe_id", "idx", (F.col("time_s") + F.col("dt") / 2).alias("time_s"), (60.0 / F.col("dt")).alias("bpm"))
    return truth.tempo_at(g, truth.truth_segments(t.recipes(s, d)))


@query("tempo_at", plain("x", "!recipe_id, !idx, time_s, bpm, truth_bpm", "scored"))
def _(s, d):
    return _scored(s, d)


@query("tempo_metrics", sql("SELECT recipe_id, len(e)::BIGINT AS n_points, round(e[ceil((len(e) - 1) * 0.5::DOUBLE)::INT + 1], 6) AS median_error_percent, round(e[ceil((len(e) - 1) * 0.95::DOUBLE)::INT + 1], 6) AS p95_error_percent FROM (SELECT recipe_id, list_sort(list(abs(bpm - truth_bpm) / truth_bpm * 100)) AS e FROM scored WHERE truth_bpm IS NOT NULL GROUP BY 1)", "scored"))
def _(s, d):
    return scoring.tempo_metrics(_scored(s, d))


@query("validate_recipes", sql("SELECT recipe_id, round(max(duration_s), 6) AS longest_s, CASE WHEN max(duration_s) > 14 THEN 'bad_duration' ELSE 'bpm_out_of_range' END AS code FROM (SELECT recipe_id, kind, duration_s * 1.2::DOUBLE AS duration_s, start_bpm * 7 AS a, end_bpm * 7 AS b FROM recipes) GROUP BY 1 HAVING max(duration_s) > 14 OR max(greatest(a, b)) FILTER (kind <> 'silence') > 1000", "recipes"))
def _(s, d):
    r = t.recipes(s, d).select("recipe_id", "kind", (F.col("duration_s") * 1.2).alias("duration_s"), (F.col("start_bpm") * 7).alias("start_bpm"), (F.col("end_bpm") * 7).alias("end_bpm"))
    return truth.recipe_violations(r, max_duration_s=14.0)


@query("validate_segments", sql("SELECT recipe_id, seg, round(n, 6) AS next_start FROM (SELECT *, lead(start_s) OVER (PARTITION BY recipe_id ORDER BY start_s) AS n FROM (SELECT recipe_id, seg, start_s, CASE WHEN seg = 1 THEN end_s + 0.5 ELSE end_s END AS end_s FROM segments)) WHERE n < end_s", "segments"))
def _(s, d):
    seg = truth.truth_segments(t.recipes(s, d)).withColumn("end_s", F.when(F.col("seg") == 1, F.col("end_s") + 0.5).otherwise(F.col("end_s")))
    return truth.segment_overlaps(seg).select("recipe_id", "seg", "next_start")


def _matches(s, d):
    return scoring.match_events(_pred(s, d), _truth(s, d), 0.07)


@query("match_events", sql("SELECT recipe_id, i::BIGINT AS i, j::BIGINT AS j FROM matches", "matches"))
def _(s, d):
    return _matches(s, d).select("recipe_id", F.explode("pairs").alias("p")).select("recipe_id", "p.i", "p.j")


@query("missing_events", sql("SELECT recipe_id, jj AS j, round(time_s, 6) AS time_s FROM (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY time_s) - 1 AS jj FROM truth_beats) e WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.recipe_id = e.recipe_id AND m.j = e.jj)", "matches"))
def _(s, d):
    return scoring.missed_events(_matches(s, d))


@query("beat_metrics", plain("x", "!recipe_id, !n_predicted, !n_expected, !matched, precision, recall, f1, median_error_ms, p95_error_ms", "metrics"))
def _(s, d):
    return scoring.beat_metrics(_matches(s, d))


@query("suite_rollup", sql("SELECT bool_and(f1 >= 0.5) AS passed, count(*) AS n_cases, count(*) FILTER (f1 < 0.805::DOUBLE) AS n_low, round(avg(f1), 6) AS mean_f1 FROM metrics", "metrics"))
def _(s, d):
    m = scoring.beat_metrics(_matches(s, d))
    return m.agg(F.bool_and(F.col("f1") >= 0.5).alias("passed"), F.count("*").alias("n_cases"), F.count_if(F.col("f1") < 0.805).alias("n_low"), F.avg("f1").alias("mean_f1"))


_PAIRED = """WITH RECURSIVE e AS (SELECT recipe_id, kind, time_s, row_number() OVER (PARTITION BY recipe_id ORDER BY time_s, kind) AS j FROM changes), p AS (SELECT recipe_id, kind, time_s, row_number() OVER (PARTITION BY recipe_id ORDER BY time_s, kind) AS i FROM (SELECT recipe_id, kind, time_s + recipe_id % 3 * 0.6::DOUBLE AS time_s FROM changes)),
    l AS (SELECT recipe_id, list({'d': abs(p.time_s - e.time_s), 'i': i, 'j': j} ORDER BY abs(p.time_s - e.time_s), i, j) AS c FROM p JOIN e USING (recipe_id, kind) WHERE abs(p.time_s - e.time_s) <= 1.0::DOUBLE GROUP BY 1),
    s AS (SELECT recipe_id, c, 1 AS k, []::BIGINT[] AS pi, []::BIGINT[] AS ej, []::DOUBLE[] AS d FROM l UNION ALL SELECT recipe_id, c, k + 1, CASE WHEN used THEN pi ELSE list_append(pi, x.i) END, CASE WHEN used THEN ej ELSE list_append(ej, x.j) END, CASE WHEN used THEN d ELSE list_append(d, x.d) END
        FROM (SELECT *, c[k] AS x, list_contains(pi, c[k].i) OR list_contains(ej, c[k].j) AS used FROM s WHERE k <= len(c)))
    SELECT recipe_id, coalesce(len(d), 0)::BIGINT AS matched, n, list_sort(d) AS d FROM (SELECT recipe_id, count(*) AS n FROM changes GROUP BY 1) LEFT JOIN (SELECT recipe_id, d FROM s WHERE k > len(c)) USING (recipe_id)"""


# One-to-one matches of downbeats alone, as those of beats.
_DOWN = _CTE["matches"].replace("FROM pred GROUP", "FROM pred WHERE downbeat GROUP").replace("FROM truth_beats GROUP", "FROM truth_beats WHERE downbeat GROUP")
_DOWN = _DOWN[_DOWN.index("(WITH") : _DOWN.index(" m JOIN pred p")]
_V = f"""SELECT recipe_id, CASE WHEN down < 0.9::DOUBLE THEN 1 ELSE 0 END + CASE WHEN change_recall < 0.9::DOUBLE THEN 1 ELSE 0 END + CASE WHEN f1 < 0.88::DOUBLE THEN 1 ELSE 0 END + CASE WHEN med IS NULL OR med > 9 THEN 1 ELSE 0 END + CASE WHEN p95 IS NULL OR p95 > 30 THEN 1 ELSE 0 END AS n_failures, f1, down, change_recall FROM metrics
    JOIN (SELECT recipe_id, CASE WHEN n = 0 THEN 0 ELSE 2.0::DOUBLE * n / (a + b) END AS down FROM (SELECT recipe_id, count(*) FILTER (downbeat) AS a FROM pred GROUP BY 1) JOIN (SELECT recipe_id, count(*) FILTER (downbeat) AS b FROM truth_beats GROUP BY 1) USING (recipe_id) JOIN (SELECT recipe_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT recipe_id FROM pred) LEFT JOIN (SELECT recipe_id, count(*) AS n FROM {_DOWN} GROUP BY 1) USING (recipe_id)) USING (recipe_id)) USING (recipe_id)
    LEFT JOIN (SELECT recipe_id, matched / n AS change_recall FROM ({_PAIRED})) USING (recipe_id) LEFT JOIN (SELECT recipe_id, e[ceil((len(e) - 1) * 0.5::DOUBLE)::INT + 1] AS med, e[ceil((len(e) - 1) * 0.95::DOUBLE)::INT + 1] AS p95
    FROM (SELECT recipe_id, list_sort(list(abs(bpm - truth_bpm) / truth_bpm * 100)) AS e FROM scored WHERE truth_bpm IS NOT NULL GROUP BY 1)) USING (recipe_id)"""


def _change_metrics(s, d):
    e = truth.truth_changes(t.recipes(s, d))
    return scoring.change_metrics(e.withColumn("time_s", F.col("time_s") + F.col("recipe_id") % 3 * 0.6), e, 1.0)


def _verdicts(s, d):
    m = scoring.beat_metrics(_matches(s, d)).select("recipe_id", "f1").join(scoring.tempo_metrics(_scored(s, d)), "recipe_id", "left")
    down = scoring.beat_metrics(scoring.match_events(_pred(s, d).where("downbeat"), _truth(s, d).where("downbeat"), 0.07))
    m = m.join(down.select("recipe_id", F.col("f1").alias("downbeat_f1")), "recipe_id", "left").join(_change_metrics(s, d).select("recipe_id", F.col("recall").alias("change_recall")), "recipe_id", "left")
    gates = {"min_beat_f1": 0.88, "min_downbeat_f1": 0.9, "max_median": 9.0, "max_p95": 30.0, "min_change_recall": 0.9}
    return scoring.verdicts(m.withColumns({k: F.lit(v) for k, v in gates.items()}))


@query("case_verdicts", sql(f"SELECT recipe_id, n_failures::BIGINT AS n_failures, n_failures = 0 AS passed FROM ({_V})", "metrics", "scored", "changes"))
def _(s, d):
    return _verdicts(s, d).select("recipe_id", F.size("failures").alias("n_failures"), "passed")


@query("attribution", sql(f"SELECT CASE WHEN recipe_id % 5 = 0 THEN 'estimator' WHEN recipe_id % 5 = 1 THEN 'unpaired' WHEN n_failures > 0 THEN 'observations' ELSE 'none' END AS attribution, count(*) AS n_cases FROM ({_V}) GROUP BY 1", "metrics", "scored", "changes"))
def _(s, d):
    oracle = F.when(F.col("recipe_id") % 5 == 0, False).when(F.col("recipe_id") % 5 == 1, F.lit(None).cast("boolean")).otherwise(True)
    return scoring.attribution(_verdicts(s, d).withColumn("oracle_passed", oracle)).groupBy("attribution").agg(F.count("*").alias("n_cases"))


@query("effective_thresholds", sql("SELECT DISTINCT recipe_id, CASE WHEN recipe_id % 3 = 0 THEN 0.7::DOUBLE ELSE 0.99::DOUBLE END AS min_beat_f1, CASE WHEN recipe_id % 3 = 0 THEN NULL ELSE 5.0::DOUBLE END AS max_median FROM recipes", "recipes"))
def _(s, d):
    own = F.when(F.col("recipe_id") % 3 == 0, F.struct(F.lit(0.7).alias("min_beat_f1"), F.lit(None).cast("double").alias("max_median")))
    cases = t.recipes(s, d).select("recipe_id").distinct().withColumn("thresholds", own)
    suite = s.range(1).select(F.struct(F.lit(0.99).alias("min_beat_f1"), F.lit(5.0).cast("double").alias("max_median")).alias("default_thresholds"))
    return scoring.effective_thresholds(cases, suite).select("recipe_id", "thresholds.min_beat_f1", "thresholds.max_median")


@query("metric_delta", sql(f"SELECT recipe_id, round(f1 - 1, 6) AS delta_f1, round(down - 1, 6) AS delta_downbeat_f1, round(change_recall - 1, 6) AS delta_change_recall FROM ({_V})", "metrics", "scored", "changes"))
def _(s, d):
    """The predictions' metrics less those of truth against itself, which has every metric but the tempo errors; null where one side lacks it."""
    found = _verdicts(s, d).select("recipe_id", "f1", "downbeat_f1", "median_error_percent", "p95_error_percent", "change_recall")
    none = F.lit(None).cast("double")
    ideal = scoring.beat_metrics(scoring.match_events(_truth(s, d), _truth(s, d), 0.07)).select("recipe_id", "f1", F.lit(1.0).alias("downbeat_f1"), none.alias("median_error_percent"), none.alias("p95_error_percent"), F.lit(1.0).alias("change_recall"))
    return scoring.metric_delta(ideal, found, "recipe_id").select("recipe_id", "delta_f1", "delta_downbeat_f1", "delta_change_recall")


@query("change_metrics", sql(f"SELECT recipe_id, matched, round(matched / n, 6) AS precision, round(matched / n, 6) AS recall, round(d[ceil((matched - 1) * 0.5::DOUBLE)::INT + 1], 6) AS median_offset_s FROM ({_PAIRED})", "changes"))
def _(s, d):
    return _change_metrics(s, d)


# --- Frames -----------------------------------------------------------------------------------------


@query("downmix", sql("SELECT track_id, frame // 2 AS frame, round(((min_by(logit, frame)::FLOAT + max_by(logit, frame)::FLOAT)::FLOAT / 2::FLOAT)::DOUBLE, 6) AS value FROM frames GROUP BY track_id, frame // 2", "frames"))
def _(s, d):
    return signal.downmix(t.frames(s, d), 2)


@query("rms_activity", sql("SELECT track_id, frame, round(frame / 20.0::DOUBLE, 6) AS time_s, round(rms, 6) AS rms, round(least(greatest(20 * log10(greatest(rms / max(rms) OVER (PARTITION BY track_id), 1e-6::DOUBLE)), -120), 0), 6) AS relative_db FROM (SELECT track_id, frame, sqrt(avg(logit * logit) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS rms FROM frames)", "frames"))
def _(s, d):
    return signal.rms_activity(t.frames(s, d), 20)


@query("local_peaks", plain("x", "!track_id, !frame, logit", "peaks"))
def _(s, d):
    return signal.local_peaks(t.frames(s, d))


@query("peak_dedup", sql("""SELECT track_id, round(u, 6) AS frame FROM (WITH RECURSIVE pk AS (SELECT track_id, list(frame::DOUBLE ORDER BY frame) AS f FROM (SELECT *, max(logit) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM rounded) WHERE logit >= top AND logit > 0 GROUP BY 1),
    s AS (SELECT track_id, f, 1 AS i, f[1] AS m, 1 AS n, NULL::DOUBLE AS emit FROM pk UNION ALL SELECT track_id, f, i + 1, CASE WHEN i < len(f) AND f[i+1] - m <= 1 THEN m + (f[i+1] - m) / (n + 1) ELSE f[i+1] END, CASE WHEN i < len(f) AND f[i+1] - m <= 1 THEN n + 1 ELSE 1 END, CASE WHEN i >= len(f) OR f[i+1] - m > 1 THEN m END FROM s WHERE i <= len(f))
    SELECT track_id, emit AS u FROM s WHERE emit IS NOT NULL)""", "rounded"))
def _(s, d):
    return signal.dedupe_peaks(signal.local_peaks(t.frames(s, d, rounded=True)))


def _downbeat_times(s, d):
    return t.frames(s, d).where("frame % 9 = 4").select("track_id", (F.col("frame") / 50.0).alias("time_s"))


@query("decode_observations", sql("SELECT track_id, round(time_s, 6) AS time_s, round(1 / (1 + exp(-logit)), 6) AS confidence, EXISTS (SELECT 1 FROM frames g WHERE g.track_id = p.track_id AND g.frame % 9 = 4 AND abs(g.frame / 50.0::DOUBLE - p.time_s) <= 0.07::DOUBLE) AS downbeat FROM (SELECT track_id, time_s, logit FROM ptimes JOIN (SELECT track_id, frame, logit FROM frames) USING (track_id, frame)) p", "ptimes"))
def _(s, d):
    f = t.frames(s, d)
    return signal.decode(signal.local_peaks(f), f, _downbeat_times(s, d))


@query("snap_downbeats", sql("SELECT DISTINCT track_id, round(time_s, 6) AS time_s FROM (SELECT q.track_id, p.time_s, row_number() OVER (PARTITION BY q.track_id, q.frame ORDER BY abs(p.time_s - q.frame / 50.0::DOUBLE), p.time_s) AS k FROM frames q JOIN ptimes p ON p.track_id = q.track_id WHERE q.frame % 9 = 4) WHERE k = 1", "ptimes"))
def _(s, d):
    beats = signal.local_peaks(t.frames(s, d)).select("track_id", signal.frame_time(F.col("frame")).alias("time_s"))
    return signal.snap_downbeats(_downbeat_times(s, d), beats)


@query("midpoint_recovery", sql("SELECT track_id, round(frame, 6) AS frame FROM midpoints", "midpoints"))
def _(s, d):
    f = t.frames(s, d)
    return signal.recover_midpoints(signal.dedupe_peaks(signal.local_peaks(f)), signal.dedupe_peaks(signal.local_peaks(f, 3, -3.0)))


def _cases(s, d):
    """Every seventh frame is a truth event; each policy's decoded beats match events one to one within the case's 70 ms."""
    f = t.frames(s, d)
    m = decoding.policy_scores(f, f.where("frame % 7 = 3").select("track_id", (F.col("frame") / 50.0).alias("time_s")))
    c = m.join(t.table(s, d, "embeddings").select(F.col("vec_id").alias("track_id"), "label"), "track_id")
    return c.withColumn("passed", F.col("f1") >= 0.1).withColumn("tags", F.array(F.concat(F.lit("label-"), F.col("label").cast("string")), F.lit("all")))


@query("decoder_cases", plain("x", "!policy, !track_id, !n_predicted::BIGINT AS n_predicted, !matched::BIGINT AS matched, precision, recall, f1", "cases"))
def _(s, d):
    return _cases(s, d).select("policy", "track_id", "n_predicted", "matched", "precision", "recall", "f1")


@query("decoder_sweep", sql("SELECT policy, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1, round(avg(n_predicted), 6) AS mean_events, bool_and(f1 >= 0.1) AS passed, count(*) AS n_cases FROM cases GROUP BY 1", "cases"))
def _(s, d):
    return scoring.candidate_means(_cases(s, d))


@query("tag_slices", sql("SELECT policy, tag, round(avg(f1), 6) AS mean_f1, round(avg(recall), 6) AS mean_recall, count(*) AS n_cases FROM (SELECT *, unnest(['label-' || label, 'all']) AS tag FROM cases) GROUP BY ALL", "cases"))
def _(s, d):
    return scoring.slice_means(_cases(s, d))


@query("policy_oracle", sql("SELECT round(avg(b), 6) AS oracle_mean_f1, count(*) AS n_cases FROM (SELECT track_id, max(f1) AS b FROM cases GROUP BY 1)", "cases"))
def _(s, d):
    return scoring.policy_oracle(_cases(s, d))


@query("policy_comparison", sql("SELECT track_id, round(a.f1, 6) AS baseline_f1, round(b.f1, 6) AS candidate_f1, round(b.f1 - a.f1, 6) AS delta_f1, CASE WHEN b.f1 > a.f1 THEN 'improved' WHEN b.f1 < a.f1 THEN 'regressed' ELSE 'unchanged' END AS outcome FROM (SELECT * FROM cases WHERE policy = 'radius3-logit-0') a JOIN (SELECT * FROM cases WHERE policy = 'radius1-logit-minus-1') b USING (track_id)", "cases"))
def _(s, d):
    c = _cases(s, d)
    return scoring.compare(c.where("policy = 'radius3-logit-0'"), c.where("policy = 'radius1-logit-minus-1'"))


_EV = """SELECT f.track_id, e.ef AS event_frame, max_by(f.frame, f.logit * 1e6 + f.frame * 1e-6) AS strongest_frame, max(f.logit) AS strongest, max(CASE WHEN f.logit >= f.t3 THEN f.logit END) AS p3, max(CASE WHEN f.logit >= f.t1 THEN f.logit END) AS p1 FROM (SELECT *, max(logit) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS t3,
    max(logit) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t1 FROM frames) f JOIN (SELECT track_id, frame AS ef FROM frames WHERE frame % 7 = 3) e ON e.track_id = f.track_id AND f.frame BETWEEN e.ef - 2 AND e.ef + 2 GROUP BY ALL"""
_CLASS = "CASE WHEN p3 > 0 THEN 'radius3_peak_above_0' WHEN p3 > -1 THEN 'radius3_peak_above_minus1' WHEN p3 IS NOT NULL THEN 'radius3_peak_below_minus1' WHEN p1 IS NOT NULL THEN 'radius1_only_peak' ELSE 'no_local_peak' END"


def _evidence(s, d):
    f = t.frames(s, d)
    w = Window.partitionBy("track_id").orderBy("frame")
    f = f.withColumn("t3", F.max("logit").over(w.rowsBetween(-3, 3))).withColumn("t1", F.max("logit").over(w.rowsBetween(-1, 1)))
    item = F.struct("logit", "frame")
    near = w.rowsBetween(-2, 2)
    f = f.withColumn("top", F.max(item).over(near)).withColumn("p3", F.max(F.when(F.col("logit") >= F.col("t3"), F.col("logit"))).over(near)).withColumn("p1", F.max(F.when(F.col("logit") >= F.col("t1"), F.col("logit"))).over(near))
    e = f.where("frame % 7 = 3")
    return e.select("track_id", F.col("frame").alias("event_frame"), F.col("top.frame").alias("strongest_frame"), F.col("top.logit").alias("strongest"), signal.classify_evidence(F.col("top.logit"), F.col("p3"), F.col("p1")).alias("evidence"))


@query("missing_evidence", sql(f"SELECT track_id, event_frame, round(strongest, 6) AS strongest, {_CLASS} AS evidence FROM ({_EV})", "frames"))
def _(s, d):
    return _evidence(s, d).drop("strongest_frame")


@query("evidence_histogram", sql(f"SELECT evidence, count(*) AS n FROM (SELECT {_CLASS} AS evidence FROM ({_EV})) GROUP BY 1", "frames"))
def _(s, d):
    return _evidence(s, d).groupBy("evidence").agg(F.count("*").alias("n"))


@query("decoder_policies", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{p}', {r}::BIGINT, {th}::DOUBLE, {str(m).lower()})" for i, (p, r, th, m) in enumerate(DECODER_POLICIES)) + ") x(ord, policy, radius, threshold, midpoints)")
def _(s, d):
    return s.createDataFrame([(i, *p) for i, p in enumerate(DECODER_POLICIES)], "ord long, policy string, radius long, threshold double, midpoints boolean")


@query("validate_logits", sql("SELECT track_id, count(*) AS n_frames, bool_and(isfinite(logit)) AS finite FROM frames GROUP BY 1", "frames"))
def _(s, d):
    return t.frames(s, d).groupBy("track_id").agg(F.count("*").alias("n_frames"), F.bool_and(~F.isnan("logit") & (F.abs("logit") < float("inf"))).alias("finite"))


@query("pcm16_quantize", sql("SELECT track_id, frame, trunc(least(greatest(logit / 4, -1), 1) * 32767 + CASE WHEN logit < 0 THEN -0.5 ELSE 0.5 END)::BIGINT AS sample FROM frames", "frames"))
def _(s, d):
    x = F.least(F.greatest(F.col("logit") / 4, F.lit(-1.0)), F.lit(1.0)) * 32767
    return t.frames(s, d).select("track_id", "frame", (x + F.when(F.col("logit") < 0, -0.5).otherwise(0.5)).cast("long").alias("sample"))


# --- Assets, manifests, tempo segments, whole analyses ------------------------------------------------


@query("asset_paths", "SELECT page_id, url, url LIKE 'https://%' AS https, url NOT LIKE '/%' AND NOT list_contains(string_split(url, '/'), '..') AND url <> '' AS safe FROM pages")
def _(s, d):
    u = F.col("url")
    return t.table(s, d, "pages").select("page_id", "url", u.startswith("https://").alias("https"), (~u.startswith("/") & ~F.array_contains(F.split(u, "/"), "..") & (u != "")).alias("safe"))


@query("asset_digests", "SELECT item_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size_bytes, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS lower_hex FROM benchmark")
def _(s, d):
    b = t.table(s, d, "benchmark").select("item_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size_bytes"))
    return b.withColumn("lower_hex", F.col("sha256").rlike("^[0-9a-f]{64}$"))


@query("asset_resolve", "SELECT sha256, n, best AS doc_id FROM (SELECT sha256(text) AS sha256, count(*) AS n, coalesce(min(CASE WHEN source = 'src1' THEN doc_id END), min(doc_id)) AS best FROM documents WHERE text IS NOT NULL GROUP BY 1)")
def _(s, d):
    docs = t.table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"), (F.col("source") != "src1").alias("away"))
    best = docs.groupBy("sha256").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("away", F.lit(True)).alias("away"), "doc_id")).alias("b"))
    return best.select("sha256", "n", F.col("b.doc_id").alias("doc_id"))


@query("duplicate_assets", "SELECT sha256(text) AS sha256, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return t.table(s, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n")).where("n > 1")


for _kind, _columns in analysis.PARTS.items():
    query(f"analysis_{_kind}")(lambda s, d, k=_kind: analysis.part(analysis.analyze_tracks(_ideal_beats(s, d)), k))


def _ideal_beats(s, d):
    r = t.recipes(s, d)
    span = r.groupBy("recipe_id").agg(F.sum("duration_s").alias("duration_s"))
    b = truth.ideal_observations(truth.truth_beats(r)).join(span, "recipe_id")
    return b.withColumnRenamed("recipe_id", "track_id")


@query("full_analysis")
def _(s, d):
    b = t.beats(s, d)
    joined = b.join(t.tracks(b), "track_id").join(t.activity(s, d).select("track_id", "idx", F.col("time_s").alias("activity_s"), "relative_db"), ["track_id", "idx"])
    a = analysis.analyze_tracks(joined, policy="sequence-phase-v1")
    return a.select("track_id", "global_bpm", F.size("segments").alias("n_segments"), F.size("changes").alias("n_changes"), F.size("sections").alias("n_sections"), F.array_join("warnings", ",").alias("warnings"))


# --- Order-dependent repairs, one group per track ------------------------------------------------------


def _with_activity(s, d):
    b = t.beats(s, d)
    a = t.activity(s, d).select("track_id", "idx", F.col("time_s").alias("activity_s"), "relative_db")
    return b.join(t.tracks(b), "track_id").join(a, ["track_id", "idx"])


def _curve_and_tracks(s, d):
    return _curve(s, d), t.tracks(t.beats(s, d))


@query("polyline_knots", sql("SELECT track_id, idx, round(time_s, 6) AS time_s, round(bpm, 6) AS bpm FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY time_s) AS k FROM curve) JOIN knots USING (track_id, k)", "knots"))
def _(s, d):
    return folds.polyline_knots(_curve_and_tracks(s, d)[0])


@query("tempo_segments", sql(f"SELECT {rounded('!track_id, !seg, start_s, end_s, !kind, start_bpm, end_bpm, confidence')} FROM tempo_parts", "tempo_parts"))
def _(s, d):
    return folds.tempo_segments(*_curve_and_tracks(s, d))


_BLOCKS = """SELECT track_id, min(start_s) AS start_s, max(end_s) AS end_s, coalesce(min_by(prev_bpm, seg), min_by(start_bpm, seg)) AS before_bpm, coalesce(max_by(next_bpm, seg), max_by(end_bpm, seg)) AS after_bpm, avg(confidence) AS confidence FROM (SELECT *, seg - sum(inside::INT) OVER (PARTITION BY track_id ORDER BY seg) AS g FROM (SELECT *,
    kind = 'ramp' OR coalesce(lag(kind) OVER w = 'ramp' AND lead(kind) OVER w = 'ramp' AND (end_s - start_s) * (start_bpm + end_bpm) / 2 / 60 < 6, false) AS inside, [lag(end_bpm) OVER w] AS prev_bpm, [lead(start_bpm) OVER w] AS next_bpm FROM tempo_parts WINDOW w AS (PARTITION BY track_id ORDER BY seg))) WHERE inside GROUP BY track_id, g"""
_BLOCKS = _BLOCKS.replace("min_by(prev_bpm, seg)", "min_by(prev_bpm, seg)[1]").replace("max_by(next_bpm, seg)", "max_by(next_bpm, seg)[1]")


@query("segment_transitions", sql(f"SELECT {rounded('!track_id, start_s, end_s, before_bpm, after_bpm, confidence')} FROM ({_BLOCKS}) WHERE abs(ln(after_bpm / before_bpm)) >= ln(1.12::DOUBLE)", "tempo_parts"))
def _(s, d):
    return _transitions(s, d).select("track_id", "start_s", "end_s", "before_bpm", "after_bpm", "confidence")


_TURNS = f"""SELECT track_id, start_s AS time_s, 'tempo_jump' AS kind, least(greatest(confidence * abs(ln(after_bpm / before_bpm)) / 0.25, 0), 1) AS score FROM turns WHERE short
    UNION ALL SELECT track_id, start_s, 'ramp_boundary', confidence FROM turns WHERE NOT short AND has_before UNION ALL SELECT track_id, end_s, 'ramp_boundary', confidence FROM turns WHERE NOT short AND has_after"""
_TURNS = _TURNS.replace("FROM turns", f"""FROM (SELECT *, has_before AND has_after AND end_s - start_s <= 4 AS short FROM ({_BLOCKS.replace(" FROM (SELECT *, seg - sum", ", min_by(prev_bpm, seg)[1] IS NOT NULL AS has_before, max_by(next_bpm, seg)[1] IS NOT NULL AS has_after FROM (SELECT *, seg - sum", 1)}) WHERE abs(ln(after_bpm / before_bpm)) >= ln(1.12::DOUBLE))""")


def _transitions(s, d):
    return folds.segment_transitions(folds.tempo_segments(*_curve_and_tracks(s, d)))


@query("transition_changes", sql(f"SELECT track_id, round(time_s, 6) AS time_s, kind, round(score, 6) AS score FROM ({_TURNS})", "tempo_parts"))
def _(s, d):
    return folds.transition_changes(_transitions(s, d)).select("track_id", "time_s", "kind", "score")


@query("beats_beside_transitions", sql(f"""SELECT track_id, first_seg, side, round(time_s, 6) AS time_s FROM beats JOIN (SELECT track_id, first_seg, 'left' AS side, p.start_s AS low, b.start_s AS high FROM blocks b JOIN tempo_parts p USING (track_id) WHERE p.seg = first_seg - 1
    UNION ALL SELECT track_id, first_seg, 'right', b.end_s, p.end_s FROM blocks b JOIN tempo_parts p USING (track_id) WHERE p.seg = last_seg + 1) USING (track_id) WHERE (side = 'left' AND time_s >= low AND time_s < high) OR (side = 'right' AND time_s > low AND time_s <= high)""".replace("blocks b", f"""(SELECT * FROM ({_BLOCKS.replace(" FROM (SELECT *, seg - sum", ", min(seg) AS first_seg, max(seg) AS last_seg FROM (SELECT *, seg - sum", 1)}) WHERE abs(ln(after_bpm / before_bpm)) >= ln(1.12::DOUBLE)) b"""), "tempo_parts"))
def _(s, d):
    return folds.beats_beside(t.beats(s, d), _transitions(s, d))


# Positions that start a repair, and how many gaps each covers, from lists per track: later ones begin after earlier ones end.
_RUNS = """WITH RECURSIVE l AS (SELECT track_id, list(bounded_bpm ORDER BY idx) AS v, list(idx ORDER BY idx) AS x FROM gaps GROUP BY 1),
    c AS (SELECT track_id, st, sz, list_median(v[greatest(1, st - 2):st]) AS ml, list_median(v[st + sz + 1:st + sz + 3]) AS mr, v[st + 1:st + sz] AS r FROM (SELECT *, unnest(range(1, len(v) - 2)) AS st FROM l) CROSS JOIN (VALUES (2), (3)) z(sz) WHERE sz <= len(v) - st - 1),
    o AS (SELECT track_id, st, max_by({'sz': sz, 'ml': ml, 'mr': mr}, sz) AS b FROM c WHERE abs(ln(ml / mr)) <= ln(1.12::DOUBLE) AND list_bool_and(list_transform(r, lambda q: abs(round(log2(q) - (log2(ml) + log2(mr)) / 2)) >= 1 AND abs(log2(q) - (log2(ml) + log2(mr)) / 2 - round(log2(q) - (log2(ml) + log2(mr)) / 2)) <= log2(1.12::DOUBLE))) GROUP BY 1, 2),
    g AS (SELECT track_id, 0::BIGINT AS st, 1::BIGINT AS nxt FROM l UNION ALL SELECT g.track_id, o.st, o.st + o.b.sz FROM g JOIN LATERAL (SELECT * FROM o WHERE o.track_id = g.track_id AND o.st >= g.nxt ORDER BY o.st LIMIT 1) o ON true)
    SELECT track_id, st + k AS pos, pow(2, log2(b.ml) + (k + 1) / (b.sz + 1) * (log2(b.mr) - log2(b.ml))) AS bpm FROM (SELECT o.*, unnest(range(0, o.b.sz)) AS k FROM g JOIN o USING (track_id, st))"""


@query("metrical_run_repair", sql(f"SELECT track_id, idx, round(coalesce(r.bpm, bounded_bpm), 6) AS repaired_bpm FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS pos FROM gaps) LEFT JOIN ({_RUNS}) r USING (track_id, pos)", "gaps"))
def _(s, d):
    return folds.repair_runs(sequence.intervals(t.beats(s, d)))


_JITTER = """WITH RECURSIVE l AS (SELECT track_id, list(dt ORDER BY idx) AS v FROM gaps GROUP BY 1),
    c AS (SELECT track_id, i, a, list_median(a) AS p, x, y FROM (SELECT track_id, i, list_concat(v[greatest(1, i - 2):i], v[i + 3:i + 5]) AS a, v[i + 1] AS x, v[i + 2] AS y FROM (SELECT *, unnest(range(0, len(v) - 1)) AS i FROM l))),
    o AS (SELECT track_id, i, (x + y) / 2 AS m FROM c WHERE len(a) >= 2 AND list_bool_and(list_transform(a, lambda q: abs(q / p - 1) <= 0.12::DOUBLE)) AND abs((x + y) / 2 / p - 1) <= 0.12::DOUBLE AND (x - p) * (y - p) < 0 AND abs(x / y - 1) > 0.12::DOUBLE),
    g AS (SELECT track_id, -1::BIGINT AS i, 0::BIGINT AS nxt, NULL::DOUBLE AS m FROM l UNION ALL SELECT g.track_id, o.i, o.i + 2, o.m FROM g JOIN LATERAL (SELECT * FROM o WHERE o.track_id = g.track_id AND o.i >= g.nxt ORDER BY o.i LIMIT 1) o ON true)
    SELECT track_id, i + unnest([0, 1]) AS pos, 60 / m AS bpm FROM g WHERE m IS NOT NULL"""


@query("jitter_repair", sql(f"SELECT track_id, idx, round(coalesce(r.bpm, raw_bpm), 6) AS repaired_bpm FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS pos FROM gaps) LEFT JOIN ({_JITTER}) r USING (track_id, pos)", "gaps"))
def _(s, d):
    return folds.repair_jitter(sequence.intervals(t.beats(s, d)))


@query("edge_double_time")
def _(s, d):
    return folds.edge_double_time(_with_activity(s, d))


# Half-bar runs of downbeats lose their weaker phase; then a neighbour one beat off the bar moves to the stronger beat.
_BARS = """WITH p AS (SELECT *, pow(10, near_db / 20) AS power FROM near), d AS (SELECT track_id, idx, power, row_number() OVER w - 1 AS k, idx - lag(idx) OVER w AS g, count(*) OVER (PARTITION BY track_id) AS total FROM p WHERE downbeat_confidence >= 0.5 WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
    r AS (SELECT *, sum(CASE WHEN g = 2 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY k) AS run FROM d), j AS (SELECT *, (row_number() OVER (PARTITION BY track_id, run ORDER BY k) - 1) % 2 AS j FROM r WHERE total >= 6),
    c AS (SELECT *, CASE WHEN m0 >= m1 THEN 0 ELSE 1 END AS phase FROM (SELECT track_id, run, min(k) AS k0, max(k) AS k1, avg(power) FILTER (j = 0) AS m0, avg(power) FILTER (j = 1) AS m1 FROM j GROUP BY 1, 2 HAVING count(*) >= 6) WHERE greatest(m0, m1) / greatest(least(m0, m1), 1e-9) >= 1.2::DOUBLE),
    z AS (SELECT track_id, idx FROM j JOIN c USING (track_id, run) WHERE j <> phase), n AS (SELECT p.*, CASE WHEN z.idx IS NULL THEN downbeat_confidence ELSE 0 END AS down FROM p LEFT JOIN z USING (track_id, idx)),
    e AS (SELECT track_id, run, k0, k1, min(idx) AS a, max(idx) AS b FROM j JOIN c USING (track_id, run) WHERE j = phase GROUP BY ALL),
    m AS (SELECT e.track_id, d.idx AS have, a - 4 AS want FROM e JOIN d ON d.track_id = e.track_id AND d.k = k0 - 1 UNION ALL SELECT e.track_id, d.idx, b + 4 FROM e JOIN d ON d.track_id = e.track_id AND d.k = k1 + 1),
    o AS (SELECT m.*, h.down FROM m JOIN n h ON h.track_id = m.track_id AND h.idx = have JOIN n w ON w.track_id = m.track_id AND w.idx = want WHERE abs(want - have) <= 1 AND w.down < 0.5 AND h.down >= 0.5 AND w.power / greatest(h.power, 1e-9) >= 1.2::DOUBLE)
    SELECT n.track_id, time_s, confidence, coalesce(i.down, CASE WHEN x.have IS NULL THEN n.down ELSE 0 END) AS downbeat_confidence FROM n LEFT JOIN o i ON i.track_id = n.track_id AND i.want = n.idx LEFT JOIN o x ON x.track_id = n.track_id AND x.have = n.idx"""


@query("bar_level_downbeats", sql(f"SELECT {rounded('!track_id, time_s, confidence, downbeat_confidence')} FROM ({_BARS})", "near"))
def _(s, d):
    return folds.bar_level_downbeats(_with_activity(s, d))


@query("transition_grid_recovery")
def _(s, d):
    return folds.recover_grids(_with_activity(s, d))


@query("folded_beats", sql(f"SELECT b.track_id, b.idx, round(b.time_s, 6) AS time_s FROM beats b JOIN (SELECT track_id, CASE WHEN even >= odd THEN 0 ELSE 1 END AS p, m >= 150 AND m / 2 BETWEEN 70 AND 180 AND n >= 8 AND greatest(even, odd) / greatest(least(even, odd), 1e-9) >= 1.35 AS fold FROM (SELECT track_id, avg({_SAL}) FILTER (idx % 2 = 0) AS even, avg({_SAL}) FILTER (idx % 2 = 1) AS odd, count(*) AS n FROM near GROUP BY 1) JOIN (SELECT track_id, median(raw_bpm) AS m FROM gaps GROUP BY 1) USING (track_id)) USING (track_id) WHERE NOT fold OR b.idx % 2 = p", "near", "gaps"))
def _(s, d):
    return sequence.fold_beats(t.beats(s, d), sequence.metrical_level(_near(s, d), sequence.intervals(t.beats(s, d)))).select("track_id", "idx", "time_s")


def _fits(order: str) -> str:
    """Longest run of beats, from the first one in ``order`` on, that a grid fits within 8 % of its period."""
    return f"""SELECT track_id, max(n) AS longest FROM (SELECT track_id, n, any_value(p) AS p, max(abs(time_s - (o + idx * p))) AS err FROM (SELECT e.track_id, e.idx + 1 AS n, b.idx, b.time_s, regr_slope(b.time_s, b.idx) OVER w AS p, regr_intercept(b.time_s, b.idx) OVER w AS o
        FROM ordered e JOIN ordered b ON b.track_id = e.track_id AND b.idx <= e.idx WHERE e.idx >= 5 WINDOW w AS (PARTITION BY e.track_id, e.idx)) GROUP BY ALL) WHERE p > 0 AND err <= 0.08::DOUBLE * p GROUP BY 1""".replace("ordered", f"(SELECT recipe_id AS track_id, {order} AS time_s, row_number() OVER (PARTITION BY recipe_id ORDER BY {order}) - 1 AS idx FROM truth_beats)")


def _grid_beats(s, d):
    return truth.truth_beats(t.recipes(s, d)).select(F.col("recipe_id").alias("track_id"), "time_s")


@query("grid_prefix_fit", sql(f"SELECT track_id, longest AS longest_prefix FROM ({_fits('time_s')})", "truth_beats"))
def _(s, d):
    return folds.longest_fits(_grid_beats(s, d)).where("longest_prefix IS NOT NULL").select("track_id", "longest_prefix")


@query("grid_suffix_fit", sql(f"SELECT track_id, longest AS longest_suffix FROM ({_fits('-time_s')})", "truth_beats"))
def _(s, d):
    return folds.longest_fits(_grid_beats(s, d)).where("longest_suffix IS NOT NULL").select("track_id", "longest_suffix")


@query("all_changes", sql(f"SELECT track_id, round(time_s, 6) AS time_s, kind, round(score, 6) AS score FROM ({_JUMPS} UNION ALL {_TURNS} UNION ALL SELECT track_id, time_s + dt / 2, 'rhythm_discontinuity', least(greatest(1 - m / dt, 0), 1) FROM gaps JOIN (SELECT track_id, median(dt) AS m FROM gaps GROUP BY 1) USING (track_id) WHERE dt > 1 AND dt > 3.5 * m UNION ALL SELECT track_id, (start_s + end_s) / 2, 'rhythm_discontinuity', least(greatest((-depth_db - 20) / 60, 0), 1) FROM regions)", "curve", "tempo_parts", "gaps", "regions"))
def _(s, d):
    """The four lists of changes, not deduplicated yet: jumps, transitions, gaps, silences."""
    columns = ("track_id", "time_s", "kind", "score")
    jumps = sequence.tempo_jumps(_curve(s, d)).withColumn("kind", F.lit("tempo_jump")).select(*columns)
    turns = folds.transition_changes(_transitions(s, d)).select(*columns)
    gaps = sequence.long_gaps(sequence.intervals(t.beats(s, d))).withColumn("kind", F.lit("rhythm_discontinuity")).select(*columns)
    middle, depth = ((F.col("start_s") + F.col("end_s")) / 2).alias("time_s"), sequence.clamp((-F.col("depth_db") - 20) / 60).alias("score")
    quiet = _regions(s, d).select("track_id", middle, F.lit("rhythm_discontinuity").alias("kind"), depth)
    return jumps.unionByName(turns).unionByName(gaps).unionByName(quiet)
