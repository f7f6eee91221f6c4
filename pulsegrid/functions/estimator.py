"""The tempo estimator for one track, used inside grouped functions.

Everything order-dependent lives here: bounded repairs, polyline simplification, transition blocks, grid
recovery. A track is a few hundred to a few thousand beats, so one group is small; tracks are the unit of
distribution.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import reduce
from operator import add
from statistics import median

from pulsegrid.options import EstimatorOptions


class ObservationError(ValueError):
    """Observations break the input contract."""


@dataclass
class Beat:
    t: float
    conf: float
    down: float


@dataclass
class Observations:
    duration: float
    beats: list[Beat]
    activity: list[tuple[float, float]] = field(default_factory=list)  # (time, dB)
    frame_rate: float | None = None


@dataclass
class Segment:
    start: float
    end: float
    kind: str
    start_bpm: float
    end_bpm: float
    conf: float


@dataclass
class Change:
    t: float
    kind: str
    score: float
    before: float | None = None
    after: float | None = None


def unit(x: float) -> float:
    return min(max(x, 0.0), 1.0)


def half_away(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x)


def validate(o: Observations) -> None:
    if not (math.isfinite(o.duration) and o.duration >= 0):
        raise ObservationError("the duration must be finite and not negative")
    for what, times in (("beat", [b.t for b in o.beats]), ("activity", [t for t, _ in o.activity])):
        if any(not (math.isfinite(t) and 0 <= t <= o.duration) for t in times):
            raise ObservationError(f"{what} time out of range")
        if any(b <= a for a, b in zip(times, times[1:])):
            raise ObservationError(f"{what} times must rise")


def level_at(activity: list[tuple[float, float]], t: float) -> float | None:
    """dB of the nearest activity point, the first of equally near ones."""
    if not activity:
        return None
    i = bisect_left(activity, (t,))
    if i == len(activity) or (i and t - activity[i - 1][0] <= activity[i][0] - t):
        i -= 1
    return activity[i][1]


def amplitude(activity, t: float, missing: float) -> float:
    db = level_at(activity, t)
    return missing if db is None else 10 ** (db / 20)


def silences(o: Observations, p: EstimatorOptions) -> list[tuple[float, float, float]]:
    """(start, end, depth) of quiet runs."""
    times = [t for t, _ in o.activity]
    if not times:
        return []
    hop = median(b - a for a, b in zip(times, times[1:])) if len(times) > 1 else max(o.duration, 0.001)
    out, run = [], []
    for point in [*o.activity, (math.inf, 0.0)]:
        if point[1] <= p.silence_threshold_db:
            run.append(point)
        elif run:
            start, end = max(run[0][0] - hop / 2, 0.0), min(run[-1][0] + hop / 2, o.duration)
            if end - start >= p.min_silence_s:
                out.append((start, end, min(0.0, min(db for _, db in run))))
            run = []
    return out


def evidence(beats: list[Beat], activity) -> float:
    return sum(unit(b.conf) * amplitude(activity, b.t, 1.0) + 0.25 * unit(b.down) for b in beats) / max(len(beats), 1)


def double_time_extras(beats: list[Beat], activity) -> set[int]:
    """Indices of extra beats where a steady pulse turns into twice its rate up to the end (forward scan)."""
    t, n, best = [b.t for b in beats], len(beats), set()
    for b in range(6, n - 1):
        gaps = [t[i + 1] - t[i] for i in range(b - 6, b)]
        p = median(gaps)
        if p <= 0 or any(abs(g - p) > 0.08 * p for g in gaps) or abs((t[b + 1] - t[b]) / p - 0.5) > 0.12:
            continue
        cur, kept, extra, ok = b, [], [], True
        while cur + 1 < n:
            want = t[cur] + p
            # The last beat on the grid point; a run that ends on an extra beat has none there and does not count.
            c = bisect_right(t, want + 0.12 * p) - 1
            if c <= cur or abs(t[c] - want) > 0.12 * p:
                ok = False
                break
            middle = (t[cur] + t[c]) / 2
            if any(abs(t[i] - middle) > 0.20 * p for i in range(cur + 1, c)):
                ok = False
                break
            extra += range(cur + 1, c)
            kept.append(c)
            cur = c
        if not ok or len(extra) < 4 or len(kept) < 6 or len(extra) <= len(best):
            continue
        strong, weak = evidence([beats[i] for i in kept], activity), evidence([beats[i] for i in extra], activity)
        if strong / max(weak, 1e-9) >= 1.15:
            best = set(extra)
    return best


def repair_edges(o: Observations) -> bool:
    """Remove double-time extras at either end, in place."""
    n = len(o.beats)
    if n < 12 or not o.activity:
        return False
    back = [Beat(o.duration - b.t, b.conf, b.down) for b in reversed(o.beats)]
    drop = double_time_extras(o.beats, o.activity) | {n - 1 - i for i in double_time_extras(back, [(o.duration - t, db) for t, db in reversed(o.activity)])}
    o.beats = [b for i, b in enumerate(o.beats) if i not in drop]
    return bool(drop)


def select_level(o: Observations, p: EstimatorOptions) -> str | None:
    """Keep every other beat where the pulse is fast and one phase clearly stronger; the warning, if any."""
    beats = o.beats
    if len(beats) < 8 or not o.activity:
        return None
    raw = median(60 / (b.t - a.t) for a, b in zip(beats, beats[1:]))
    if raw < p.half_time_min_bpm or not p.preferred_min_bpm <= raw / 2 <= p.preferred_max_bpm:
        return None
    power = [sum(unit(b.conf) * amplitude(o.activity, b.t, 1.0) for b in beats[k::2]) / len(beats[k::2]) for k in (0, 1)]
    phase = 0 if power[0] >= power[1] else 1
    if power[phase] / max(power[1 - phase], 1e-9) < p.half_time_salience_ratio:
        return None
    kept = [Beat(b.t, b.conf, b.down) for b in beats[phase::2]]
    if p.sequence_phase:
        for b in beats[1 - phase :: 2]:
            if b.down >= 0.5:
                k = min(kept, key=lambda x: abs(x.t - b.t))
                k.down = max(k.down, 0.9 * b.down)
        at = [i for i, b in enumerate(kept) if b.down >= 0.5]
        if len(at) >= 3 and median(b - a for a, b in zip(at, at[1:])) < 2:
            return "inconsistent_half_time_selection_rejected"
    o.beats = kept
    return "metrical_level_selected_half_time"


def repair_jitter(dt: list[float], bpm: list[float], tol: float) -> bool:
    """Neighbouring gaps on both sides of a stable period take their mean; skip past each pair."""
    i, changed = 0, False
    while i + 1 < len(dt):
        around = dt[max(0, i - 3) : i] + dt[i + 2 : i + 5]
        if len(around) >= 2:
            p, mean = median(around), (dt[i] + dt[i + 1]) / 2
            near = all(abs(d / p - 1) <= tol for d in around) and abs(mean / p - 1) <= tol
            if near and (dt[i] - p) * (dt[i + 1] - p) < 0 and abs(dt[i] / dt[i + 1] - 1) > tol:
                bpm[i] = bpm[i + 1] = 60 / mean
                changed = True
                i += 2
                continue
        i += 1
    return changed


def repair_runs(v: list[float], longest: int, tol: float, radius: int = 3) -> bool:
    """Short runs an octave off agreeing contexts are interpolated; contexts keep their original values."""
    n, changed = len(v), False
    if longest < 2 or n < 4:
        return False
    edge, octave, src, start = math.log1p(tol), math.log2(1 + tol), list(v), 1
    while start + 2 < n:
        for size in range(min(longest, n - start - 1), 1, -1):
            left, right = src[max(0, start - radius) : start], src[start + size : start + size + radius]
            if not left or not right:
                continue
            ml, mr = median(left), median(right)
            if abs(math.log(ml / mr)) > edge:
                continue
            middle = (math.log2(ml) + math.log2(mr)) / 2
            off = [math.log2(x) - middle for x in src[start : start + size]]
            if all(abs(half_away(x)) >= 1 and abs(x - half_away(x)) <= octave for x in off):
                for k in range(size):
                    v[start + k] = 2 ** (math.log2(ml) + (k + 1) / (size + 1) * (math.log2(mr) - math.log2(ml)))
                changed = True
                start += size
                break
        else:
            start += 1
    return changed


def smooth(v: list[float], p: EstimatorOptions) -> list[float]:
    r, n, edge, octave = p.smoothing_window // 2, len(v), math.log1p(p.jump_ratio), math.log2(1 + p.jump_ratio)
    fixed = list(v)
    for i in range(n):
        left, right = v[max(0, i - r) : i], v[i + 1 : i + 1 + r]
        if left and right:
            a, b = median(left), median(right)
            off = math.log2(v[i]) - (math.log2(a) + math.log2(b)) / 2
            if abs(math.log(a / b)) <= edge and abs(half_away(off)) >= 1 and abs(off - half_away(off)) <= octave:
                fixed[i] = (a + b) / 2
    out = list(fixed)
    for i in range(1, n - 1):
        w = fixed[i - 1 : i + 2]
        if max(w) / min(w) <= 1 + p.jump_ratio:
            out[i] = 2 ** (sum(map(math.log2, w)) / 3)
    return out


def simplify(times: list[float], bpm: list[float], tol: float) -> list[int]:
    """Knots of the polyline in (time, octaves): split at the worst point, the last of equals."""
    n = len(times)
    if n <= 2:
        return list(range(n))
    y, keep, stack = [math.log2(x) for x in bpm], {0, n - 1}, [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b <= a + 1 or times[b] - times[a] <= 2.220446049250313e-16:
            continue
        slope = (y[b] - y[a]) / (times[b] - times[a])
        worst, at = max((abs(y[i] - (y[a] + slope * (times[i] - times[a]))), i) for i in range(a + 1, b))
        if worst > tol:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return sorted(keep)


def build_segments(times, bpm, conf, duration: float, p: EstimatorOptions, edge: float | None = None) -> list[Segment]:
    """Segments between the knots, constant where the logarithm of their tempos' ratio is ``edge`` at most, log1p(constant_ratio) unless given."""
    knots, out = simplify(times, bpm, p.curve_tolerance_octaves), []
    edge = math.log1p(p.constant_ratio) if edge is None else edge
    if len(times) == 1:
        return [Segment(0.0, duration, "constant", bpm[0], bpm[0], conf[0])]
    for k, (a, b) in enumerate(zip(knots, knots[1:])):
        start = 0.0 if k == 0 else times[a]
        end = duration if k == len(knots) - 2 else times[b]
        c = reduce(add, conf[a : b + 1]) / (b - a + 1)  # one by one, as SQL adds: sum() carries the lost bits along
        kind = "constant" if abs(math.log(bpm[b] / bpm[a])) <= edge else "ramp"
        out.append(Segment(start, end, kind, bpm[a], bpm[b], c))
    return out


@dataclass
class Tempo:
    times: list[float]
    bpm: list[float]
    conf: list[float]
    segments: list[Segment]
    runs_repaired: bool = False
    jitter_repaired: bool = False


def estimate_tempo(o: Observations, p: EstimatorOptions) -> Tempo:
    b = o.beats
    dt = [y.t - x.t for x, y in zip(b, b[1:])]
    bpm = [60 / d for d in dt]
    jitter = bool(p.sequence_phase and o.frame_rate) and repair_jitter(dt, bpm, p.jump_ratio)
    bounded = [min(max(x, p.min_bpm), p.max_bpm) for x in bpm]
    base = list(bounded)
    runs = repair_runs(base, p.max_metrical_outlier_run, p.jump_ratio, p.smoothing_window // 2)
    s = smooth(base, p)
    times = [(x.t + y.t) / 2 for x, y in zip(b, b[1:])]
    conf = [unit(min(x.conf, y.conf) * math.exp(-8 * abs(math.log2(v / w)))) for x, y, v, w in zip(b, b[1:], bounded, s)]
    return Tempo(times, s, conf, build_segments(times, s, conf, o.duration, p), runs, jitter)


def transitions(segments: list[Segment], jump_ratio: float = EstimatorOptions.jump_ratio) -> list[tuple[int, int, float, float, float]]:
    """(first, last, before, after, confidence) of blocks of ramps, short constants bridged."""
    out, i, n = [], 0, len(segments)
    while i < n:
        if segments[i].kind != "ramp":
            i += 1
            continue
        j = i
        while j + 1 < n:
            nxt = segments[j + 1]
            if nxt.kind == "ramp":
                j += 1
            elif j + 2 < n and segments[j + 2].kind == "ramp" and (nxt.end - nxt.start) * (nxt.start_bpm + nxt.end_bpm) / 2 / 60 < 6:
                j += 2
            else:
                break
        before = segments[i - 1].end_bpm if i else segments[i].start_bpm
        after = segments[j + 1].start_bpm if j + 1 < n else segments[j].end_bpm
        if abs(math.log(after / before)) >= math.log1p(jump_ratio):
            out.append((i, j, before, after, sum(s.conf for s in segments[i : j + 1]) / (j - i + 1)))
        i = j + 1
    return out


def fit_grid(t: list[float]) -> tuple[float, float, float] | None:
    """(period, origin, largest error) of the least-squares grid through six times or more."""
    n = len(t)
    if n < 6:
        return None
    mi, mt = (n - 1) / 2, sum(t) / n
    period = sum((i - mi) * (x - mt) for i, x in enumerate(t)) / sum((i - mi) ** 2 for i in range(n))
    if period <= 0:
        return None
    origin = mt - period * mi
    return period, origin, max(abs(x - (origin + i * period)) for i, x in enumerate(t))


def fitting_prefixes(t: list[float]) -> list[int]:
    """Lengths of the prefixes that a grid fits within about 8 % of its period, ascending.

    Running sums give the grid of every prefix, the convex hulls of its points the largest error: n log n for all of them.
    """
    total = weighted = 0.0
    hulls: tuple[list, list] = ([], [])
    fits = []
    for i, at in enumerate(t):
        x, n = at - t[0], i + 1
        total, weighted = total + x, weighted + i * x
        for hull, sign in zip(hulls, (1, -1)):
            while len(hull) > 1 and _slope(hull[-2], hull[-1]) <= _slope(hull[-1], (i, sign * x)):
                hull.pop()
            hull.append((i, sign * x))
        if n < 6:
            continue
        mi = (n - 1) / 2
        period = (weighted - mi * total) / (n * (n * n - 1) / 12)
        if period <= 0:
            continue
        origin = total / n - period * mi
        error = max(_highest(hulls[0], period) - origin, _highest(hulls[1], -period) + origin)
        if error <= 0.08 * period * (1 + 1e-6):
            fits.append(n)
    return fits


def on_grid(t: list[float]) -> bool:
    return bool(f := fit_grid(t)) and f[2] <= 0.08 * f[0]


def longest_prefix(t: list[float]) -> int | None:
    """Beats of the longest prefix that a grid fits; ``fit_grid`` decides on the few that are looked at from the longest down."""
    return next((n for n in reversed(fitting_prefixes(t)) if on_grid(t[:n])), None)


def longest_suffix(t: list[float]) -> int | None:
    return next((n for n in reversed(fitting_prefixes([-x for x in reversed(t)])) if on_grid(t[-n:])), None)


def _slope(a: tuple[int, float], b: tuple[int, float]) -> float:
    return (b[1] - a[1]) / (b[0] - a[0])


def _highest(hull: list, slope: float) -> float:
    """Largest height of an upper hull's points over the line of that slope through the origin."""
    k = bisect_left(range(len(hull) - 1), True, key=lambda k: _slope(hull[k], hull[k + 1]) <= slope)
    return hull[k][1] - slope * hull[k][0]


def missed(gap: float, periods: tuple[float, float]) -> bool:
    if any(abs(gap / p - 1) <= 0.2 for p in periods):
        return False
    return any(1.6 <= gap / p <= 3.25 and abs(gap / p - half_away(gap / p)) <= 0.15 for p in periods)


def recover_grid(beats: list[Beat], segments: list[Segment], block, p: EstimatorOptions) -> list[Beat] | None:
    """Beats with one short transition redrawn on the grids of its neighbours; None where nothing changes."""
    i, j, _, _, conf = block
    if i == 0 or j + 1 >= len(segments):
        return None
    start, end = segments[i].start, segments[j].end
    if end - start > p.jump_transition_max_s:
        return None
    left = [b.t for b in beats if segments[i - 1].start <= b.t < start]
    right = [b.t for b in beats if end < b.t <= segments[j + 1].end]
    k, m = longest_prefix(left), longest_suffix(right)
    if not k or not m:
        return None
    m = len(right) - m
    (lp, lo, _), (rp, ro, _) = fit_grid(left[:k]), fit_grid(right[m:])
    if k < len(left):
        start = min(start, (left[k - 1] + left[k]) / 2)
    if m:
        end = max(end, right[m] - rp / 2)
    if abs(math.log(rp / lp)) < math.log1p(p.jump_ratio):
        return None
    short, long = min(lp, rp), max(lp, rp)
    near = [b.t for b in beats if start - long <= b.t <= end + long]
    gaps = [b - a for a, b in zip(near, near[1:])]
    if not any(g < 0.65 * short or missed(g, (lp, rp)) for g in gaps):
        return None

    def off_left(t: float) -> float:
        return abs(t - (lo + half_away((t - lo) / lp) * lp))

    point = ro
    while point - rp >= start:
        point -= rp
    while point < start:
        point += rp
    first = point
    while point <= end and off_left(point) > 0.12 * short:
        point += rp
    if point > end:
        point = first
    before = [b.t for b in beats if b.t <= point]
    begin = max(before) if before and point - max(before) <= 0.12 * short else point
    old = [b for b in beats if begin <= b.t <= end]
    new, t = [], point
    while t <= end:
        close = min(old, key=lambda b: abs(b.t - t), default=None)
        new.append(Beat(t, close.conf, close.down) if close and abs(close.t - t) < 0.45 * rp else Beat(t, conf * 0.5, 0.0))
        t += rp
    if len(old) == len(new) and all(abs(a.t - b.t) <= 0.08 * rp for a, b in zip(old, new)):
        return None
    return sorted([b for b in beats if not begin <= b.t <= end] + new, key=lambda b: b.t)


def select_downbeats(o: Observations, p: EstimatorOptions) -> bool:
    """Half-bar downbeat runs keep their stronger phase; boundary downbeats one beat off are moved."""
    beats = o.beats
    at = [i for i, b in enumerate(beats) if b.down >= 0.5]
    if len(at) < 6 or not o.activity:
        return False
    power = {i: amplitude(o.activity, beats[i].t, 0.0) for i in range(len(beats))}
    runs, run = [], [0]
    for k in range(1, len(at)):
        if at[k] - at[k - 1] != 2:
            runs.append(run)
            run = []
        run.append(k)
    runs.append(run)
    chosen = []
    for run in runs:
        if len(run) < 6:
            continue
        mean = [sum(power[at[k]] for k in run[f::2]) / len(run[f::2]) for f in (0, 1)]
        phase = 0 if mean[0] >= mean[1] else 1
        if mean[phase] / max(mean[1 - phase], 1e-9) >= p.half_bar_downbeat_salience_ratio:
            for k in run[1 - phase :: 2]:
                beats[at[k]].down = 0.0
            chosen.append((run, at[run[phase]], at[run[phase::2][-1]]))

    def move(want: int, have: int) -> None:
        if 0 <= want < len(beats) and abs(want - have) <= 1 and beats[want].down < 0.5 <= beats[have].down and power[want] / max(power[have], 1e-9) >= p.half_bar_downbeat_salience_ratio:
            beats[want].down, beats[have].down = beats[have].down, 0.0

    for run, first, last in chosen:
        if first >= 4 and run[0] > 0:
            move(first - 4, at[run[0] - 1])
        if run[-1] + 1 < len(at) and last + 4 < len(beats):
            move(last + 4, at[run[-1] + 1])
    return bool(chosen)


def find_changes(tempo: Tempo, beats: list[Beat], quiet, p: EstimatorOptions) -> list[Change]:
    """Jumps, transitions, gaps and silences in time order; near repeats keep the strongest."""
    t, v, s, out, jump = tempo.times, tempo.bpm, tempo.segments, [], math.log1p(p.jump_ratio)
    if len(v) >= 5:
        for i in range(2, len(v) - 2):
            a, b = (v[i - 2] + v[i - 1]) / 2, (v[i] + v[i + 1]) / 2
            r = abs(math.log(b / a))
            if r >= jump:
                out.append(Change(t[i], "tempo_jump", unit((r - jump) / 0.25), a, b))
    for i, j, before, after, conf in transitions(s, p.jump_ratio):
        if i > 0 and j + 1 < len(s) and s[j].end - s[i].start <= p.jump_transition_max_s:
            out.append(Change(s[i].start, "tempo_jump", unit(conf * abs(math.log(after / before)) / 0.25), before, after))
            continue
        if i > 0:
            out.append(Change(s[i].start, "ramp_boundary", conf, before, s[i].start_bpm))
        if j + 1 < len(s):
            out.append(Change(s[j].end, "ramp_boundary", conf, s[j].end_bpm, after))
    dt = [b.t - a.t for a, b in zip(beats, beats[1:])]
    mid = median(dt)
    for a, d in zip(beats, dt):
        if d > p.discontinuity_factor * mid and d > 1:
            out.append(Change(a.t + d / 2, "rhythm_discontinuity", unit(1 - mid / d)))
    out += [Change((a + b) / 2, "rhythm_discontinuity", unit((-depth - 20) / 60)) for a, b, depth in quiet]
    out.sort(key=lambda c: c.t)
    kept: list[Change] = []
    for c in out:
        if kept and kept[-1].kind == c.kind and c.t - kept[-1].t < 0.75:
            if c.score > kept[-1].score:
                kept[-1] = c
        else:
            kept.append(c)
    return kept


def section_bounds(changes: list[float], duration: float) -> list[float]:
    out: list[float] = []
    for t in sorted([0.0, *changes, duration]):
        if not out or t - out[-1] >= 0.5:
            out.append(t)
    return out


def sections(tempo: Tempo | None, beats: list[Beat], changes: list[Change], duration: float) -> list[tuple]:
    """(start, end, bpm, stability, beat count) between boundaries, ends exclusive."""
    out, bounds = [], section_bounds([c.t for c in changes], duration)
    for a, b in zip(bounds, bounds[1:]):
        if b <= a:
            continue
        v = [x for t, x in zip(tempo.times, tempo.bpm) if a <= t < b] if tempo else []
        mid = median(v) if v else None
        stable = unit(1 - 8 * sum(abs(math.log2(x / mid)) for x in v) / len(v)) if v else 0.0
        out.append((a, b, mid, stable, sum(a <= x.t < b for x in beats)))
    return out


def analyze(o: Observations, p: EstimatorOptions = EstimatorOptions()) -> dict:
    """The whole analysis of one track."""
    validate(o)
    o = Observations(o.duration, [Beat(b.t, b.conf, b.down) for b in o.beats], list(o.activity), o.frame_rate)
    warnings, quiet = [], silences(o, p)
    loud = [b for b in o.beats if not any(a <= b.t <= e for a, e, _ in quiet)]
    if len(loud) < len(o.beats):
        warnings.append("low_activity_beats_rejected")
    o.beats = loud
    if p.sequence_phase and repair_edges(o):
        warnings.append("edge_double_time_events_rejected")
    if w := select_level(o, p):
        warnings.append(w)

    def beat_rows() -> list[tuple]:
        return [(b.t, unit(b.conf), unit(b.down), b.down >= 0.5) for b in o.beats]

    if len(o.beats) < 3:
        whole = [(0.0, o.duration, None, 0.0, len(o.beats))]
        return {"beats": beat_rows(), "global_bpm": None, "hypotheses": [], "curve": [], "segments": [], "changes": [], "sections": whole, "warnings": [*warnings, "too_few_beats_for_tempo_curve"]}
    tempo, recovered = estimate_tempo(o, p), False
    for block in transitions(tempo.segments, p.jump_ratio):
        if (new := recover_grid(o.beats, tempo.segments, block, p)) is not None:
            o.beats, recovered = new, True
    if recovered:
        warnings.append("short_transition_beat_grid_recovered")
    if select_downbeats(o, p):
        warnings.append("bar_level_downbeats_selected")
    tempo = estimate_tempo(o, p)
    if tempo.runs_repaired:
        warnings.append("short_metrical_outlier_run_repaired")
    if tempo.jitter_repaired:
        warnings.append("quantized_interval_jitter_repaired")
    bpm = median(tempo.bpm)
    hypotheses = [(bpm * f, s, k) for f, s, k in ((0.5, 0.5, -1), (1.0, 1.0, 0), (2.0, 0.5, 1)) if p.min_bpm <= bpm * f <= p.max_bpm]
    if len(hypotheses) > 1:
        warnings.append("metrical_level_has_half_or_double_time_alternatives")
    changes = find_changes(tempo, o.beats, quiet, p)
    return {
        "beats": beat_rows(),
        "global_bpm": bpm,
        "hypotheses": hypotheses,
        "curve": list(zip(tempo.times, tempo.bpm, tempo.conf)),
        "segments": [(s.start, s.end, s.kind, s.start_bpm, s.end_bpm, s.conf) for s in tempo.segments],
        "changes": [(c.t, c.kind, c.score, c.before, c.after) for c in changes],
        "sections": sections(tempo, o.beats, changes, o.duration),
        "warnings": warnings,
    }
