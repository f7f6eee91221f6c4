"""The estimator's expected behaviour on short synthetic tracks."""

import math

import pytest

from pulsegrid.functions.estimator import Beat, ObservationError, Observations, analyze
from pulsegrid.options import OptionError, estimator_policy

DEFAULT, RUNS, PHASE = (estimator_policy(n) for n in ("default", "metrical-consistency-v1", "sequence-phase-v1"))


def track(bpms, activity=None, rate=None):
    t = [0.0]
    for b in bpms:
        t.append(t[-1] + 60 / b)
    return Observations(t[-1] + 0.25, [Beat(x, 0.95, 0.9 if i % 4 == 0 else 0.1) for i, x in enumerate(t)], activity or [], rate)


def with_levels(o, levels):
    o.activity = [(b.t, levels[i % len(levels)]) for i, b in enumerate(o.beats)]
    return o


def test_constant():
    a = analyze(track([120] * 32))
    assert a["global_bpm"] == pytest.approx(120) and all(s[2] == "constant" for s in a["segments"]) and not a["changes"]


def test_step():
    a = analyze(track([120] * 20 + [160] * 20))
    assert any(c[1] == "tempo_jump" for c in a["changes"]) and len(a["sections"]) >= 2 and len(a["beats"]) == 41


def test_octave_step_stays():
    a = analyze(track([75] * 20 + [150] * 20))
    assert min(x[1] for x in a["curve"]) == pytest.approx(75) and max(x[1] for x in a["curve"]) == pytest.approx(150)


def test_fast_is_not_folded():
    assert analyze(track([240] * 32))["global_bpm"] == pytest.approx(240)


def test_missing_beat_is_repaired():
    o = track([120] * 32)
    del o.beats[16]
    assert all(x[1] == pytest.approx(120) for x in analyze(o)["curve"])


def test_short_octave_run_needs_the_policy():
    bpms = [150] * 8 + [75] * 3 + [150] * 8
    assert min(x[1] for x in analyze(track(bpms))["curve"]) < 80
    a = analyze(track(bpms), RUNS)
    assert all(x[1] == pytest.approx(150) for x in a["curve"]) and "short_metrical_outlier_run_repaired" in a["warnings"]


def test_lone_slow_gap_stays():
    for p in (DEFAULT, RUNS):
        assert min(x[1] for x in analyze(track([100, 100, 80, 100, 100]), p)["curve"]) == pytest.approx(80)


def test_jitter_needs_a_frame_rate():
    bpms = [200] * 12 + [187.5, 230.7692, 187.5] + [200] * 12
    a = analyze(track(bpms, rate=50.0), PHASE)
    assert all(abs(x[1] / 200 - 1) < 0.1 for x in a["curve"]) and "quantized_interval_jitter_repaired" in a["warnings"]
    assert "quantized_interval_jitter_repaired" not in analyze(track(bpms), PHASE)["warnings"]


def test_ramp():
    assert any(s[2] == "ramp" for s in analyze(track([100 + 50 * i / 47 for i in range(48)]))["segments"])


def test_unsorted_is_refused():
    o = track([120] * 8)
    o.beats[4].t = o.beats[3].t
    with pytest.raises(ObservationError):
        analyze(o)


def test_weak_off_beats_fold():
    a = analyze(with_levels(track([180] * 40), [0.0, -20.0]))
    assert a["global_bpm"] == pytest.approx(90) and len(a["beats"]) == 21 and "metrical_level_selected_half_time" in a["warnings"]
    a = analyze(with_levels(track([180] * 40), [0.0]))
    assert a["global_bpm"] == pytest.approx(180) and len(a["beats"]) == 41


def test_inconsistent_fold_is_rejected():
    o = with_levels(track([200] * 40), [0.0, -6.0])
    for i, b in enumerate(o.beats):
        b.down = 0.9 if i % 2 == 0 else 0.1
    a = analyze(o, PHASE)
    assert a["global_bpm"] == pytest.approx(200) and "inconsistent_half_time_selection_rejected" in a["warnings"]


def test_edge_extras_go():
    t = [float(i) for i in range(31)]
    times = sorted(t + [i + 0.5 for i in range(13, 30)])
    o = Observations(31.0, [Beat(x, 0.95, 0.1) for x in times], [(x, 0.0 if x == int(x) else -20.0) for x in times])
    a = analyze(o, PHASE)
    assert a["global_bpm"] == pytest.approx(60) and len(a["beats"]) == 31 and "edge_double_time_events_rejected" in a["warnings"]


def test_equal_doubling_stays():
    a = analyze(with_levels(track([60] * 12 + [120] * 24), [0.0]), PHASE)
    assert len(a["beats"]) == 37 and a["curve"][-1][1] == pytest.approx(120)


def test_half_bar_downbeats_keep_the_accent():
    o = track([120] * 40)
    for i, b in enumerate(o.beats):
        b.down = 0.9 if i % 2 == 0 else 0.1
    o.activity = [(b.t, 0.0 if i % 4 == 0 else -6.0) for i, b in enumerate(o.beats)]
    a = analyze(o)
    assert [i for i, b in enumerate(a["beats"]) if b[3]] == list(range(0, 41, 4))
    o.activity = [(b.t, 0.0) for b in o.beats]
    assert sum(b[3] for b in analyze(o)["beats"]) == 21


def test_silence():
    o = track([120] * 32)
    o.activity = [(k * 0.05, -60.0 if 2 <= k * 0.05 <= 4 else 0.0) for k in range(int(o.duration / 0.05))]
    a = analyze(o)
    assert "low_activity_beats_rejected" in a["warnings"] and any(c[1] == "rhythm_discontinuity" and abs(c[0] - 3) < 0.1 for c in a["changes"])


def test_lost_transition_beat_comes_back():
    o = track([120] * 20 + [160] * 20)
    del o.beats[22]
    a = analyze(o)
    assert len(a["beats"]) == 41 and "short_transition_beat_grid_recovered" in a["warnings"]


def test_few_beats():
    a = analyze(track([120]))
    assert a["global_bpm"] is None and a["warnings"] == ["too_few_beats_for_tempo_curve"] and len(a["sections"]) == 1


def test_options():
    with pytest.raises(OptionError):
        estimator_policy("default", smoothing_window=4)
    with pytest.raises(OptionError):
        estimator_policy("nope")
    assert math.isclose(DEFAULT.jump_ratio, 0.12)
