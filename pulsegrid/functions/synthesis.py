"""Deterministic audio of a beat list, for suites that carry no recordings."""

from __future__ import annotations

import math

import numpy as np

#: Fixed value: what a noise seed is raised by, modulo 2^64.
SEED_STEP = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
# Decays a second, seconds and gains of the sounds.
NOISE_DECAY = 45.0
CLICK = {True: (1760.0, 0.8), False: (1100.0, 0.8)}  # downbeat: hz, gain
KICK = {True: (62.0, 0.9), False: (78.0, 0.65)}
SCALE = (220.0, 246.94, 261.63, 293.66, 329.63, 349.23, 392.0, 440.0)
CHORD = ((1.0, 1.0), (1.25, 0.5), (1.5, 0.35))  # ratio to the root, level
CHORD_GAIN = {True: 0.32, False: 0.22}


def noises(seeds: list[int], n: int) -> np.ndarray:
    """(seeds, n) xorshift64 noise in [-1, 1] from the top 16 bits of each state; all seeds advance side by side."""
    s = np.array([(x + SEED_STEP) & MASK for x in seeds], np.uint64)
    out = np.empty((n, len(seeds)))
    for i in range(n):
        s ^= s << np.uint64(13)
        s ^= s >> np.uint64(7)
        s ^= s << np.uint64(17)
        out[i] = (s >> np.uint64(48)).astype(np.float64) / 65535.0 * 2 - 1
    return out.T


def _place(out: np.ndarray, rate: int, start_s: float, sound: np.ndarray) -> None:
    """Add a sound in place from the sample nearest to ``start_s``, as far as there is room."""
    at = int(math.floor(start_s * rate + 0.5))
    n = min(len(sound), len(out) - at)
    if n > 0:
        out[at : at + n] += sound[:n].astype(np.float32)


def tone(out: np.ndarray, rate: int, start_s: float, hz: float, seconds: float, gain: float, decay: float) -> None:
    """Add a decaying sine in place."""
    t = np.arange(int(seconds * rate)) / rate
    _place(out, rate, start_s, np.sin(2 * np.pi * hz * t) * np.exp(-decay * t) * gain)


def bursts(out: np.ndarray, rate: int, at: list[tuple[float, int]], seconds: float, gain: float) -> None:
    """Add decaying noise in place at (start, seed)."""
    n = int(seconds * rate)
    envelope = np.exp(-NOISE_DECAY * np.arange(n) / rate) * gain
    for (start, _), x in zip(at, noises([seed for _, seed in at], n), strict=True):
        _place(out, rate, start, x * envelope)


def render(beats: list[tuple[float, bool]], duration_s: float, rate: int = 44_100, profile: str = "click") -> np.ndarray:
    """Clicks, percussion or a drumless pulse at the beats, as 32-bit samples that are not limited yet."""
    out = np.zeros(math.ceil(duration_s * rate), np.float32)
    if profile == "click":
        for t, down in beats:
            hz, gain = CLICK[down]
            tone(out, rate, t, hz, 0.035, gain, 80.0)
    elif profile == "percussion":
        for k, (t, down) in enumerate(beats):
            hz, gain = KICK[down]
            tone(out, rate, t, hz, 0.18, gain, 18.0)
            tone(out, rate, t, 220.0 * 2 ** (k % 8 / 12), 0.22, 0.16, 12.0)
        bursts(out, rate, [(t, k) for k, (t, _) in enumerate(beats) if k % 2], 0.12, 0.35)
        between = [((a + b) / 2, k + 10_000) for k, ((a, _), (b, _)) in enumerate(zip(beats, beats[1:])) if b - a < 1.5]
        bursts(out, rate, between, 0.035, 0.12)
    elif profile == "drumless":
        for k, (t, down) in enumerate(beats):
            for ratio, level in CHORD:
                tone(out, rate, t, SCALE[k % len(SCALE)] * ratio, 0.32, CHORD_GAIN[down] * level, 7.0)
    else:
        raise ValueError(f"unknown audio profile {profile!r}")
    return out
