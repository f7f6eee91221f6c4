"""Estimator and decoder policies."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

ANALYSIS_SCHEMA_VERSION = 1
#: ln(1.12), ln(1.03) and ln(1.01) as log1p gives them.
LN_JUMP, LN_CONSTANT, LN_TRUTH_JUMP = math.log1p(0.12), math.log1p(0.03), math.log1p(0.01)


class OptionError(ValueError):
    """An option is out of range."""


@dataclass(frozen=True)
class EstimatorOptions:
    """Policy of the tempo estimator. Fixed default values."""

    min_bpm: float = 40.0
    max_bpm: float = 320.0
    preferred_min_bpm: float = 70.0
    preferred_max_bpm: float = 180.0
    smoothing_window: int = 7
    max_metrical_outlier_run: int = 1
    jump_ratio: float = 0.12
    constant_ratio: float = 0.03
    curve_tolerance_octaves: float = 0.04
    discontinuity_factor: float = 3.5
    silence_threshold_db: float = -40.0
    min_silence_s: float = 0.8
    half_time_min_bpm: float = 150.0
    half_time_salience_ratio: float = 1.35
    half_bar_downbeat_salience_ratio: float = 1.2
    jump_transition_max_s: float = 4.0
    sequence_phase: bool = False

    def __post_init__(self):
        if not (math.isfinite(self.min_bpm) and math.isfinite(self.max_bpm) and 0 < self.min_bpm < self.max_bpm):
            raise OptionError("BPM bounds must be finite, positive and ascending")
        if self.smoothing_window <= 0 or self.smoothing_window % 2 == 0:
            raise OptionError("the smoothing window must be odd and positive")
        if self.max_metrical_outlier_run < 1:
            raise OptionError("an outlier run has one interval at least")
        if not (math.isfinite(self.silence_threshold_db) and self.silence_threshold_db < 0):
            raise OptionError("the silence threshold must be below 0 dB")
        for name in ("half_time_salience_ratio", "half_bar_downbeat_salience_ratio"):
            if not getattr(self, name) > 1:
                raise OptionError(f"{name} must be above 1")
        for name in ("min_silence_s", "half_time_min_bpm", "jump_transition_max_s"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) > 0):
                raise OptionError(f"{name} must be positive")


ESTIMATOR_POLICIES = {
    "default": EstimatorOptions(),
    "metrical-consistency-v1": EstimatorOptions(max_metrical_outlier_run=3),
    "sequence-phase-v1": EstimatorOptions(max_metrical_outlier_run=3, sequence_phase=True),
}


def estimator_policy(name: str, **changes) -> EstimatorOptions:
    if name not in ESTIMATOR_POLICIES:
        raise OptionError(f"unknown estimator policy {name!r}")
    return replace(ESTIMATOR_POLICIES[name], **changes)


@dataclass(frozen=True)
class MidpointOptions:
    """Recovery of peaks half-way inside gaps: how near the middle, how many neighbours must agree."""

    max_ratio: float = 0.15
    radius: int = 2
    min_support: int = 3

    def __post_init__(self):
        if not (0 < self.max_ratio < 0.5):
            raise OptionError("the midpoint ratio must lie between 0 and one half")
        if self.radius < 1 or not 1 <= self.min_support <= 2 * self.radius + 1:
            raise OptionError("midpoint support must fit its neighbourhood")


#: Decoder policies: id, peak radius in frames, logit threshold, whether supported midpoints are added.
DECODER_POLICIES = (
    ("radius3-logit-0", 3, 0.0, False),
    ("radius3-logit-minus-0.5", 3, -0.5, False),
    ("radius3-logit-minus-1", 3, -1.0, False),
    ("radius3-logit-minus-2", 3, -2.0, False),
    ("radius3-logit-minus-3", 3, -3.0, False),
    ("radius1-logit-0", 1, 0.0, False),
    ("radius1-logit-minus-1", 1, -1.0, False),
    ("radius1-logit-minus-2", 1, -2.0, False),
    ("radius1-logit-minus-3", 1, -3.0, False),
    ("supported-midpoint", 3, 0.0, True),
)
