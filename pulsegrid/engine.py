"""Library surface: observations from PCM through a backend, analyses from observations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import signal
from pulsegrid.options import ANALYSIS_SCHEMA_VERSION, EstimatorOptions
from pulsegrid.plans import analysis


class Backend(Protocol):
    """Turns mono samples into (time_s, confidence, downbeat_confidence) rows; runs on executors."""

    def observe(self, samples: np.ndarray, sample_rate: int) -> list[tuple[float, float, float]]: ...


class OnsetBackend:
    """A backend without a model: energy rises picked as beats. For tests and synthetic audio."""

    def observe(self, samples: np.ndarray, sample_rate: int) -> list[tuple[float, float, float]]:
        hop = max(1, sample_rate // 100)
        n = len(samples) // hop
        energy = np.sqrt((samples[: n * hop].reshape(n, hop) ** 2).mean(1))
        rise = np.diff(energy, prepend=0)
        top = rise.max() if n else 0
        at = [i for i in range(n) if top > 0 and rise[i] > 0.2 * top and rise[i] == rise[max(0, i - 8) : i + 9].max()]
        return [(i * hop / sample_rate, float(min(rise[i] / top, 1)), 0.1) for i in at]


class Engine:
    """``Engine(backend, options)``: DataFrames in, DataFrames out, one group per track."""

    schema_version = ANALYSIS_SCHEMA_VERSION

    def __init__(self, backend: Backend, options: str | EstimatorOptions = "default"):
        self.backend, self.options = backend, options

    def observe_pcm(self, pcm: DataFrame) -> DataFrame:
        """(track_id, sample_rate, channels, samples) to beat rows with the track's duration."""
        backend = self.backend

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for track, rate, channels, samples in zip(b.track_id, b.sample_rate, b.channels, b.samples):
                    if rate <= 0 or channels <= 0 or len(samples) % channels:
                        raise ValueError(f"track {track}: broken PCM layout")
                    x = np.asarray(samples, np.float32).reshape(-1, channels).sum(1, dtype=np.float32) / np.float32(channels)
                    rows += [(track, len(x) / rate, *o) for o in backend.observe(x, rate)]
                yield pd.DataFrame(rows, columns=["track_id", "duration_s", "time_s", "confidence", "downbeat_confidence"])

        return pcm.select("track_id", "sample_rate", "channels", "samples").mapInPandas(run, "track_id long, duration_s double, time_s double, confidence double, downbeat_confidence double")

    def analyze_observations(self, beats: DataFrame, strict: bool = False) -> DataFrame:
        return analysis.analyze_tracks(beats, self.options, strict)

    def analyze_pcm(self, pcm: DataFrame) -> DataFrame:
        return self.analyze_observations(self.observe_pcm(pcm))


def analyze_timing(beats: DataFrame, downbeats: DataFrame, tracks: DataFrame, options: str | EstimatorOptions = "default") -> DataFrame:
    """Host-supplied times: confidence 1, a downbeat where one lies within 0.07 s."""
    b = signal.with_downbeats(beats.select("track_id", "time_s"), downbeats)
    b = b.join(tracks, "track_id").select("track_id", "duration_s", "time_s", F.lit(1.0).alias("confidence"), F.when(F.col("downbeat"), 1.0).otherwise(0.0).alias("downbeat_confidence"))
    return analysis.analyze_tracks(b, options)
