"""Audio files as DataFrames, PCM16 WAV files, and ZIP members."""

from __future__ import annotations

import io
import wave
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings taken for audio.
EXTENSIONS = ("aac", "aif", "aiff", "flac", "m4a", "mp3", "ogg", "opus", "wav")
TARGET_RATE = 22_050


class DecodeError(ValueError):
    """A file cannot be decoded here."""


def decode_wav(content: bytes, rate: int = TARGET_RATE) -> tuple[np.ndarray, int]:
    """Mono samples at ``rate`` of a PCM16 WAV file; linear interpolation resamples."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            if w.getsampwidth() != 2:
                raise DecodeError("only 16-bit PCM is supported")
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).astype(np.float32).mean(1) / 32767
            own = w.getframerate()
    except (wave.Error, EOFError) as e:
        raise DecodeError(str(e)) from e
    if own != rate and len(x):
        at = np.arange(int(len(x) * rate / own)) * own / rate
        x = np.interp(at, np.arange(len(x)), x).astype(np.float32)
    return x, rate


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """Mono PCM16: clamped to one, halves rounded away from zero."""
    x = np.clip(np.asarray(samples, np.float64), -1, 1) * 32767
    data = np.copysign(np.floor(np.abs(x) + 0.5), x).astype("<i2").tobytes()
    if len(data) > 0xFFFFFFFF - 36:
        raise ValueError("a WAV file holds 4 GiB at most")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(data)
    return out.getvalue()


def scan_audio(spark: SparkSession, directory: str) -> DataFrame:
    """path, length, sha256, content of the audio files under a directory."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return f.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS)).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def decode_audio(files: DataFrame, rate: int = TARGET_RATE) -> DataFrame:
    """path, sample_rate, samples, error; a file that cannot be decoded keeps its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content):
                try:
                    x, r = decode_wav(content, rate)
                    rows.append((path, r, x.tolist(), None))
                except DecodeError as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "samples", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, samples array<float>, error string")


def inspect_audio(spark: SparkSession, path: str) -> DataFrame:
    """sha256, size_bytes, sample_rate, channels, duration_s, error of audio files: what an external case needs; no path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sha, n, content in zip(b.sha256, b.length, b.content):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rows.append((sha, n, w.getframerate(), w.getnchannels(), w.getnframes() / w.getframerate(), None))
                except (wave.Error, EOFError) as e:
                    rows.append((sha, n, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["sha256", "size_bytes", "sample_rate", "channels", "duration_s", "error"])

    return scan_audio(spark, path).select("sha256", "length", "content").mapInPandas(run, "sha256 string, size_bytes long, sample_rate int, channels int, duration_s double, error string")


def duration_mismatch(truth: DataFrame, audio: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Cases whose audio lasts longer or shorter than their truth by more than ``tolerance`` seconds."""
    seconds = F.size("samples") / F.col("sample_rate")
    return truth.join(audio, "case_id").where(F.abs(seconds - F.col("duration_s")) > tolerance).select("case_id", "duration_s", seconds.alias("audio_s"))


def zip_members(files: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """path, member, size, sha-ready content of stored and deflated members; ZIP64 included.

    ``limit`` bounds a member's size: larger ones keep a null content.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(path, i.filename, i.file_size, z.read(i) if i.file_size <= limit else None) for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["path", "member", "size_bytes", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, size_bytes long, content binary")


def pcm_violations(pcm: DataFrame) -> DataFrame:
    """Rows whose layout is impossible: no rate, no channel, a broken last frame."""
    code = F.when(F.col("sample_rate") <= 0, "no_rate").when(F.col("channels") <= 0, "no_channel").when(F.size("samples") % F.greatest("channels", F.lit(1)) != 0, "broken_frame")
    return pcm.select("track_id", code.alias("code")).where("code IS NOT NULL")
