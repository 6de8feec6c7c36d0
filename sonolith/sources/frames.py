"""The frame cache: tables of per-frame features at the full frame rate and at five frames a second."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.constants import HOP, SAMPLE_RATE, STRUCTURE_FPS
from sonolith.functions import kernels as K
from sonolith.operators.analysis import Source, column, per_signal

_VECTOR = pa.list_(pa.float32())
#: The columns of each table, and those of both with their Arrow types.
_TABLES = {"frames": ("fr", "t", "band_energy", "rms", "onset_env"), "frames_5hz": ("fr", "t", "chroma", "mfcc")}
_KINDS = {"fr": pa.int32(), "t": pa.float64(), "band_energy": _VECTOR, "rms": pa.float32(), "onset_env": pa.float32(), "chroma": _VECTOR, "mfcc": _VECTOR}
_BOTH = "name string, fr int, t double, band_energy array<float>, rms float, onset_env float, chroma array<float>, mfcc array<float>"


def full_rate(y: np.ndarray, s: np.ndarray | None = None, mel: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """fr, t, band_energy, rms, onset_env of each frame. s, mel: the signal's stft() and its mel_db(), if they are known."""
    s = K.stft(y) if s is None else s
    bands, onset = K.band_energies(s).T.astype(np.float32), K.onset_strength(s, mel)
    rms = K.frame_rms(y)
    n = min(len(bands), len(rms), len(onset))
    return np.arange(n), np.arange(n) * HOP / SAMPLE_RATE, bands[:n], rms[:n], onset[:n]


def slow_rate(y: np.ndarray, s: np.ndarray | None = None, mel: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """fr, t, chroma, mfcc: means over blocks of frames, five a second. s, mel: as in full_rate()."""
    s = K.stft(y) if s is None else s
    factor = max(1, round(SAMPLE_RATE / HOP / STRUCTURE_FPS))
    chroma, mfcc = (K.block_mean(x, factor).T.astype(np.float32) for x in (K.chroma_of(y), K.mfcc(s, db=mel)))
    n = min(len(chroma), len(mfcc))
    return np.arange(n), np.arange(n) * factor * HOP / SAMPLE_RATE, chroma[:n], mfcc[:n]


def both_rates(y: np.ndarray) -> tuple[pa.Array, ...]:
    """name of the table and the columns of both, null in the other's rows, of one spectrogram."""
    s = K.stft(y)
    mel = K.mel_db(s)
    parts = []
    for (name, own), rows in zip(_TABLES.items(), (full_rate(y, s, mel), slow_rate(y, s, mel)), strict=True):
        known = dict(zip(own, rows, strict=True))
        parts.append([pa.array([name] * len(rows[0])), *(column(known[c], t) if c in known else pa.nulls(len(rows[0]), t) for c, t in _KINDS.items())])
    return tuple(pa.concat_arrays(c) for c in zip(*parts, strict=True))


def frames(signals: DataFrame, source: Source | None = None) -> DataFrame:
    """track_id, fr, t, band_energy, rms, onset_env of signals (track_id, y), or of those that source makes."""
    return per_signal(signals, full_rate, "fr int, t double, band_energy array<float>, rms float, onset_env float", [pa.int32(), pa.float64(), _VECTOR, pa.float32(), pa.float32()], source)


def frames_5hz(signals: DataFrame, source: Source | None = None) -> DataFrame:
    """track_id, fr, t, chroma, mfcc of signals (track_id, y), or of those that source makes."""
    return per_signal(signals, slow_rate, "fr int, t double, chroma array<float>, mfcc array<float>", [pa.int32(), pa.float64(), _VECTOR, _VECTOR], source)


def write_cache(signals: DataFrame, folder: str, source: Source | None = None) -> None:
    """Both tables, as Parquet below a folder that driver and executors share, in one pass over the signals; what was there
    is replaced."""
    both = per_signal(signals, both_rates, _BOTH, [pa.string(), *_KINDS.values()], source)
    both.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("name").parquet(f"{folder}/cache")


def read_cache(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The tables frames() and frames_5hz() that write_cache() wrote."""
    both = spark.read.schema(f"track_id long, {_BOTH}").parquet(f"{folder}/cache")
    return tuple(both.where(F.col("name") == name).select("track_id", *own) for name, own in _TABLES.items())
