"""Analysis of decoded signals: NumPy kernels, one signal at a time, over Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sonolith.constants import HOP, MAJOR_PROFILE, MINOR_PROFILE, PITCH_NAMES, SAMPLE_RATE, TEMPO_RANGE
from sonolith.functions import kernels as K


def octave_correct(bpm: float) -> float:
    if bpm <= 0:
        return 0.0
    while bpm < TEMPO_RANGE[0]:
        bpm *= 2
    while bpm > TEMPO_RANGE[1]:
        bpm /= 2
    return bpm


def rhythm(s: np.ndarray, mel: np.ndarray | None = None, bands: np.ndarray | None = None) -> dict:
    """Tempo, confidence, beats and downbeats of a spectrogram; mel, bands: its mel_db() and band_energies(), if known."""
    fps, onset = SAMPLE_RATE / HOP, K.onset_strength(s, mel)
    raw, frames = K.beat_track(onset, fps)
    times, bpm = frames / fps, raw
    if len(times) >= 4:
        d = np.diff(times)
        med = float(np.median(d))
        kept = d[np.abs(d - med) < 0.25 * med]
        if med > 0 and len(kept) >= 3:
            bpm = 60 / float(kept.mean())
    bass = (K.band_energies(s) if bands is None else bands)[0]
    energy = np.array([bass[max(0, f - 1) : f + 2].max() for f in np.clip(np.rint(times * fps).astype(int), 0, len(bass) - 1)])
    k = int(np.argmax([energy[j::4].sum() for j in range(4)])) if len(times) >= 4 else 0
    return {"bpm": octave_correct(bpm), "bpm_confidence": K.bpm_confidence(onset), "beats": times, "downbeats": times[k::4], "first_beat": float(times[0]) if len(times) else 0.0}


@K.constant
def key_profiles() -> np.ndarray:
    """The profiles of each pitch, major and minor, less their means and scaled to length 1."""
    rows = np.array([np.roll(profile, p) for p in range(12) for profile in (MAJOR_PROFILE, MINOR_PROFILE)], float)
    rows -= rows.mean(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def key(chroma: np.ndarray) -> dict:
    """Key of mean chroma: the best of 24 profiles by correlation, ties by pitch, then major."""
    mean = chroma.mean(axis=1) if chroma.ndim == 2 else chroma
    if mean.sum() <= 1e-6 or mean.std() <= 1e-6:
        return {"pitch_class": 0, "key_mode": "major", "key_name": "C", "camelot": "8B", "key_confidence": 0.0}
    centred = mean - mean.mean()
    with np.errstate(invalid="ignore", over="ignore"):
        fit = (key_profiles() @ (centred / np.sqrt(centred @ centred))).clip(-1, 1).tolist()
    fits = sorted(((-r, k // 2, k % 2) for k, r in enumerate(fit)), key=lambda f: (round(f[0], 12), f[1], f[2]))
    r1, r2, p, minor = -fits[0][0], -fits[1][0], fits[0][1], fits[0][2]
    code = f"{(p * 7 + (4 if minor else 7)) % 12 + 1}{'A' if minor else 'B'}"
    return {"pitch_class": p, "key_mode": "minor" if minor else "major", "key_name": PITCH_NAMES[p], "camelot": code, "key_confidence": float(np.clip((r1 - r2) / r1, 0, 1)) if r1 > 1e-6 else 0.0}


def labels(energy: list[float]) -> list[str]:
    """Labels of sections by their energies; the rules of operators.structure.label_sections()."""
    e = np.array(energy)
    e = e / e.max() if e.max() > 1e-6 else np.zeros(len(e))
    n, peak, med = len(e), int(np.argmax(e)), float(np.median(e))
    drop = [i == peak or 0 < i < n - 1 and e[i] >= 0.88 for i in range(n)]
    out = []
    for i in range(n):
        if drop[i]:
            out.append("drop")
        elif i in (0, n - 1):
            out.append("intro" if i == 0 else "outro")
        elif drop[i + 1] and e[i] > e[i - 1] or e[i] > med and e[i] > e[i - 1]:
            out.append("build")
        else:
            out.append("breakdown")
    return out


def structure(y: np.ndarray, features: np.ndarray | None = None) -> list[dict]:
    found = K.sections(y, features)
    if len(found) == 1 and found[0][1] <= 4.0:
        return [{"start": 0.0, "end": found[0][1], "label": "intro", "energy": 1.0}]
    top = max(f[2] for f in found)
    named = labels([f[2] for f in found])
    return [{"start": a, "end": b, "label": x, "energy": r / top if top > 1e-6 else 0.0} for (a, b, r), x in zip(found, named, strict=True)]


def describe(y: np.ndarray) -> dict:
    """All features of one signal: rhythm, key, loudness, sections and vectors."""
    s = K.stft(y)
    mel, chroma, bands = K.mel_db(s), K.chroma_of(y), K.band_energies(s)
    f = K.mfcc(s, db=mel)[1:]
    return rhythm(s, mel, bands) | key(chroma) | K.loudness(y) | {"sections": structure(y, np.vstack([f, chroma])), "timbre": np.concatenate([f.mean(axis=1), f.std(axis=1)]), "chroma": chroma.mean(axis=1), "bands": bands.mean(axis=1)}


def outline(y: np.ndarray) -> dict:
    """What the points of a transition depend on: describe()'s rhythm and sections, and the duration."""
    s = K.stft(y)
    mel = K.mel_db(s)
    return rhythm(s, mel) | {"sections": structure(y, np.vstack([K.mfcc(s, db=mel)[1:], K.chroma_of(y)])), "duration": len(y) / SAMPLE_RATE}


class Outline(dict):
    """outline(), with sections that are found when they are first asked for: most of its time goes into them, and points
    of a transition do not always need them."""

    def __init__(self, y: np.ndarray):
        s = K.stft(y)
        mel = K.mel_db(s)
        super().__init__(rhythm(s, mel), duration=len(y) / SAMPLE_RATE)
        self._sections = lambda: structure(y, np.vstack([K.mfcc(s, db=mel)[1:], K.chroma_of(y)]))

    def __missing__(self, name: str) -> list[dict]:
        if name != "sections":
            raise KeyError(name)
        self[name] = self._sections()
        return self[name]


FEATURES = (
    "track_id string, bpm double, bpm_confidence double, first_beat double, beats array<double>, downbeats array<double>, pitch_class int, key_mode string, key_name string, camelot string, key_confidence double, "
    "lufs double, lra double, true_peak double, sections array<struct<start: double, `end`: double, label: string, energy: double>>, timbre array<double>, chroma array<double>, bands array<double>, error string"
)
_SECTION = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("label", pa.string()), ("energy", pa.float64())]))
_KINDS = {"track_id": pa.string(), "pitch_class": pa.int32(), "key_mode": pa.string(), "key_name": pa.string(), "camelot": pa.string(), "sections": _SECTION, "error": pa.string()} | dict.fromkeys(("beats", "downbeats", "timbre", "chroma", "bands"), pa.list_(pa.float64()))


#: Makes batches of signals (track_id, y) of batches of other rows. It runs in the worker that takes the signals, which are
#: large: they do not pass the JVM, value by value, on their way there.
Source = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@functools.lru_cache(maxsize=1)
def keep_memory() -> None:
    """Let this worker keep up to 64 MB of freed memory: arrays of a signal are a few MB each, and to get them from the
    system anew, page by page, takes as long as to fill them."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        return


def analyze(signals: DataFrame, source: Source | None = None, kept: str = "") -> DataFrame:
    """Features of signals (track_id, y), or of those that source makes of the rows: one row each; what cannot be
    analysed has an error and no features. kept: a further column of text that goes along, if it is named."""
    names = [c.split()[0] for c in FEATURES.replace("struct<start: double, `end`: double, label: string, energy: double>", "s").split(", ")]
    also = [kept] if kept else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for batch in source(batches) if source else batches:
            for k in range(batch.num_rows):
                row = dict.fromkeys(names) | {"track_id": batch.column(0)[k].cast(pa.string()).as_py()}
                y = batch.column(1)[k].values
                try:
                    got = describe(np.zeros(0) if y is None else y.to_numpy(zero_copy_only=False))
                    row |= {n: v.tolist() if isinstance(v, np.ndarray) else v for n, v in got.items()} | {"lra": got["range"]}
                except (ValueError, IndexError, FloatingPointError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                with_it = [batch.column(batch.schema.get_field_index(n)).slice(k, 1) for n in also]
                yield pa.RecordBatch.from_arrays([*(pa.array([row[n]], _KINDS.get(n, pa.float64())) for n in names), *with_it], names=names + also)

    rows = signals if source else signals.select("track_id", "y", *also)
    return rows.mapInArrow(run, ", ".join([FEATURES, *(f"{n} string" for n in also)]))


def column(values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    """An Arrow column of numbers, or of lists where values has two dimensions; one that is an Arrow column stays."""
    if isinstance(values, pa.Array):
        return values
    if values.ndim == 1:
        return pa.array(values).cast(kind)
    flat = pa.array(np.ascontiguousarray(values).ravel()).cast(kind.value_type)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


def per_signal(signals: DataFrame, kernel: Callable[[np.ndarray], list[tuple] | tuple[np.ndarray, ...]], schema: str, kinds: list[pa.DataType], source: Source | None = None) -> DataFrame:
    """Rows that a kernel gives, as a list of rows or as a tuple of columns, for each signal (track_id, y), or each that
    source makes of the rows, with the track_id in front."""
    names = ["track_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for batch in source(batches) if source else batches:
            for k in range(batch.num_rows):
                rows = kernel(batch.column(1)[k].values.to_numpy(zero_copy_only=False))
                if isinstance(rows, tuple):
                    columns = [column(c, t) for c, t in zip(rows, kinds, strict=True)]
                else:
                    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), batch.column(0)[k].as_py(), np.int64)), *columns], names=names)

    return (signals if source else signals.select("track_id", "y")).mapInArrow(run, f"track_id long, {schema}")
