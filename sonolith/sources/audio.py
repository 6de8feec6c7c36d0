"""Reading and writing audio and light files; catalogue introspection and schema versions."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.constants import LIGHT_FPS, QUICK_HASH_BYTES, SAMPLE_RATE
from sonolith.operators.analysis import Source
from sonolith.operators.catalog import is_audio, quick_hash, split_name, stem, track_id


class UnsupportedAudio(ValueError):
    """The content is no PCM WAV; other formats need decoders that are not part of this library."""


def decode_wav(content: bytes, rate: int = SAMPLE_RATE) -> np.ndarray:
    """Mono float signal at `rate`: channels are averaged, other rates are resampled by a windowed sinc."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            channels, width, own, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        raise UnsupportedAudio(str(e)) from e
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = high_bytes(b) / float(1 << 31)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    if channels > 1:
        x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
    return resample(x, own, rate).astype(np.float32)


def high_bytes(b: np.ndarray) -> np.ndarray:
    """Integers of four bytes, the lowest of them zero, of samples of three."""
    wide = np.zeros((len(b), 4), np.uint8)
    for k in range(3):
        wide[:, k + 1] = b[:, k]
    return wide.view("<i4")[:, 0]


def resample(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    if own == rate or not len(x):
        return x
    ratio, reach = min(1.0, rate / own), 32
    at = np.arange(round(len(x) * rate / own)) * own / rate
    padded, out = np.pad(x, reach + 1), np.zeros(len(at))
    base = np.floor(at).astype(int)
    for d in range(-reach + 1, reach + 1):
        t = base + d - at
        out += padded[base + d + reach + 1] * np.sinc(t * ratio) * ratio * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / reach, -1, 1)))
    return out


def encode_wav(y: np.ndarray, rate: int = SAMPLE_RATE, width: int = 3) -> bytes:
    """PCM WAV of 2 or 3 bytes a sample, clipped at full scale; y: samples, or (samples, channels)."""
    y = np.atleast_2d(np.asarray(y, float).T).T
    top = (1 << (8 * width - 1)) - 1
    x = np.rint(np.clip(y, -1, 1) * top).astype("<i4")
    parts, kept = x.reshape(-1, 1).view(np.uint8), np.empty((x.size, width), np.uint8)
    for k in range(width):  # a byte of all samples at a time: of few bytes each, copies of samples take longer
        kept[:, k] = parts[:, k]
    raw = kept.tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(y.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()


def encode_lights(frames: np.ndarray, fps: int = LIGHT_FPS) -> bytes:
    """A light file: 16 bytes (WVLT, version 1, fps, pixels, frames), then the RGB bytes of each frame."""
    n, pixels, _ = frames.shape
    return b"WVLT" + struct.pack("<HHII", 1, fps, pixels, n) + frames.astype(np.uint8).tobytes()


def decode_lights(content: bytes) -> tuple[int, np.ndarray]:
    mark, version, fps, pixels, n = struct.unpack("<4sHHII", content[:16])
    if mark != b"WVLT" or version != 1:
        raise ValueError("no light file")
    return fps, np.frombuffer(content[16:], np.uint8).reshape(n, pixels, 3)


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of the audio files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(is_audio(F.col("path"))).select("path", "length", "content")


def write_files(signals: DataFrame, folder: str, source: Source | None = None) -> DataFrame:
    """Write each signal (track_id, y), or each that source makes of the rows, as folder/track_id.wav from the executors;
    path, samples of each. A task that runs again writes the same files. folder: a URI that driver and executors share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in source(batches) if source else batches:
            for k in range(batch.num_rows):  # one signal at a time: they are large
                path, y = f"{batch.column(0)[k].as_py()}.wav", batch.column(1)[k].values.to_numpy(zero_copy_only=False)
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write(encode_wav(y))
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([len(y)], pa.int64())], names=["path", "samples"])

    return (signals if source else signals.select("track_id", "y")).mapInArrow(run, "path string, samples long")


def scan(files: DataFrame) -> DataFrame:
    """Catalogue rows of audio files: id, file_path, file_hash, artist, title, duration_sec, sample_rate, error. What
    cannot be read is kept with its error, and does not stop the scan."""
    named = files.select(track_id(F.col("path")).alias("id"), F.col("path").alias("file_path"), quick_hash(F.col("content"), QUICK_HASH_BYTES).alias("file_hash"), split_name(stem(F.regexp_replace("path", "%20", " "))).alias("s"), "content")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            info = []
            for content in batch.column(batch.schema.get_field_index("content")).to_pylist():
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        info.append((round(w.getnframes() / w.getframerate(), 3), w.getframerate(), None))
                except (wave.Error, EOFError, ZeroDivisionError) as e:
                    info.append((None, None, f"{type(e).__name__}: {e}"))
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "content"]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array([x[i] for x in info], t) for i, t in enumerate((pa.float64(), pa.int32(), pa.string())))], names=[*(n for n in batch.schema.names if n != "content"), "duration_sec", "sample_rate", "error"])

    flat = named.select("id", "file_path", "file_hash", "s.artist", "s.title", "content")
    return flat.mapInArrow(read, "id string, file_path string, file_hash string, artist string, title string, duration_sec double, sample_rate int, error string")


def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """track_id, y, error of files (track_id, content), and their further columns; y is null where the content cannot be
    decoded."""
    for batch in batches:
        for k in range(batch.num_rows):  # one signal at a time: they are large
            y, error = None, None
            try:
                y = decode_wav(batch.column(1)[k].as_py())
            except UnsupportedAudio as e:
                error = str(e) or "no PCM WAV"
            also = [c.slice(k, 1) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([y], pa.list_(pa.float32())), pa.array([error], pa.string()), *also], names=["track_id", "y", "error", *batch.schema.names[2:]])


def contents(files: DataFrame) -> DataFrame:
    """track_id, content of files (path, content): what decoded() takes."""
    return files.select(track_id(F.col("path")).alias("track_id"), "content")


def signals(files: DataFrame) -> DataFrame:
    """track_id, y, error: decoded signals; y is null where the content cannot be decoded."""
    return contents(files).mapInArrow(decoded, "track_id string, y array<float>, error string")


# The tables of the catalogue, in the order of their versions.
MIGRATIONS = {
    "001_tracks": "id STRING, file_path STRING, file_hash STRING, title STRING, artist STRING, album STRING, duration_sec FLOAT, sample_rate INT, added_at TIMESTAMP, analyzed_at TIMESTAMP, analysis_version INT",
    "002_track_features": "track_id STRING, bpm FLOAT, bpm_confidence FLOAT, first_beat FLOAT, pitch_class INT, key_mode STRING, camelot STRING, key_confidence FLOAT, lufs FLOAT, lra FLOAT, true_peak FLOAT, timbre_vec ARRAY<FLOAT>, chroma_vec ARRAY<FLOAT>, band_vec ARRAY<FLOAT>, sections ARRAY<STRUCT<start: DOUBLE, `end`: DOUBLE, label: STRING, energy: DOUBLE>>",
    "003_sets": "id STRING, name STRING, created_at TIMESTAMP",
    "004_set_items": "set_id STRING, position INT, track_id STRING, transition STRUCT<type: STRING, out_at: DOUBLE, in_at: DOUBLE, bars: INT, bpm_target: DOUBLE, eq: STRING>",
    "005_light_presets": "id STRING, name STRING, rules STRING",
    "006_feature_stats": "id INT, mean ARRAY<FLOAT>, std ARRAY<FLOAT>, n BIGINT",
    "007_jobs": "id STRING, kind STRING, status STRING, payload STRING, progress FLOAT, error STRING",
}


def migrate(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the tables that are missing; returns the versions applied now."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.schema_versions (version STRING) USING parquet")
    done = {r["version"] for r in spark.table(f"{database}.schema_versions").collect()}
    fresh = [v for v in MIGRATIONS if v not in done]
    for v in fresh:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{v[4:]} ({MIGRATIONS[v]}) USING parquet")
        spark.createDataFrame([(v,)], "version string").write.insertInto(f"{database}.schema_versions")
    return fresh


def check_catalog(spark: SparkSession, database: str = "default") -> dict:
    """Whether the catalogue answers, and its tables by name."""
    return {"ok": spark.sql("SELECT 1").first()[0] == 1, "version": spark.version, "tables": sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)}
