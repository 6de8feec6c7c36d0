import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.constants import SAMPLE_RATE
from sonolith.operators import analysis as A
from sonolith.operators import catalog as C
from sonolith.sources import audio as S


def test_names(spark):
    cases = {"Artist - Title": ("Artist", "Title"), "A — B": ("A", "B"), "A – B - C": ("A – B", "C"), "plain": (None, "plain"), " - x": (None, "x"), "a - ": ("a", None)}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", C.split_name(F.col("n")).alias("s"))
    got = {r.n: (r.s.artist, r.s.title) for r in df.collect()}
    assert got["Artist - Title"] == ("Artist", "Title") and got["A — B"] == ("A", "B") and got["A – B - C"] == ("A – B", "C") and got["plain"] == (None, "plain") and got[" - x"] == (None, "x")


def test_quick_hash(spark):
    chunk = 1 << 20
    body = bytes(np.random.default_rng(0).integers(0, 256, int(2.5 * chunk), np.uint8))
    middle = bytearray(body)
    middle[int(1.25 * chunk)] ^= 255
    first = bytearray(body)
    first[0] ^= 255
    rows = [(0, body), (1, bytes(middle)), (2, bytes(first)), (3, b"x" * 1028)]
    h = {r.k: r.h for r in spark.createDataFrame(rows, "k int, c binary").select("k", C.quick_hash(F.col("c")).alias("h")).collect()}
    assert h[0] == h[1] != h[2] and h[3] == hashlib.sha256(b"x" * 1028 + b"1028").hexdigest()
    assert h[0] == hashlib.sha256(body[:chunk] + body[-chunk:] + str(len(body)).encode()).hexdigest()


def test_upsert(spark):
    schema = "file_path string, file_hash string, title string, artist string, album string, duration_sec float, sample_rate int"
    old = [("a", "1", "t", None, None, 1.5, 44100), ("b", "1", "t", "x", None, 1.5, 44100), ("c", "1", "t", None, None, None, 1), ("gone", "1", "t", None, None, 1.0, 1)]
    new = [("a", "1", "t", None, None, 1.5, 44100), ("b", "1", "t", "y", None, 1.5, 44100), ("c", "2", "u", None, None, None, 1), ("d", "1", "t", None, None, 1.0, 1)]
    existing = spark.createDataFrame(old, schema).withColumn("analyzed_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.file_path: r for r in C.upsert(existing, spark.createDataFrame(new, schema)).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "UNCHANGED", "b": "METADATA_UPDATED", "c": "HASH_CHANGED", "d": "INSERTED", "gone": "ABSENT"}
    assert got["c"].analyzed_at is None and got["b"].analyzed_at is not None and got["b"].artist == "y"


def test_files(spark, tmp_path):
    t = np.arange(SAMPLE_RATE) / SAMPLE_RATE
    (tmp_path / "sub").mkdir()
    (tmp_path / "Eric - Opus.wav").write_bytes(S.encode_wav(0.5 * np.sin(2 * np.pi * 880 * t)))
    (tmp_path / "sub" / "t2.WAV").write_bytes(S.encode_wav(np.column_stack([np.sin(2 * np.pi * 440 * t), np.sin(2 * np.pi * 880 * t)]) / 2, 44100, 2))
    (tmp_path / "sub" / "t3.flac").write_bytes(b"RIFFbogus")
    (tmp_path / "readme.txt").write_text("no")
    files = S.audio_files(spark, str(tmp_path))
    assert files.count() == 3
    rows = {r.file_path.rpartition("/")[2].replace("%20", " "): r for r in S.scan(files).collect()}
    opus = rows["Eric - Opus.wav"]
    assert (opus.artist, opus.title, opus.duration_sec, opus.error) == ("Eric", "Opus", 1.0, None)
    assert rows["t3.flac"].error and rows["t3.flac"].file_hash and rows["t2.WAV"].sample_rate == 44100
    signals = S.signals(files)
    assert signals.where("y IS NULL").count() == 1
    out = A.analyze(signals).collect()
    assert len(out) == 3 and sum(r.error is None for r in out) == 2
    assert len(next(r for r in out if r.error is None).timbre) == 38


def test_wav_and_lights_round_trip():
    y = np.random.default_rng(1).uniform(-1, 1, 1000)
    for width, error in ((2, 1e-4), (3, 1e-6)):
        assert np.abs(S.decode_wav(S.encode_wav(y, SAMPLE_RATE, width)) - y).max() < error
    with pytest.raises(S.UnsupportedAudio):
        S.decode_wav(b"ID3 something")
    frames = np.random.default_rng(2).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    content = S.encode_lights(frames)
    assert content[:4] == b"WVLT" and len(content) == 16 + 7 * 5 * 3 and struct.unpack("<I", content[12:16])[0] == 7
    fps, back = S.decode_lights(content)
    assert fps == 60 and (back == frames).all()


def test_resampling_keeps_a_tone():
    t = np.arange(44100) / 44100
    y = S.resample(np.sin(2 * np.pi * 440 * t), 44100, SAMPLE_RATE)
    want = np.sin(2 * np.pi * 440 * np.arange(SAMPLE_RATE) / SAMPLE_RATE)
    assert len(y) == SAMPLE_RATE and np.abs(y - want)[100:-100].max() < 0.01


def test_migrations(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lib")
    assert S.migrate(spark, "lib") == list(S.MIGRATIONS) and S.migrate(spark, "lib") == []
    found = S.check_catalog(spark, "lib")
    assert found["ok"] and set(found["tables"]) == {"schema_versions", *(v[4:] for v in S.MIGRATIONS)}
    spark.sql("DROP DATABASE lib CASCADE")
