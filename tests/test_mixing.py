"""Strategies of a mix, the frame cache, files to features, and settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.config import Settings
from sonolith.constants import HOP, SAMPLE_RATE
from sonolith.functions import kernels as K
from sonolith.operators import strategies as S
from sonolith.plans import audio as P
from sonolith.sources import frames as C

DIR = "/root/testdata/sf0.001"


def track(duration=200.0, bpm=120.0, sections=((0, "intro"), (30, "drop"), (150, "outro")), downbeats=None):
    downs = np.arange(0, duration, 2.0) if downbeats is None else downbeats
    return {"duration": duration, "bpm": bpm, "downbeats": downs, "sections": [{"start": float(a), "label": x} for a, x in sections]}


def test_points():
    plan = S.points(track(), track())
    assert (plan.out_at, plan.in_at, plan.beats, plan.seconds) == (150.0, 0.0, 32, 16.0)
    assert plan.swap_at == 10.0  # the downbeat nearest to 58 % of 16 s (9.28) among those in 8 to 10.56
    late = S.points(track(sections=((0, "intro"), (188, "outro"))), track())
    assert (late.out_at, late.beats) == (188.0, 16)
    none = S.points(track(sections=((0, "intro"),)), track())
    assert (none.out_at, none.beats, none.seconds) == (192.0, 16, 8.0)
    off = S.points(track(sections=((0, "intro"), (151.2, "outro"))), track())
    assert off.out_at == 152.0
    drop = S.points(track(), track(sections=((0, "intro"), (9, "drop"))))
    assert drop.swap_at == 9.0
    still = S.points(track(bpm=0.0, sections=(), downbeats=[]), track(bpm=0.0, sections=(), downbeats=[]))
    assert still.beats == 16 and still.in_at == 0.0 and still.seconds == 8.0
    short = S.points(track(duration=3.0, sections=()), track(duration=3.0, sections=()))
    assert 1 <= short.beats <= 16 and short.out_at + short.seconds <= 3.0 + 1e-9


def test_swap_removes_double_bass():
    t = np.arange(10 * SAMPLE_RATE) / SAMPLE_RATE
    a, b = (np.sin(2 * np.pi * f * t) for f in (60, 80))
    plan = S.Plan(0.0, 0.0, 16, 8.0, 4.0, 0.5)
    swap, plain = (S.bass_overlap(*s.voices(a, b, plan)) for s in (S.EqSwapCrossfade(), S.SimpleCrossfade()))
    assert swap < 0.7 < 5 < plain
    x, y = K.swap_voices(a[: 8 * SAMPLE_RATE], b[: 8 * SAMPLE_RATE], 4 * SAMPLE_RATE, SAMPLE_RATE // 2)
    assert np.allclose(S.EqSwapCrossfade().render(a, b, plan), x + y)
    assert S.bass_overlap(np.zeros(0), a) == 0.0 == S.bass_overlap(np.zeros(5000), np.zeros(5000))


def test_cache(spark, tmp_path):
    y = P.synth(3)
    C.write_cache(spark.createDataFrame([(3, y.tolist())], "track_id long, y array<float>"), f"file://{tmp_path}")
    full, slow = C.read_cache(spark, f"file://{tmp_path}")
    rows = full.orderBy("fr").collect()
    s = K.stft(y)
    assert len(rows) == s.shape[1] == 1 + len(y) // HOP
    assert np.allclose(np.array([r.band_energy for r in rows]).T, K.band_energies(s), atol=1e-3)
    assert np.allclose([r.onset_env for r in rows], K.onset_strength(s), rtol=1e-4, atol=1e-3)
    frame = np.pad(y.astype(float), 1024)[HOP * 9 : HOP * 9 + 2048]
    assert rows[9].rms == pytest.approx(np.sqrt((frame**2).mean()), rel=1e-4)
    less = slow.orderBy("fr").collect()
    assert len(less) == s.shape[1] // 9 and len(less[0].mfcc) == 20 and len(less[0].chroma) == 12
    assert np.allclose(less[2].mfcc, K.mfcc(s)[:, 18:27].mean(axis=1), atol=1e-2)


def test_files_agree_with_signals(spark):
    got = {r.file.split(".")[0]: r for r in P.analyze_files(spark, DIR).collect()}
    want = {r.track_id: r for r in P.analyze_tracks(spark, DIR).collect()}
    assert set(got) == set(want) and all(r.error is None for r in got.values())
    same = sum(abs(got[k].lufs - want[k].lufs) < 0.05 and got[k].camelot == want[k].camelot for k in want)
    assert same == len(want)


def test_bass_check(spark):
    rows = P.bass_check(spark, DIR).agg(F.count(F.lit(1)).alias("n"), F.sum("overlap_sec").alias("a"), F.sum("plain_sec").alias("b")).first()
    assert rows.n > 0 and rows.a < rows.b


def test_settings():
    assert Settings.load({}) == Settings()
    assert Settings.load({"SONOLITH_CACHE": "/c", "SONOLITH_MIXES": "", "SONOLITH_OTHER": "x"}) == Settings(cache="/c")
