"""Invariants of the signal kernels on synthesised signals."""

import numpy as np
import pytest

from sonolith.constants import BAND_NAMES, SAMPLE_RATE
from sonolith.functions import kernels as K
from sonolith.operators import analysis as A

T = np.arange(int(1.5 * SAMPLE_RATE)) / SAMPLE_RATE


def sine(f, amp=0.7, seconds=1.5):
    return amp * np.sin(2 * np.pi * f * np.arange(int(seconds * SAMPLE_RATE)) / SAMPLE_RATE)


def metronome(bpm=120, seconds=8):
    y, n = np.zeros(seconds * SAMPLE_RATE), int(0.02 * SAMPLE_RATE)
    t = np.arange(n) / SAMPLE_RATE
    click = np.hanning(n) * (np.sin(2 * np.pi * 150 * t) + np.sin(2 * np.pi * 1200 * t)) / 2
    for k in range(int(seconds * bpm / 60)):
        at = int(k * 60 / bpm * SAMPLE_RATE)
        y[at : at + n] += click[: len(y) - at]
    return y


def test_stft_is_the_dft_of_windowed_frames():
    y = np.random.default_rng(1).normal(size=5000)
    s = K.stft(y)
    assert s.shape == (1025, 1 + len(y) // 512)
    frame = np.pad(y, 1024)[512 * 3 : 512 * 3 + 2048] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2048) / 2048))
    for k in (0, 7, 500, 1024):
        assert abs(s[k, 3] - abs((frame * np.exp(-2j * np.pi * k * np.arange(2048) / 2048)).sum())) < 1e-6


def test_sine_and_noise():
    f = K.spectral_features(sine(440))
    assert 425 < f["centroid"][5:-5].mean() < 455 and f["flatness"][5:-5].mean() < 0.01
    assert f["mfcc"].shape == (20, f["stft"].shape[1]) and f["contrast"].shape[0] == 7 and len(f["zcr"]) == f["stft"].shape[1]
    noise = np.random.default_rng(42).uniform(-1, 1, len(T))
    assert K.spectral_features(noise)["flatness"].mean() > 0.5
    for bad in (np.zeros(0), np.zeros((2, 100))):
        with pytest.raises(ValueError):
            K.spectral_features(bad)


@pytest.mark.parametrize("band,freq", list(enumerate((50, 100, 250, 600, 1600, 3500, 6500, 9500))))
def test_bands(band, freq):
    e = K.band_energies(K.stft(sine(freq, 0.8, 1)))
    assert e.mean(axis=1).argmax() == band and len(e) == len(BAND_NAMES) and e.max() <= 0


def test_band_filters_and_silence():
    f = K.band_filters()
    assert f.shape == (8, 1025) and (f.sum(axis=1) >= 4).all() and f[:, 0].sum() == 0
    assert f.sum(axis=1).astype(int).tolist() == [4, 8, 24, 55, 140, 232, 279, 278]
    e = K.band_energies(np.zeros((1025, 50)))
    assert (e == -80).all()
    assert np.allclose(K.smooth(np.array([[3.0, 6, 9]]), 3), [[4, 6, 8]])
    with pytest.raises(ValueError):
        K.band_energies(np.zeros((5, 5)))


def test_metronome():
    r = A.rhythm(K.stft(metronome()))
    assert abs(r["bpm"] - 120) < 0.5 and r["bpm_confidence"] > 0.5 and 14 <= len(r["beats"]) <= 18
    assert abs(np.diff(r["beats"]).mean() - 0.5) < 0.03 and len(r["downbeats"]) >= 3


def test_drone_has_no_tempo():
    assert A.rhythm(K.stft(sine(440, 0.5, 4)))["bpm_confidence"] < 0.5


def test_octaves():
    got = [A.octave_correct(b) for b in (120, 128, 70, 180, 60, 64, 32.5, 190, 240, 350, 400, 0, -10)]
    assert got == [120, 128, 70, 180, 120, 128, 130, 95, 120, 175, 100, 0, 0]


@pytest.mark.parametrize("notes,name,mode,code", [((261.63, 329.63, 392.0), "C", "major", "8B"), ((220.0, 261.63, 329.63), "A", "minor", "8A"), ((369.99, 466.16, 554.37), "F#", "major", "2B")])
def test_keys(notes, name, mode, code):
    k = A.key(K.chroma_of(sum(sine(f, 0.3, 3) for f in notes)))
    assert (k["key_name"], k["key_mode"], k["camelot"]) == (name, mode, code) and k["key_confidence"] > 0.1


def test_silence_has_no_key():
    assert A.key(K.chroma_of(np.zeros(2 * SAMPLE_RATE)))["key_confidence"] == 0


def test_loudness():
    loud = K.loudness(sine(440, 0.99, 3))
    assert abs(loud["true_peak"] + 0.1) < 0.5 and -6 <= loud["lufs"] <= -2 and loud["range"] >= 0
    still = K.loudness(np.zeros(2 * SAMPLE_RATE))
    assert still["lufs"] <= -60 and still["true_peak"] <= -70
    assert abs(K.true_peak(sine(1000, 0.5, 1)) + 6.02) < 0.2 and K.true_peak(np.zeros(0)) == -80
    assert K.loudness(sine(440, 0.9, 0.2))["lufs"] == -70


def test_blocks_and_segments():
    x = np.ones((32, 80))
    x[:, :8] = 2
    b = K.block_mean(x, 8)
    assert b.shape == (32, 10) and (b[:, 0] == 2).all() and (b[:, 1:] == 1).all()
    parts = np.concatenate([np.zeros((3, 10)), np.ones((3, 7)), 5 * np.ones((3, 12))], axis=1)
    assert K.ward_chain(parts, 3).tolist() == [0, 10, 17]


def test_sections():
    t = np.arange(26 * SAMPLE_RATE) / SAMPLE_RATE
    mix = 0.7 * np.sin(2 * np.pi * 55 * t) + 0.2 * np.sin(2 * np.pi * 110 * t) + 0.1 * np.sin(2 * np.pi * 440 * t)
    y = np.where(t < 8, 0.15 * np.sin(2 * np.pi * 220 * t), np.where(t < 18, mix, 0.1 * np.sin(2 * np.pi * 330 * t)))
    s = A.structure(y)
    assert len(s) >= 3 and s[0]["start"] == 0 and abs(s[-1]["end"] - 26) < 1e-6
    assert all(a["end"] == b["start"] for a, b in zip(s[:-1], s[1:], strict=True))
    top = max(range(len(s)), key=lambda i: s[i]["energy"])
    assert 0 < top < len(s) - 1 and s[top]["label"] == "drop" and 6 <= s[top]["start"] and s[top]["end"] <= 20
    assert s[0]["label"] == "intro" and s[-1]["label"] == "outro" and s[0]["energy"] < 0.5 > s[-1]["energy"]
    short = A.structure(sine(440, 0.5, 2))
    assert [(x["start"], x["label"]) for x in short] == [(0.0, "intro")]


def test_crossover_sums_flat():
    y = np.random.default_rng(3).normal(size=1 << 15)
    low, high = K.split_bands(y)
    gain = np.abs(np.fft.rfft(low + high)) / np.abs(np.fft.rfft(y))
    assert abs(np.median(gain) - 1) < 0.02
    assert (low**2).mean() < 0.1 * (y**2).mean()


def test_bass_swap_leaves_one_bass():
    a, b = sine(60, 0.5, 3), sine(90, 0.5, 3)
    out = K.bass_swap(a, b, len(a) // 2, 2000)
    half = len(a) // 2
    spectrum = lambda x: np.abs(np.fft.rfft(x * np.hanning(len(x))))
    first, second = spectrum(out[4000 : half - 4000]), spectrum(out[half + 6000 : -4000])
    at = lambda s, f, n: s[round(f * n / SAMPLE_RATE)]
    n1, n2 = half - 8000, len(a) - half - 10000
    assert at(first, 60, n1) > 10 * at(first, 90, n1) and at(second, 90, n2) > 10 * at(second, 60, n2)


def test_stretch_keeps_pitch():
    y = K.time_stretch(sine(440, 0.5, 3), 1.06)
    assert abs(len(y) - 3 * SAMPLE_RATE / 1.06) <= 1
    assert abs(K.spectral_features(y)["centroid"][20:-20].mean() - 440) < 20
