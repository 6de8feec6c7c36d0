"""How the audio queries deal their signals to tasks, and kernels against their plain forms."""

import resource
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions import kernels as K
from sonolith.operators import analysis as A
from sonolith.operators import strategies
from sonolith.plans import audio
from sonolith.sources import frames
from sonolith.sources.audio import decode_wav, encode_wav

SF = "/root/testdata/sf0.01"
KERNELS = ("analyze_tracks", "mix_points", "bass_check", "loudness_measures", "chroma_frames", "segment_ward", "render_transition", "spectral_frames", "contrast", "mfcc")
TABLES = ("analyze_files", "frame_cache")


@pytest.mark.parametrize("name", KERNELS)
def test_signals_are_many_tasks_and_do_not_pass_the_jvm(spark, name):
    df = audio.QUERIES[name](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    keys = audio._tracks(spark, SF)
    assert keys.select(F.spark_partition_id()).distinct().count() >= keys.count() // audio.SIGNALS_PER_TASK


@pytest.mark.parametrize("name", TABLES)
def test_every_track_is_in_the_tables(spark, name):
    assert audio.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 10


def test_tables_of_constants_are_made_once_and_cannot_be_changed():
    assert K.mel_filters() is K.mel_filters() and K.band_filters() is K.band_filters()
    with pytest.raises(ValueError):
        K.mel_filters()[0] = 1


def test_stretch_is_the_plain_phase_vocoder():
    y, rate = audio.synth(3)[: 3 * 22050].astype(float), 1.03
    window = K.hann(K.N_FFT)
    spec = np.fft.rfft(K.framed(np.pad(y, K.N_FFT // 2)) * window, axis=1)
    steps = np.arange(0, len(spec) - 1, rate)
    phase, out = np.angle(spec[0]), np.zeros(len(steps) * K.HOP + K.N_FFT)
    norm = np.zeros_like(out)
    for k, at in enumerate(steps):
        i, f = int(at), at - int(at)
        mag = (1 - f) * np.abs(spec[i]) + f * np.abs(spec[i + 1])
        out[k * K.HOP : k * K.HOP + K.N_FFT] += np.fft.irfft(mag * np.exp(1j * phase)) * window
        norm[k * K.HOP : k * K.HOP + K.N_FFT] += window**2
        phase = phase + np.angle(spec[i + 1]) - np.angle(spec[i])
    plain = (out / np.maximum(norm, 1e-3))[K.N_FFT // 2 :]
    got = K.time_stretch(y, rate)
    n = min(len(plain), len(got))
    assert abs(len(got) - len(y) / rate) <= 1 and np.abs(got[:n] - plain[:n]).max() < 1e-8


def test_crossings_are_those_of_each_frame():
    y = np.random.default_rng(5).normal(size=9000)
    y[2000:3000] = 0
    frames = K.framed(np.pad(y, K.N_FFT // 2, mode="edge"))
    sign = np.signbit(np.where(np.abs(frames) <= 1e-10, 0.0, frames))
    assert np.array_equal(K.zero_crossing_rate(y, len(frames)), (sign[:, 1:] != sign[:, :-1]).sum(axis=1) / K.N_FFT)


def test_a_cascade_is_its_sections_one_by_one():
    y = np.random.default_rng(6).normal(size=40000)
    b, a = K.butterworth(150.0, 22050, False)
    once = lambda x: K.convolved(x, K.impulse_response(b, a))
    assert np.abs(K.cascade(y, (b, a), (b, a)) - once(once(y))).max() < 1e-10


def kernel_of(monkeypatch, name):
    """The kernel that a query runs on each signal."""
    monkeypatch.setattr(audio, "_per_signal", lambda spark, sf_dir, kernel, schema, kinds: kernel)
    return audio.QUERIES[name](None, SF)


def transformed(monkeypatch, run):
    """How many samples run() sends through transforms, in thousands."""
    done = []
    for name in ("rfft", "irfft"):
        plain = getattr(np.fft, name)

        def counted(x, n=None, axis=-1, plain=plain, inverse=name == "irfft", **named):
            size = n or (2 * (x.shape[axis] - 1) if inverse else x.shape[axis])
            done.append(x.size // x.shape[axis] * size)
            return plain(x, n, axis, **named)

        monkeypatch.setattr(np.fft, name, counted)
    run()
    monkeypatch.undo()
    return sum(done) / 1000


def forbidden(*args, **named):
    raise AssertionError("not needed")


@pytest.mark.parametrize("name", ["mfcc", "contrast", "spectral_frames", "chroma_frames"])
def test_frames_go_to_arrow_as_columns(monkeypatch, name):
    got = kernel_of(monkeypatch, name)(audio.synth(3))
    assert isinstance(got, tuple) and all(isinstance(c, np.ndarray) and len(c) == 259 for c in got)


def test_tables_of_frames_are_columns():
    for make in (frames.full_rate, frames.slow_rate):
        got = make(audio.synth(3))
        assert isinstance(got, tuple) and len({len(c) for c in got}) == 1


@pytest.mark.parametrize("name", ["mix_points", "bass_check"])
def test_points_take_no_loudness_and_no_key(monkeypatch, name):
    kernel, y = kernel_of(monkeypatch, name), audio.synth(3)
    want = kernel(y)
    monkeypatch.setattr(K, "loudness", forbidden)
    monkeypatch.setattr(A, "key", forbidden)
    assert kernel(y) == want


def test_an_outline_is_that_of_all_features():
    y = audio.synth(3)
    whole, got = A.describe(y), A.outline(y)
    assert got.pop("duration") == audio.SECONDS
    assert all(np.array_equal(v, whole[n]) if isinstance(v, np.ndarray) else v == whole[n] for n, v in got.items())


@pytest.mark.parametrize(("name", "most"), [("segment_ward", 2900), ("analyze_files", 3400), ("render_transition", 2000)])
def test_transforms_are_few(monkeypatch, name, most):
    y = audio.synth(3)
    run = A.describe if name == "analyze_files" else kernel_of(monkeypatch, name)
    run(y)
    assert transformed(monkeypatch, lambda: run(y)) < most


def test_chroma_is_that_of_the_whole_rate():
    y, n = np.random.default_rng(7).normal(size=60001) + audio.synth(3)[:60001], 1 << 14
    weight, first = K.chroma_weights(n), int(np.searchsorted(K.frequencies(n), K.CHROMA_RANGE[0]))
    raw = weight @ K.magnitudes(K.framed(np.pad(y, n // 2), n), first, first + weight.shape[1]).T
    assert np.abs(K.chroma_of(y) - raw / raw.max(axis=0)).max() < 1e-8


def test_true_peak_is_that_of_each_phase(monkeypatch):
    y = np.random.default_rng(8).normal(size=5001)
    fir = np.sinc(np.arange(-40, 41) / 4) * np.kaiser(81, 5.0)
    plain = max(np.abs(np.convolve(y, fir[p::4], "same")).max() for p in range(4))
    monkeypatch.setattr(np, "convolve", forbidden)
    assert abs(K.true_peak(y) - 20 * np.log10(plain)) < 1e-10


def test_bands_of_each_filter_are_convolved_at_once(monkeypatch):
    y = np.random.default_rng(9).normal(size=50000)
    K.split_bands(y)
    assert transformed(monkeypatch, lambda: K.split_bands(y)) < 250


@pytest.mark.parametrize("size", [1, 700, 5000, 30001])
def test_frame_rms_is_that_of_the_frames(size):
    y = np.random.default_rng(10).normal(size=size)
    plain = np.sqrt((K.framed(np.pad(y, K.N_FFT // 2)) ** 2).mean(axis=1))
    assert np.abs(K.frame_rms(y) - plain).max() < 1e-12


@pytest.mark.parametrize("size", [1, 31, 32, 33, 52, 700, 8192])
def test_only_blocks_that_may_hold_the_peak_are_oversampled(monkeypatch, size):
    fir, taken, framed = np.sinc(np.arange(-40, 41) / 4) * np.kaiser(81, 5.0), [], K.framed

    class Rows:
        def __init__(self, rows):
            self.rows = rows

        def __getitem__(self, at):
            taken.append(len(at))
            return self.rows[at]

    monkeypatch.setattr(K, "framed", lambda *args: Rows(framed(*args)))
    noise = np.random.default_rng(11).normal(size=size)
    for y in (noise, noise * np.exp(-np.arange(size) / 100)):
        taken.clear()
        plain = max(np.abs(np.convolve(y, fir[p::4])[10 : 10 + size]).max() for p in range(4))
        assert abs(K.true_peak(y) - 20 * np.log10(plain)) < 1e-10 and taken
    assert sum(taken) <= 128


def test_mel_bands_take_the_bins_of_their_filters(monkeypatch):
    s = np.abs(np.random.default_rng(12).normal(size=(K.N_FFT // 2 + 1, 40)))
    want = K.power_db(K.mel_filters() @ s**2)
    assert np.abs(K.mel_db(s) - want).max() < 1e-10
    monkeypatch.setattr(K, "mel_filters", forbidden)
    assert np.abs(K.mel_db(s) - want).max() < 1e-10
    assert sum(part.size for _, _, part in K.mel_groups()) * 4 < 128 * len(s)


def memory(run):
    """Bytes that run() has at once."""
    run()
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_signals_are_made_in_parts():
    t, k = np.arange(6 * 22050) / 22050, 3
    phase = t * (80 + k) / 60 - np.floor(t * (80 + k) / 60)
    click = np.sin(2 * np.pi * 1200 * t) * np.exp(-phase * 60) + np.sin(2 * np.pi * 60 * t) * np.exp(-phase * 20)
    plain = (np.where((t > 2) & (t < 4), 1.0, 0.4) * (0.15 * audio._chord(k) + 0.5 * click)).astype(np.float32) / 2
    assert np.array_equal(audio.synth(k), plain) and audio.synth(k).dtype == np.float32
    assert memory(lambda: audio.synth(k)) < 2_000_000


@pytest.mark.parametrize("rate", [0.5, 0.97, 1.0, 1.03, 1.7, 2.0])
def test_phases_of_a_stretch_are_the_sums_of_turns(rate):
    y = np.random.default_rng(13).normal(size=30000)
    y[9000:18000] = 0
    window, rows = K.hann(K.N_FFT), K.framed(np.pad(y, K.N_FFT // 2))
    spec, steps = np.fft.rfft(rows * window, axis=1), np.arange(0, len(rows) - 1, rate)
    phase, out, norm = np.angle(spec[0]), np.zeros(len(steps) * K.HOP + K.N_FFT), np.zeros(len(steps) * K.HOP + K.N_FFT)
    for k, at in enumerate(steps):
        i, f = int(at), at - int(at)
        part = slice(k * K.HOP, k * K.HOP + K.N_FFT)
        out[part] += np.fft.irfft(((1 - f) * np.abs(spec[i]) + f * np.abs(spec[i + 1])) * np.exp(1j * phase)) * window
        norm[part] += window**2
        phase = phase + np.angle(spec[i + 1]) - np.angle(spec[i])
    plain = (out / np.maximum(norm, 1e-3))[K.N_FFT // 2 :]
    got = K.time_stretch(y, rate)
    n = min(len(plain), len(got))
    assert np.abs(got[:n] - plain[:n]).max() < 1e-8


def test_a_stretch_keeps_few_frames():
    y = audio.synth(3)
    assert memory(lambda: K.time_stretch(y, 1.03)) < 6_000_000


def test_memory_of_a_signal_is_taken_from_the_system_once():
    A.keep_memory()
    y = audio.synth(3)
    A.outline(y)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    A.outline(y)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 1000


@pytest.mark.parametrize(("signals", "least", "most"), [(100, 7, 7), (1000, 63, 63), (60000, 256, 512)])
def test_many_signals_are_no_more_tasks_than_are_of_use(spark, tmp_path, signals, least, most):
    spark.range(signals).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    tracks = audio._tracks(spark, str(tmp_path))
    assert least <= tracks.rdd.getNumPartitions() <= most and tracks.count() == signals


def test_a_signal_takes_one_exponential_a_sample(monkeypatch):
    audio.synth(5)
    plain, done = np.exp, []
    monkeypatch.setattr(np, "exp", lambda x: done.append(x.size) or plain(x))
    audio.synth(5)
    assert sum(done) <= audio.SECONDS * 22050


@pytest.mark.parametrize(("at", "size"), [(20000, 5000), (0, 0), (-500, 3000), (49900, 5000), (60000, 10)])
def test_voices_of_a_swap_are_their_plain_sums(monkeypatch, at, size):
    a, b = np.random.default_rng(14).normal(size=(2, 50000))
    t, x = np.linspace(0, 1, 50000) * np.pi / 2, np.clip((np.arange(50000) - at) / max(1, size), 0, 1) * np.pi / 2
    (a_low, a_high), (b_low, b_high) = K.split_bands(a), K.split_bands(b)
    plain, done = (a_high * np.cos(t) + a_low * np.cos(x), b_high * np.sin(t) + b_low * np.sin(x)), []
    for name in ("cos", "sin"):
        monkeypatch.setattr(np, name, lambda v, f=getattr(np, name): done.append(v.size) or f(v))
    got = K.swap_voices(a, b, at, size)
    assert all(np.abs(p - q).max() < 1e-12 for p, q in zip(got, plain, strict=True)) and sum(done) <= 50000 + 2 * max(1, size)


@pytest.mark.parametrize("top", [1.0, 1e6, 1e40, 1e250])
def test_flatness_takes_logarithms_of_products(monkeypatch, top):
    rows = np.random.default_rng(15).uniform(1e-10, 1, (7, 1025)) ** 2 * top + 1e-10
    plain, done, log = np.log(rows).mean(axis=1), [], np.log
    monkeypatch.setattr(np, "log", lambda v: done.append(v.size) or log(v))
    assert np.abs(K.log_means(rows) - plain).max() < 1e-10
    assert top > 1e38 or sum(done) * 7 < rows.size


def test_loudness_adds_up_squares_once(monkeypatch):
    y, done, cumsum = audio.synth(3), [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda v: done.append(v.size) or cumsum(v))
    K.loudness(y)
    assert done == [len(y)]


@pytest.mark.parametrize("width", [2, 3])
def test_samples_are_written_as_their_low_bytes(width):
    y = np.random.default_rng(16).uniform(-1.2, 1.2, (500, 2))
    x = np.rint(np.clip(y, -1, 1) * ((1 << (8 * width - 1)) - 1)).astype("<i4")
    assert encode_wav(y, width=width)[44:] == b"".join(int(v).to_bytes(4, "little", signed=True)[:width] for v in x.ravel())


@pytest.mark.parametrize("name", ["mix_points", "bass_check"])
def test_sections_of_a_track_that_no_border_can_leave_are_not_made(monkeypatch, name):
    kernel, y, sections, done = kernel_of(monkeypatch, name), audio.synth(3), K.sections, []
    want = kernel(y)
    monkeypatch.setattr(K, "sections", lambda *args: done.append(1) or sections(*args))
    assert kernel(y) == want and len(done) == 1


@pytest.mark.parametrize("beats", [32, 16, 4])
def test_points_of_late_sections_are_those_of_all(beats):
    """A border at two thirds leaves a third of the track: as long as that, or a bit longer."""
    for seconds in (1.0, 1.0 + 1e-12, 1.0 - 1e-12):
        end = 3 * beats * 0.5
        track = {"bpm": 120 / seconds, "duration": end, "downbeats": [], "sections": [{"start": 0.0, "label": "intro"}, {"start": end * 2 / 3, "label": "outro"}]}
        length = beats * 60 / track["bpm"]
        fits = [s["start"] for s in track["sections"] if s["start"] * 3 >= end * 2 and s["start"] + length <= end]
        assert strategies._exit(track, length) == (fits[0] if fits else None)


def test_an_outline_finds_its_sections_when_asked():
    y = audio.synth(3)
    got, want = A.Outline(y), A.outline(y)
    assert "sections" not in got and got["sections"] == want["sections"] and got["sections"] is got["sections"]
    assert all(np.array_equal(got[n], v) for n, v in want.items() if n != "sections")
    with pytest.raises(KeyError):
        got["key"]


@pytest.mark.parametrize("size", [1, 600, 5000, 45641])
def test_powers_of_few_bins_are_those_of_the_transform(monkeypatch, size):
    y = np.random.default_rng(17).normal(size=size)
    want = K.stft(y)[2:14] ** 2
    monkeypatch.setattr(np.fft, "rfft", forbidden)
    got = K.bin_powers(y, 2, 14)
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-9


def test_a_low_passed_sample_takes_the_taps_that_are_not_zero(monkeypatch):
    y, done, banded = np.random.default_rng(18).normal(size=4001), [], K.banded
    plain = np.convolve(y, K.half_band(), "same")[::2]
    monkeypatch.setattr(K, "banded", lambda x, taps, *args: done.append(taps.size) or banded(x, taps, *args))
    got = K.halved(y)
    assert len(got) == len(plain) and np.abs(got - plain).max() < 1e-12 and done == [64]


@pytest.mark.parametrize("size", [1, 700, 8192, 60001])
def test_chroma_of_any_length_is_that_of_whole_frames(size):
    y, n = np.random.default_rng(19).normal(size=size), 1 << 14
    weight, first = K.chroma_weights(n), int(np.searchsorted(K.frequencies(n), K.CHROMA_RANGE[0]))
    raw = weight @ K.magnitudes(K.framed(np.pad(y, n // 2), n), first, first + weight.shape[1]).T
    got = K.chroma_of(y)
    assert got.shape == (12, 1 + size // K.HOP) and np.abs(got - raw / raw.max(axis=0)).max() < 1e-8


def test_chroma_keeps_few_frames():
    y = audio.synth(3)
    assert memory(lambda: K.chroma_of(y)) < 6_000_000


def test_the_cache_takes_one_transform_of_each_frame(spark, tmp_path, monkeypatch):
    y = audio.synth(3)
    together, apart = (transformed(monkeypatch, run) for run in (lambda: frames.both_rates(y), lambda: (frames.full_rate(y), frames.slow_rate(y))))
    assert together < 0.85 * apart
    tracks = spark.createDataFrame([(3,), (4,)], "track_id long")
    frames.write_cache(tracks, f"{tmp_path}/c", audio.made)
    for got, want in zip(frames.read_cache(spark, f"{tmp_path}/c"), (frames.frames(tracks, audio.made), frames.frames_5hz(tracks, audio.made)), strict=True):
        assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    frames.write_cache(tracks.where("track_id > 9"), f"{tmp_path}/c", audio.made)
    assert [df.count() for df in frames.read_cache(spark, f"{tmp_path}/c")] == [0, 0]


def test_files_are_analysed_without_a_join(spark):
    plan = audio.QUERIES["analyze_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_keys_are_those_of_the_correlations(monkeypatch):
    rng = np.random.default_rng(20)
    for chroma in (*rng.uniform(size=(30, 12)), *np.roll(np.eye(12), 3, axis=1), *1e-3 * rng.uniform(size=(5, 12, 40))):
        mean = chroma.mean(axis=1) if chroma.ndim == 2 else chroma
        fits = sorted((-round(float(np.corrcoef(mean, np.roll(profile, p))[0, 1]), 12), p, minor) for p in range(12) for minor, profile in enumerate((A.MAJOR_PROFILE, A.MINOR_PROFILE)))
        with monkeypatch.context() as m:
            m.setattr(np, "corrcoef", forbidden)
            got = A.key(chroma)
        want = np.clip((fits[0][0] - fits[1][0]) / fits[0][0], 0, 1)
        assert (got["pitch_class"], got["key_mode"]) == (fits[0][1], "minor" if fits[0][2] else "major") and abs(got["key_confidence"] - want) < 1e-9


@pytest.mark.parametrize("channels", [1, 2])
def test_samples_of_three_bytes_are_read_as_numbers(monkeypatch, channels):
    y = np.random.default_rng(21).uniform(-1.1, 1.1, (501, channels))
    x = np.rint(np.clip(y, -1, 1) * ((1 << 23) - 1)) / (1 << 23)
    y[:2] = [[-1.0] * channels, [1.0] * channels]
    x[:2] = np.array([[-1.0], [1.0]]) * ((1 << 23) - 1) / (1 << 23)
    assert np.array_equal(decode_wav(encode_wav(y)), x.mean(axis=1).astype(np.float32))
