"""NumPy kernels of one signal: what has no relational form. Signals are mono float arrays at SAMPLE_RATE."""

from __future__ import annotations

import functools
import math

import numpy as np

from sonolith.constants import BAND_EDGES, CONFIDENCE_BPM, HOP, MAX_SECTIONS, MIN_SECTION_SEC, N_FFT, N_MFCC, ROLLOFF, SAMPLE_RATE, SILENCE_LUFS, SILENCE_PEAK, STRUCTURE_FPS, TOP_DB


def checked(y: np.ndarray) -> np.ndarray:
    y = np.asarray(y, np.float64)
    if y.ndim != 1 or not len(y):
        raise ValueError("a signal is a non-empty array of one dimension")
    return y


def framed(y: np.ndarray, size: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """Frames as rows, without padding."""
    n = 1 + (len(y) - size) // hop
    return np.lib.stride_tricks.sliding_window_view(y, size)[: n * hop : hop]


def constant(make):
    """A table that depends on parameters only: made once, and read-only."""

    @functools.lru_cache(maxsize=64)
    @functools.wraps(make)
    def made(*args, **named):
        out = make(*args, **named)
        out.setflags(write=False)
        return out

    return made


@constant
def hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def magnitudes(rows: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Magnitudes (frames, bins) of the bins [first, last) of frames under a periodic Hann window, some frames at a time:
    as many as stay in the cache."""
    size = rows.shape[1]
    last = size // 2 + 1 if last is None else last
    window, out, step = hann(size), np.empty((len(rows), last - first)), max(1, (1 << 16) // size)
    part, z = np.empty((step, size)), np.empty((step, size // 2 + 1), complex)
    for i in range(0, len(rows), step):
        n = min(step, len(rows) - i)
        np.fft.rfft(np.multiply(rows[i : i + n], window, out=part[:n]), axis=1, out=z[:n])
        np.abs(z[:n, first:last], out=out[i : i + n])
    return out


def stft(y: np.ndarray, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """Magnitudes (bins, frames) of centred frames with a periodic Hann window; the ends are padded with zeros."""
    return magnitudes(framed(np.pad(checked(y), n_fft // 2), n_fft, hop)).T


def bin_powers(y: np.ndarray, first: int, last: int) -> np.ndarray:
    """Powers (bins, frames) of the few bins [first, last) of stft(), by sums of products with their waves, hop by hop."""
    x, waves = np.pad(checked(y), N_FFT // 2), bin_waves(first, last)
    hops = x[: len(x) // HOP * HOP].reshape(-1, HOP) @ waves
    n, width = len(hops) - N_FFT // HOP + 1, 2 * (last - first)
    sums = sum(hops[k : k + n, k * width : (k + 1) * width] for k in range(N_FFT // HOP))
    return (sums[:, : last - first] ** 2 + sums[:, last - first :] ** 2).T


@constant
def bin_waves(first: int, last: int) -> np.ndarray:
    """Windowed cosines, then sines, of bins [first, last): the samples of a hop as rows, the hops of a frame side by side."""
    turn = 2 * np.pi / N_FFT * (np.arange(N_FFT)[:, None] * np.arange(first, last) % N_FFT)
    waves = np.concatenate([np.cos(turn), np.sin(turn)], axis=1) * hann(N_FFT)[:, None]
    return np.concatenate(np.split(waves, N_FFT // HOP), axis=1)


@constant
def frequencies(n_fft: int = N_FFT, sr: int = SAMPLE_RATE) -> np.ndarray:
    return np.arange(n_fft // 2 + 1) * sr / n_fft


def power_db(power: np.ndarray, ref: float = 1.0, amin: float = 1e-10, top_db: float | None = TOP_DB) -> np.ndarray:
    db = 10 * np.log10(np.maximum(amin, power)) - 10 * np.log10(max(amin, ref))
    return db if top_db is None else np.maximum(db, db.max() - top_db)


@constant
def mel_filters(n_mels: int = 128, n_fft: int = N_FFT, sr: int = SAMPLE_RATE) -> np.ndarray:
    """Triangular filters of unit area on the Slaney scale: linear to 1 kHz, then logarithmic."""
    log_step = math.log(6.4) / 27
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / log_step)
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp(log_step * (m - 15)))
    edges = to_hz(np.linspace(0, float(to_mel(np.array(sr / 2.0))), n_mels + 2))
    f = frequencies(n_fft, sr)
    up = (f[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def dct_rows(x: np.ndarray, n: int) -> np.ndarray:
    """First n rows of the orthonormal DCT-II along the first axis."""
    return dct_basis(len(x), n) @ x


@constant
def dct_basis(size: int, n: int) -> np.ndarray:
    basis = np.cos(np.pi / size * (np.arange(size) + 0.5)[None, :] * np.arange(n)[:, None]) * math.sqrt(2 / size)
    basis[0] /= math.sqrt(2)
    return basis


@functools.lru_cache(maxsize=4)
def mel_groups(size: int = 16) -> tuple[tuple[int, int, np.ndarray], ...]:
    """The filters, some at a time, with the range of bins in which any of them is above zero."""
    groups = []
    for part in np.split(mel_filters(), range(size, len(mel_filters()), size)):
        bins = np.flatnonzero(part.any(axis=0))
        groups.append((int(bins[0]), int(bins[-1]) + 1, np.ascontiguousarray(part[:, bins[0] : bins[-1] + 1].T)))
    return tuple(groups)


def mel_db(s: np.ndarray) -> np.ndarray:
    """Decibels (mel bands, frames) of a spectrogram."""
    power = s.T**2  # frames are rows here, as stft() made them
    return power_db(np.concatenate([power[:, a:b] @ part for a, b, part in mel_groups()], axis=1).T)


def mfcc(s: np.ndarray, n: int = N_MFCC, db: np.ndarray | None = None) -> np.ndarray:
    """db: mel_db() of the spectrogram, if it is known."""
    return dct_rows(mel_db(s) if db is None else db, n)


def contrast(s: np.ndarray, low: float = 200.0, octaves: int = 6, share: float = 0.02) -> np.ndarray:
    """Decibels between the strongest and the weakest bins of each octave band, and of what is below the first."""
    f = frequencies()
    edges = np.concatenate([[0.0], low * 2.0 ** np.arange(octaves + 1)])
    out = np.zeros((octaves + 1, s.shape[1]))
    for k in range(octaves + 1):
        inside = (f >= edges[k]) & (f <= edges[k + 1])
        first = int(np.flatnonzero(inside)[0])
        if k and first:
            inside[first - 1] = True
        if k == octaves:
            inside[np.flatnonzero(inside)[-1] :] = True
        bins = np.flatnonzero(inside)  # neighbours; frames are rows here, as stft() made them
        band = np.sort(s.T[:, bins[0] : bins[-1] + (k == octaves)], axis=1).T
        n = max(1, round(share * len(bins)))
        out[k] = power_db(band[-n:].mean(axis=0), top_db=None) - power_db(band[:n].mean(axis=0), top_db=None)
    return out


def zero_crossing_rate(y: np.ndarray, frames: int) -> np.ndarray:
    x = np.pad(y, N_FFT // 2, mode="edge")
    sign = np.signbit(np.where(np.abs(x) <= 1e-10, 0.0, x))
    run = np.append(0, np.cumsum(sign[1:] != sign[:-1]))  # changes up to each sample
    rate = (run[N_FFT - 1 :] - run[: len(run) - N_FFT + 1])[::HOP] / N_FFT
    return np.pad(rate, (0, max(0, frames - len(rate))), mode="edge")[:frames]


def log_means(x: np.ndarray) -> np.ndarray:
    """Mean logarithm of each row of numbers from 1e-30 on: one of the product of eight numbers, if that stays in range."""
    size = x.shape[1] // 8 * 8
    if not size or not x.max() < 1e38:
        return np.log(x).mean(axis=1)
    eights = np.multiply.reduce(x[:, :size].reshape(len(x), 8, -1), axis=1)
    return (np.log(eights).sum(axis=1) + np.log(x[:, size:]).sum(axis=1)) / x.shape[1]


def descriptors(y: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
    """One number a frame each, from a signal and its STFT."""
    f, n = frequencies(), s.shape[1]
    out = {name: np.empty(n) for name in ("centroid", "bandwidth", "rolloff", "flatness")}
    for i in range(0, n, 32):  # frames as rows, as many as stay in the cache
        at, rows = slice(i, i + 32), np.ascontiguousarray(s.T[i : i + 32])
        total = rows.sum(axis=1)
        some = np.where(total > 0, total, 1)
        centroid = out["centroid"][at] = rows @ f / some
        out["bandwidth"][at] = np.sqrt((rows * (f - centroid[:, None]) ** 2).sum(axis=1) / some)
        run = np.cumsum(rows, axis=1)
        out["rolloff"][at] = f[np.argmax(run >= ROLLOFF * run[:, -1:], axis=1)]
        power = np.maximum(1e-10, rows**2)
        out["flatness"][at] = np.exp(log_means(power)) / power.mean(axis=1)
    return out | {"zcr": zero_crossing_rate(y, n), "rms": frame_rms(y)}


def frame_rms(y: np.ndarray) -> np.ndarray:
    """Root mean squares of centred frames, from sums of hops."""
    energy = np.pad(np.asarray(y, float) ** 2, N_FFT // 2)
    hops = energy[: len(energy) // HOP * HOP].reshape(-1, HOP).sum(axis=1)
    return np.sqrt(framed(hops, N_FFT // HOP, 1).sum(axis=1) / N_FFT)


def spectral_features(y: np.ndarray) -> dict[str, np.ndarray]:
    """All descriptors of one signal, from one STFT."""
    y = checked(y)
    s = stft(y)
    return descriptors(y, s) | {"stft": s, "db": power_db(s**2, ref=float(s.max()) ** 2), "contrast": contrast(s), "mfcc": mfcc(s)}


@constant
def band_filters(edges: tuple[float, ...] = BAND_EDGES) -> np.ndarray:
    """Marks of the bins of each band: lower edge in, upper edge out, but in for the last band."""
    f = frequencies()
    marks = np.array([(f >= a) & (f < b) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    marks[-1] |= f == edges[-1]
    return marks.astype(float)


def smooth(x: np.ndarray, size: int) -> np.ndarray:
    """Moving mean along the last axis with replicated edges; as it is if shorter than the window."""
    if size <= 1 or x.shape[-1] < size:
        return x
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(size // 2, size - 1 - size // 2)], mode="edge")
    return np.lib.stride_tricks.sliding_window_view(padded, size, axis=-1).mean(axis=-1)


def band_energies(s: np.ndarray, window: int = 3) -> np.ndarray:
    """Decibels (bands, frames) against the largest band power; the floor where all is silent."""
    if s.ndim != 2 or len(s) != N_FFT // 2 + 1:
        raise ValueError("a spectrogram has one row a bin")
    power = band_filters() @ s**2
    if not power.size or power.max() <= 1e-10:
        return np.full(power.shape, -TOP_DB)
    return smooth(np.maximum(-TOP_DB, power_db(power, float(power.max()), top_db=None)), window)


def onset_strength(s: np.ndarray, db: np.ndarray | None = None) -> np.ndarray:
    """Mean rise of the mel bands in decibels against the frame before; db: mel_db(), if it is known."""
    rise = np.maximum(0, np.diff(mel_db(s) if db is None else db, axis=1)).mean(axis=0)
    return np.concatenate([[0.0], rise])[: s.shape[1]]


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    n = 1 << int(2 * len(x) - 1).bit_length()
    spectrum = np.fft.rfft(x, n)
    ac = np.fft.irfft(spectrum * spectrum.conj(), n)[: lags + 1]
    return ac / ac[0] if ac[0] > 0 else np.zeros(lags + 1)


def peaks(x: np.ndarray, prominence: float) -> np.ndarray:
    """Local maxima whose prominence is large enough, highest first."""
    found = []
    for i in np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1:
        left = x[:i][::-1]
        right = x[i + 1 :]
        stop = np.argmax(left > x[i]) if (left > x[i]).any() else len(left)
        stop2 = np.argmax(right > x[i]) if (right > x[i]).any() else len(right)
        base = max(left[:stop].min(initial=x[i]), right[:stop2].min(initial=x[i]))
        if x[i] - base >= prominence:
            found.append(i)
    return np.array(sorted(found, key=lambda i: (-x[i], i)), int)


def bpm_confidence(onset: np.ndarray, fps: float = SAMPLE_RATE / HOP) -> float:
    """Distinctiveness of the best tempo's autocorrelation peak times its clipped height."""
    if not len(onset) or onset.max() <= 1e-5:
        return 0.0
    low, high = max(1, round(60 * fps / CONFIDENCE_BPM[1])), min(len(onset) - 1, round(60 * fps / CONFIDENCE_BPM[0]))
    if high <= low + 2:
        return 0.0
    ac = autocorrelation(onset, high)
    found = peaks(ac[low : high + 1], 0.01) + low
    if not len(found):
        return 0.0
    first = found[0]
    # an octave of the first peak: its lag is about twice, or its inverse about twice, that of the first
    others = [k for k in found[1:] if abs(k / first - 2) >= 0.15 and abs(first / k - 2) >= 0.15]
    second = ac[others[0]] if others else 0.0
    h = ac[first]
    return float(np.clip((h - second) / h * np.clip(2 * h, 0, 1), 0, 1)) if h > 0 else 0.0


def tempo_of(onset: np.ndarray, fps: float, start: float = 120.0) -> float:
    """Tempo whose lag maximises the autocorrelation under a log-normal prior."""
    ac = autocorrelation(onset, min(len(onset) - 1, int(4 * fps)))
    lags = np.arange(1, len(ac))
    bpm = 60 * fps / lags
    prior = np.exp(-0.5 * (np.log2(bpm / start)) ** 2)
    return float(bpm[np.argmax(np.maximum(ac[1:], 0) * prior)])


def beat_track(onset: np.ndarray, fps: float = SAMPLE_RATE / HOP, tightness: float = 100.0) -> tuple[float, np.ndarray]:
    """Tempo and beat frames by dynamic programming (Ellis, 2007): each beat scores its onset and the best beat about
    one period before it, with a penalty on the log of the interval's ratio."""
    if len(onset) < 4 or onset.max(initial=0) <= 0:
        return 0.0, np.zeros(0, int)
    bpm = tempo_of(onset, fps)
    period = 60 * fps / bpm
    half = max(1, int(period / 2))
    local = np.convolve(onset / (onset.std() or 1.0), np.exp(-0.5 * (np.arange(-int(period), int(period) + 1) * 32 / period) ** 2), "same")
    offsets = np.arange(-int(2 * period), -half + 1)
    cost = -tightness * np.log(-offsets / period) ** 2
    total, back = local.copy(), np.full(len(local), -1)
    for i in range(half, len(local)):
        low = max(0, i + int(offsets[0]))
        s = total[low : i + 1 - half] + cost[low - i - int(offsets[0]) :]
        if len(s):
            k = int(s.argmax())
            if s[k] > 0:
                total[i], back[i] = local[i] + s[k], low + k
    tops = np.flatnonzero((total[1:-1] >= total[:-2]) & (total[1:-1] > total[2:])) + 1
    if not len(tops):
        return bpm, np.zeros(0, int)
    strong = tops[total[tops] * 2 > np.median(total[tops])]
    beats, at = [], int(strong[-1])
    while at >= 0:
        beats.append(at)
        at = int(back[at])
    frames = np.array(beats[::-1])
    keep = np.flatnonzero(smooth(local[frames], 3) > 0.5 * np.sqrt((local[frames] ** 2).mean()))
    return bpm, frames[keep[0] : keep[-1] + 1] if len(keep) else frames


CHROMA_RANGE = (65.0, 4300.0)


@constant
def chroma_weights(n_fft: int) -> np.ndarray:
    """Share (classes, bins) of each bin within CHROMA_RANGE in each pitch class."""
    f = frequencies(n_fft)
    f = f[(f >= CHROMA_RANGE[0]) & (f <= CHROMA_RANGE[1])]
    pitch = 12 * np.log2(f / 440.0) + 9
    distance = (pitch[None, :] - np.arange(12)[:, None] + 6) % 12 - 6
    return np.exp(-0.5 * (distance / 0.25) ** 2) / np.sqrt(f / 65.0)  # as a constant-Q transform scales them


@constant
def half_band(reach: int = 64) -> np.ndarray:
    """Low pass between CHROMA_RANGE and what half the rate folds into it: 190 dB down there."""
    k = np.arange(-reach, reach + 1)
    return 0.5 * np.sinc(k / 2) * np.kaiser(2 * reach + 1, 20.0)


def banded(x: np.ndarray, taps: np.ndarray, step: int, rows: int = 32) -> np.ndarray:
    """(n, filters): sums over taps (filters, width) of x from every step-th sample on, by products of blocks with the
    taps in a band."""
    count, width = taps.shape
    n = (len(x) - width) // step + 1
    size = (rows - 1) * step + width
    band = banded_taps(taps.tobytes(), count, width, step, rows)
    blocks = -(-n // rows)
    x = np.pad(x, (0, max(0, (blocks - 1) * rows * step + size - len(x))))
    parts = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, size)[:: rows * step][:blocks])
    return (parts @ band).reshape(-1, count)[:n]


@constant
def banded_taps(raw: bytes, count: int, width: int, step: int, rows: int) -> np.ndarray:
    taps, band = np.frombuffer(raw).reshape(count, width), np.zeros(((rows - 1) * step + width, rows, count))
    for k in range(rows):
        band[k * step : k * step + width, k] = taps.T
    return band.reshape(len(band), -1)


def halved(y: np.ndarray) -> np.ndarray:
    """Every second sample of the low-passed signal. Of the taps of even number only the middle one is not zero, so the
    samples beside those that stay are summed alone."""
    reach = len(half_band()) // 2
    beside = np.ascontiguousarray(np.pad(y, (reach, reach + 1))[1::2])
    out = banded(beside, odd_taps(), 1)[: -(-len(y) // 2), 0]
    out += half_band()[reach] * y[::2]
    return out


@constant
def odd_taps() -> np.ndarray:
    return np.ascontiguousarray(half_band()[None, 1::2])


def chroma_of(y: np.ndarray, n_fft: int = 1 << 14, hop: int = HOP) -> np.ndarray:
    """Pitch-class energies (12, frames), each frame scaled to a maximum of 1. Frames are long enough (0.74 s) to part
    semitones from the second octave on; hop is even; bins go to the classes by a Gaussian of their distance in semitones."""
    y = checked(y)
    weight, size, reach = chroma_weights(n_fft), n_fft // 2, len(half_band()) // 2
    first = int(np.searchsorted(frequencies(n_fft), CHROMA_RANGE[0]))
    # nothing above the range is asked for: every second sample of the low-passed signal has the same bins
    edge = size // 2 - reach // 2  # beyond the filter's reach there are zeros
    rows = framed(np.pad(halved(np.pad(y, reach)), edge), size, hop // 2)[: 1 + len(y) // hop]
    raw, step = np.empty((len(rows), len(weight))), 12  # as many frames as stay in the cache
    part, z, mags = np.empty((step, size)), np.empty((step, size // 2 + 1), complex), np.empty((step, weight.shape[1]))
    for i in range(0, len(rows), step):
        n = min(step, len(rows) - i)
        np.fft.rfft(np.multiply(rows[i : i + n], hann(size), out=part[:n]), axis=1, out=z[:n])
        np.abs(z[:n, first : first + weight.shape[1]], out=mags[:n])
        raw[i : i + n] = mags[:n] @ weight.T
    raw = 2 * raw.T
    return raw / np.where(raw.max(axis=0) > 1e-9, raw.max(axis=0), 1)


@functools.lru_cache(maxsize=16)
def impulse_response(b: tuple[float, ...], a: tuple[float, ...], most: int = 1 << 15) -> np.ndarray:
    """Of a second-order section, cut where it has decayed; made once for a filter."""
    h, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
    for k in range(most):
        x0 = 1.0 if k == 0 else 0.0
        y0 = b[0] * x0 + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
        x2, x1, y2, y1 = x1, x0, y1, y0
        h.append(y0)
        if k > 64 and abs(y0) + abs(y2) < 1e-12:
            break
    return np.array(h)


Section = tuple[tuple[float, ...], tuple[float, ...]]


@constant
def cascade_response(*sections: Section) -> np.ndarray:
    """Impulse response of second-order sections (b, a), one after the other."""
    return functools.reduce(np.convolve, [impulse_response(*s) for s in sections])


def cascade(x: np.ndarray, *sections: Section) -> np.ndarray:
    """Second-order sections, one after the other, by convolution with their common impulse response."""
    return convolved(x, cascade_response(*sections))


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The first len(x) values of the convolution."""
    return convolved_each(x, h)[0]


def convolved_each(x: np.ndarray, *responses: np.ndarray) -> list[np.ndarray]:
    """The first len(x) values of the convolution with each response, by overlapping blocks."""
    size = 1 << max(14, (3 * max(map(len, responses))).bit_length())
    step, outs = size - max(map(len, responses)) + 1, [np.zeros(len(x) + size) for _ in responses]
    spectra = [response_spectrum(h.tobytes(), size) for h in responses]
    for i in range(0, len(x), step):
        block = np.fft.rfft(x[i : i + step], size)
        for out, spectrum in zip(outs, spectra, strict=True):
            out[i : i + size] += np.fft.irfft(block * spectrum, size)
    return [out[: len(x)] for out in outs]


@constant
def response_spectrum(raw: bytes, size: int) -> np.ndarray:
    return np.fft.rfft(np.frombuffer(raw), size)


def k_weighted(y: np.ndarray, sr: int = SAMPLE_RATE) -> np.ndarray:
    """The two filters of ITU-R BS.1770: a shelf of 4 dB above 1.5 kHz and a high pass at 38 Hz, for any rate."""
    shelf, high = 10 ** (3.999843853973347 / 20), (1681.974450955533, 0.7071752369554196)
    k = math.tan(math.pi * high[0] / sr)
    vb = shelf**0.4996667741545416
    d = 1 + k / high[1] + k * k
    first = ((shelf + vb * k / high[1] + k * k) / d, 2 * (k * k - shelf) / d, (shelf - vb * k / high[1] + k * k) / d), (1, 2 * (k * k - 1) / d, (1 - k / high[1] + k * k) / d)
    k, q = math.tan(math.pi * 38.13547087602444 / sr), 0.5003270373238773
    d = 1 + k / q + k * k
    return cascade(y, first, ((1.0, -2.0, 1.0), (1, 2 * (k * k - 1) / d, (1 - k / q + k * k) / d)))


def _block_power(run: np.ndarray, seconds: float, hop: float, sr: int) -> np.ndarray:
    """Mean power of blocks, from the sums of squares up to each sample."""
    size, step = int(seconds * sr), int(hop * sr)
    if len(run) <= size:
        return np.zeros(0)
    at = np.arange(0, len(run) - size, step)
    return np.maximum(0.0, run[at + size] - run[at]) / size


def _level(power: np.ndarray) -> np.ndarray:
    return -0.691 + 10 * np.log10(np.maximum(power, 1e-20))


def true_peak(y: np.ndarray) -> float:
    """Peak of the four-fold oversampled signal in decibels; the floor for silence."""
    if not len(y) or np.abs(y).max() <= 1e-6:
        return SILENCE_PEAK
    # phase 0 is the signal itself; the sums over 20 samples are at most the largest of them times gain, so only blocks
    # where that is above the top so far are oversampled
    taps, size = oversampling(), 32
    gain, width = float(np.abs(taps).sum(axis=1).max()) * (1 + 1e-9), size + taps.shape[1] - 1
    blocks = -(-len(y) // size)
    x = np.pad(y, (10, 10 + blocks * size - len(y)))
    most = np.abs(np.pad(x, (0, -len(x) % size))).reshape(-1, size).max(axis=1)
    most = np.maximum(most[:blocks], most[1 : blocks + 1]) * gain  # a block and what follows it within the next
    band, parts = banded_taps(taps.tobytes(), *taps.shape, 1, size), framed(x, width, size)
    top = float(np.abs(y).max())
    left = np.argsort(-most, kind="stable")
    for i in range(0, blocks, 128):
        at = left[i : i + 128]
        at = at[most[at] > top]
        if not len(at):
            break
        over = parts[at] @ band
        # sums past the signal's end are none of its own
        own = (at[:, None] * size + np.arange(size) < len(y)).repeat(len(taps), axis=1)
        top = max(top, float(np.abs(over, out=over).max(where=own, initial=0)))
    return float(20 * math.log10(top))


@constant
def oversampling() -> np.ndarray:
    """Taps of the three phases between two samples, as sums over 20 samples take them."""
    fir = np.sinc(np.arange(-40, 41) / 4) * np.kaiser(81, 5.0)
    return np.array([fir[p::4][::-1] for p in range(1, 4)])


def loudness(y: np.ndarray, sr: int = SAMPLE_RATE) -> dict[str, float]:
    """Integrated loudness, range and true peak."""
    y = np.asarray(y, float)
    peak = true_peak(y)
    if not len(y) or math.sqrt(float((y**2).mean())) <= 1e-6 or len(y) < 0.4 * sr:
        return {"lufs": SILENCE_LUFS, "range": 0.0, "true_peak": peak}
    run = np.append(0.0, np.cumsum(k_weighted(y, sr) ** 2))
    power = _block_power(run, 0.4, 0.1, sr)
    level = _level(power)
    loud = power[level >= -70]
    lufs = SILENCE_LUFS
    if len(loud):
        gated = power[(level >= -70) & (level > float(_level(loud.mean())) - 10)]
        lufs = max(SILENCE_LUFS, float(_level(gated.mean()))) if len(gated) else SILENCE_LUFS
    short = _block_power(run, 3.0, 0.1, sr)
    lra = 0.0
    if len(short) and (_level(short) >= -70).any():
        level = _level(short)
        level = level[(level >= -70) & (level >= float(_level(short[level >= -70].mean())) - 20)]
        lra = float(np.percentile(level, 95) - np.percentile(level, 10))
    return {"lufs": round(lufs, 2), "range": round(max(0.0, lra), 2), "true_peak": round(peak, 2)}


def block_mean(x: np.ndarray, factor: int) -> np.ndarray:
    """Means of full blocks of columns; as it is for a factor of 1 or few columns."""
    n = x.shape[-1]
    if factor <= 1 or n <= factor:
        return x
    m = n // factor
    return x[..., : m * factor].reshape(*x.shape[:-1], m, factor).mean(axis=-1)


def ward_chain(x: np.ndarray, k: int) -> np.ndarray:
    """Left borders of k contiguous segments of the columns of x: neighbours whose union adds least to the variance
    are joined, one by one."""
    starts, sums, sizes = list(range(x.shape[1])), [x[:, i].copy() for i in range(x.shape[1])], [1] * x.shape[1]

    def price(i: int) -> float:
        d = sums[i] / sizes[i] - sums[i + 1] / sizes[i + 1]
        return float(d @ d) * sizes[i] * sizes[i + 1] / (sizes[i] + sizes[i + 1])

    costs = [price(i) for i in range(len(starts) - 1)]
    while len(starts) > max(1, k):
        i = int(np.argmin(costs))
        sums[i] += sums[i + 1]
        sizes[i] += sizes[i + 1]
        for v in (starts, sums, sizes):
            del v[i + 1]
        del costs[i]
        if i < len(starts) - 1:
            costs[i] = price(i)
        if i:
            costs[i - 1] = price(i - 1)
    return np.array(starts)


def sections(y: np.ndarray, features: np.ndarray | None = None, sr: int = SAMPLE_RATE, k: int = MAX_SECTIONS, least: float = MIN_SECTION_SEC) -> list[tuple[float, float, float]]:
    """(start, end, rms) of the sections of a signal; one for a short signal. features: MFCC but the first, and
    chroma, if they are known."""
    y = checked(y)
    duration = len(y) / sr
    whole = [(0.0, duration, float(np.sqrt((y**2).mean())))]
    if duration <= 2 * least:
        return whole
    factor = max(1, round(sr / HOP / STRUCTURE_FPS))
    features = block_mean(np.vstack([mfcc(stft(y))[1:], chroma_of(y)]) if features is None else features, factor)
    borders = ward_chain(features, min(k, max(2, features.shape[1] // 4))) * factor * HOP / sr
    kept: list[float] = []
    for t in borders:
        if not kept or t - kept[-1] >= least:
            kept.append(float(t))
    kept[0] = 0.0
    if len(kept) > 1 and duration - kept[-1] < least:
        kept.pop()
    kept.append(duration)
    out = []
    for a, b in zip(kept[:-1], kept[1:], strict=True):
        part = y[int(a * sr) : min(len(y), int(b * sr))]
        out.append((a, b, float(np.sqrt((part**2).mean())) if len(part) else 0.0))
    return out


def butterworth(fc: float, sr: int, high: bool) -> tuple[tuple[float, ...], tuple[float, ...]]:
    k = math.tan(math.pi * fc / sr)
    d = 1 + math.sqrt(2) * k + k * k
    b = (1 / d, -2 / d, 1 / d) if high else (k * k / d, 2 * k * k / d, k * k / d)
    return b, (1.0, 2 * (k * k - 1) / d, (1 - math.sqrt(2) * k + k * k) / d)


def split_bands(y: np.ndarray, sr: int = SAMPLE_RATE, fc: float = 150.0) -> tuple[np.ndarray, np.ndarray]:
    """Low and high band of a fourth-order Linkwitz-Riley crossover; their sum has a flat magnitude."""
    low, high = butterworth(fc, sr, False), butterworth(fc, sr, True)
    return tuple(convolved_each(y, cascade_response(low, low), cascade_response(high, high)))


def swap_voices(a: np.ndarray, b: np.ndarray, swap_at: int, swap_len: int, sr: int = SAMPLE_RATE) -> tuple[np.ndarray, np.ndarray]:
    """What two aligned parts of equal length give to a transition: highs fade at equal power over all of it, lows within
    swap_len samples from swap_at."""
    n, size = len(a), max(1, swap_len)
    down = np.cos(np.linspace(0, 1, n) * np.pi / 2)  # backwards it is the sine
    first, last = np.clip([swap_at, swap_at + size], 0, n)
    x = (np.arange(first, last) - swap_at) / size * np.pi / 2
    (a_low, a_high), (b_low, b_high) = split_bands(a, sr), split_bands(b, sr)
    a_high *= down
    b_high *= down[::-1]
    a_high[:first] += a_low[:first]
    a_high[first:last] += a_low[first:last] * np.cos(x)
    b_high[first:last] += b_low[first:last] * np.sin(x)
    b_high[last:] += b_low[last:]
    return a_high, b_high


def bass_swap(a: np.ndarray, b: np.ndarray, swap_at: int, swap_len: int, sr: int = SAMPLE_RATE) -> np.ndarray:
    """The transition of swap_voices()."""
    x, y = swap_voices(a, b, swap_at, swap_len, sr)
    return x + y


def time_stretch(y: np.ndarray, rate: float) -> np.ndarray:
    """Signal of length len(y) / rate at the same pitch, by a phase vocoder."""
    window, rows = hann(N_FFT), framed(np.pad(checked(y), N_FFT // 2))
    steps = np.arange(0, len(rows) - 1, rate)
    # a frame's phase is that of the one before, turned as the two frames of the signal are: while steps go from frame to
    # frame, that is the signal's own phase times one number of length 1 a bin, which only a longer or shorter step changes
    ahead, out, step = None, np.zeros(len(steps) * HOP + N_FFT), 16  # as many frames as stay in the cache
    most = int(step * rate) + 3
    part, frames = np.empty((most, N_FFT)), np.empty((step, N_FFT))
    spec, parts = np.empty((most, N_FFT // 2 + 1), complex), np.empty((step, N_FFT // 2 + 1), complex)
    for first in range(0, len(steps), step):
        at = steps[first : first + step]
        i = at.astype(int)
        n, f, i, source = i[-1] + 2 - i[0], (at - i)[:, None], i - i[0], rows[i[0] : i[-1] + 2]
        np.fft.rfft(np.multiply(source, window, out=part[:n]), axis=1, out=spec[:n])
        own = np.abs(spec[:n])
        none = own < 1e-290
        mags = own
        if none.any():
            spec[:n][none], own = 1, np.where(none, 1, own)
        unit = lambda k: spec[k] / own[k]  # noqa: B023, E731
        turn = np.ones(spec.shape[1]) if ahead is None else ahead * unit(0).conj()
        runs = [0, *(np.flatnonzero(np.diff(i) != 1) + 1), len(i)]
        for a, b in zip(runs[:-1], runs[1:], strict=True):
            k, m = i[a], i[a] + b - a
            if a:
                turn = turn * unit(i[a - 1] + 1) * unit(k).conj()
            gain = mags[k + 1 : m + 1] * f[a:b]
            gain += mags[k:m] * (1 - f[a:b])
            gain /= own[k:m]
            np.multiply(spec.real[k:m], gain, out=parts.real[a:b])
            np.multiply(spec.imag[k:m], gain, out=parts.imag[a:b])
            parts[a:b] *= turn
        ahead = turn / np.abs(turn) * unit(i[-1] + 1)
        done = np.fft.irfft(parts[: len(i)], axis=1, out=frames[: len(i)])
        done *= window
        for k, frame in enumerate(done, first):
            out[k * HOP : k * HOP + N_FFT] += frame
    out /= np.maximum(overlapped(len(steps)), 1e-3)
    want = round(len(y) / rate)
    return np.pad(out[N_FFT // 2 : N_FFT // 2 + want], (0, max(0, want - len(out) + N_FFT // 2)))


def overlapped(frames: int) -> np.ndarray:
    """Sum of the squared windows of overlapping frames."""
    power, hops = (hann(N_FFT) ** 2).reshape(-1, HOP), np.zeros((frames + N_FFT // HOP, HOP))
    for k, part in enumerate(power):
        hops[k : k + frames] += part
    return hops.ravel()
