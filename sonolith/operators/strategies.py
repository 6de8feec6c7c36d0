"""Strategies of a mix: where one track gives way to the next, and how the two are rendered."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

from sonolith.constants import SAMPLE_RATE
from sonolith.functions import kernels as K

#: Lengths of a transition in beats, the one tried first ahead.
LENGTHS = (32, 16)
SWAP = (0.50, 0.58, 0.66)  # earliest, best and latest place of the basses' swap, as shares of the transition


@dataclass(frozen=True)
class Plan:
    """out_at: seconds into the first track; in_at: seconds into the second; beats, seconds: the transition's length;
    swap_at, swap_sec: when within it the basses swap, and for how long."""

    out_at: float
    in_at: float
    beats: int
    seconds: float
    swap_at: float
    swap_sec: float


class MixStrategy(Protocol):
    def choose_points(self, a: dict, b: dict) -> Plan: ...

    def render(self, a: np.ndarray, b: np.ndarray, plan: Plan) -> np.ndarray: ...


def _exit(track: dict, seconds: float) -> float | None:
    """The section border in the last third, at least 60 % in and `seconds` before the end, an outro's first, the
    latest; put on the nearest downbeat that leaves as much."""
    end = track["duration"]
    if seconds * 3 > end * (1 + 1e-9):  # no border of the last third leaves as much, whatever the sections are
        return None
    fits = [(s["label"] == "outro", s["start"]) for s in track["sections"] if s["start"] * 3 >= end * 2 and s["start"] * 10 >= end * 6 and s["start"] + seconds <= end]
    if not fits:
        return None
    at = max(fits)[1]
    return min((d for d in track["downbeats"] if 0.6 * end <= d <= end - seconds), key=lambda d: (abs(d - at), d), default=at)


def _entry(track: dict) -> float:
    """The first downbeat at or after the border in the first third, an intro's first, the earliest."""
    fits = [(s["label"] != "intro", s["start"]) for s in track["sections"] if s["start"] * 3 <= track["duration"]]
    at = min(fits)[1] if fits else 0.0
    return min((d for d in track["downbeats"] if d >= at), default=at)


def points(a: dict, b: dict) -> Plan:
    """Points of a transition between tracks described by describe() and their `duration`. Where no border leaves 32 or
    16 beats, the transition is the last 16 beats, at most 40 % of the track."""
    beat = 60.0 / a["bpm"] if a["bpm"] > 0 else 0.5
    for beats in LENGTHS:
        out_at = _exit(a, beats * beat)
        if out_at is not None:
            break
    else:
        beats = max(1, min(LENGTHS[-1], int(0.4 * a["duration"] / beat)))
        out_at = max(0.0, a["duration"] - beats * beat)
    seconds, in_at = beats * beat, _entry(b)
    early, best, late = (out_at + s * seconds for s in SWAP)
    swap = min((d for d in a["downbeats"] if early <= d <= late), key=lambda d: (abs(d - best), d), default=best) - out_at
    # the second track's drop brings its bass, where it comes within the span
    drop = [s["start"] - in_at for s in b["sections"] if s["label"] == "drop" and SWAP[0] * seconds <= s["start"] - in_at <= SWAP[2] * seconds]
    return Plan(float(out_at), float(in_at), beats, seconds, float(drop[0] if drop else swap), beat)


def _parts(a: np.ndarray, b: np.ndarray, plan: Plan, rate: int = SAMPLE_RATE) -> tuple[np.ndarray, np.ndarray]:
    """The samples of both tracks within the transition, of equal length, as floats; where one is short, zeros."""
    n, i, j = int(plan.seconds * rate), int(plan.out_at * rate), int(plan.in_at * rate)
    return tuple(np.pad(x[:n], (0, max(0, n - len(x[:n])))) for x in (a[i:].astype(float), b[j:].astype(float)))


class SimpleCrossfade:
    """Equal-power fades over the whole transition."""

    def choose_points(self, a: dict, b: dict) -> Plan:
        return points(a, b)

    def voices(self, a: np.ndarray, b: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
        x, y = _parts(a, b, plan)
        t = np.linspace(0, 1, len(x)) * np.pi / 2
        return x * np.cos(t), y * np.sin(t)

    def render(self, a: np.ndarray, b: np.ndarray, plan: Plan) -> np.ndarray:
        return sum(self.voices(a, b, plan))


class EqSwapCrossfade(SimpleCrossfade):
    """Highs fade over the whole transition; the basses swap within a beat."""

    def voices(self, a: np.ndarray, b: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
        return K.swap_voices(*_parts(a, b, plan), int(plan.swap_at * SAMPLE_RATE), int(plan.swap_sec * SAMPLE_RATE))


def bass_overlap(x: np.ndarray, y: np.ndarray, within_db: float = 20.0) -> float:
    """Seconds in which both voices of a transition have bass (20 to 150 Hz): frames where each is at most within_db
    below the louder voice's loudest frame."""
    if not len(x) or not len(y):
        return 0.0
    inside = np.flatnonzero((K.frequencies() >= 20) & (K.frequencies() <= 150))
    bass = [K.bin_powers(v, int(inside[0]), int(inside[-1]) + 1).sum(axis=0) for v in (x, y)]
    floor = max(b.max() for b in bass) * 10 ** (-within_db / 10)
    return float(((bass[0] > floor) & (bass[1] > floor)).sum() * K.HOP / SAMPLE_RATE) if floor > 0 else 0.0
