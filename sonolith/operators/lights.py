"""Light timelines as relational operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.constants import GAMMA, LIGHT_FPS
from sonolith.operators.structure import spaced

# Colour and weight by band, palette by section label.
BAND_COLOURS = {"sub": (255, 0, 51, 1.0), "bass": (255, 102, 0, 0.8), "mid": (0, 204, 102, 0.6), "presence": (0, 102, 255, 0.5), "brilliance": (255, 255, 255, 0.3)}
PALETTES = {"intro": (0, 17, 51), "build": (51, 0, 102), "drop": (255, 0, 51), "breakdown": (0, 51, 68), "outro": (17, 0, 34)}


def timeline(tracks: DataFrame, fps: int = LIGHT_FPS) -> DataFrame:
    """track_id, frame, t for tracks (track_id, seconds)."""
    grid = tracks.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("seconds") * fps).cast("long") - 1)).alias("frame"))
    return grid.withColumn("t", F.col("frame") / float(fps))


def gamma(value: Column) -> Column:
    return F.rint(255.0 * F.pow(value / 255.0, F.lit(GAMMA))).cast("int")


def decay(values: Column, a: float) -> Column:
    """Attack at once, fall by the share a: the last of the levels, one by one, as an array. An Arrow kernel: one pass
    over each array, where a fold of array expressions would copy the result at every step."""

    @F.pandas_udf("array<double>")
    def falling(rows: pd.Series) -> pd.Series:
        def one(levels: np.ndarray) -> list[float]:
            out, now = [], None
            for x in levels.tolist():
                now = x if now is None or x > now else now + (x - now) * a
                out.append(now)
            return out

        return rows.map(one, na_action="ignore")

    return falling(values)


def flash(since: Column, decay_s: float = 0.12, intensity: float = 0.9) -> Column:
    """Brightness a time after a downbeat: linear decay; none before the first."""
    return F.coalesce(F.when((since >= 0) & (since < decay_s), intensity * (1.0 - since / decay_s)), F.lit(0.0))


def fixture_pixels(fixtures: DataFrame) -> DataFrame:
    """universe pixel, id, role, place of each fixture (id, offset, count, role)."""
    return fixtures.select("id", "role", "offset", F.posexplode(F.sequence(F.lit(1), F.col("count"))).alias("place", "x")).select((F.col("offset") + F.col("place")).cast("int").alias("pixel"), "id", "role", F.col("place").cast("int").alias("place"))


def clock_index(position_s: Column, latency_ms: Column, fps: int = LIGHT_FPS) -> Column:
    """Frame of a playing position: (position + latency) * fps, cut to an integer, at least 0."""
    return F.greatest(F.lit(0), ((position_s + latency_ms / 1000.0) * fps).cast("int"))


def limit_flashes(times: Column, per_second: float = 3.0) -> Column:
    """Sorted flash times, without those less than 1/per_second after the last kept one."""
    return spaced(times, F.lit(1.0 / per_second - 1e-9))


def limit_power(rgb_sum: Column, budget: float) -> Column:
    """Factor that keeps the sum of all channels within the budget."""
    return F.least(F.lit(1.0), budget / F.greatest(F.lit(1e-9), rgb_sum))


def crossfade(since: Column, length_s: float = 2.0) -> Column:
    """Share of the new palette a time after a section's border."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), since / length_s))


def strip_current(channel_sum: Column, pixels: int = 300, channel_amps: float = 0.02) -> Column:
    """Current in amperes of a strip whose pixels all have channels of that sum."""
    return channel_sum / 255.0 * (channel_amps * pixels)
