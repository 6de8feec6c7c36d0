"""Key and tempo relations between tracks, as column expressions and joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolith.constants import BEATS_PER_BAR, MAJOR_PROFILE, MINOR_PROFILE, PITCH_NAMES, TEMPO_RANGE, TEMPO_TOLERANCE


def camelot_number(pitch: Column, major: Column) -> Column:
    """Place 1-12 on the wheel of fifths; pitch 0 is C."""
    return (F.when(major, pitch * 7 + 7).otherwise(pitch * 7 + 4) % 12 + 1).cast("int")


def camelot_code(pitch: Column, major: Column) -> Column:
    return F.concat(camelot_number(pitch, major).cast("string"), F.when(major, "B").otherwise("A"))


def pitch_name(pitch: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PITCH_NAMES)), F.pmod(pitch, F.lit(12)).cast("int") + 1)


def wheel_distance(number_a: Column, major_a: Column, number_b: Column, major_b: Column) -> Column:
    """0 same, 1 relative or next, 2 two steps in the same mode, else 99."""
    step = F.least(F.pmod(number_a - number_b, F.lit(12)), F.pmod(number_b - number_a, F.lit(12)))
    same = major_a == major_b
    return F.when(same & (step <= 2), step).when(~same & (step == 0), 1).otherwise(99).cast("int")


def octave_correct(bpm: Column, low: float = TEMPO_RANGE[0], high: float = TEMPO_RANGE[1]) -> Column:
    """Tempo doubled while below low, then halved while above high; 0 if not positive. In closed form."""
    up = F.greatest(F.lit(0.0), F.ceil(F.log2(F.lit(low) / bpm)))
    raised = bpm * F.pow(F.lit(2.0), up)
    down = F.greatest(F.lit(0.0), F.ceil(F.log2(raised / F.lit(high))))
    return F.when(bpm <= 0, 0.0).otherwise(raised / F.pow(F.lit(2.0), down))


def octave_buckets(tolerance: float) -> int:
    """Buckets of the octave such that tempi within the tolerance, up to octaves, are in the same or the next one."""
    return int(1 / -math.log2(1 - tolerance))


def tempo_join(left: DataFrame, right: DataFrame, tolerance: float = TEMPO_TOLERANCE) -> DataFrame:
    """Pairs of left (a_bpm10, ...) and right (b_bpm10, ...) whose tempi in tenths of BPM agree within the tolerance,
    as they are, doubled or halved; gap2 is twice the least difference. An equi-join on buckets of the octave: each
    left row goes to its own bucket and the two beside it, so no pair is met twice."""
    n = octave_buckets(tolerance)
    place = lambda c: F.floor(F.pmod(F.log2(F.col(c).cast("double")), F.lit(1.0)) * n).cast("int")
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(place("a_bpm10") + d, F.lit(n))))
    a, b = F.col("a_bpm10"), F.col("b_bpm10")
    gap2 = F.least(F.abs(b - a) * 2, F.abs(b * 2 - a) * 2, F.abs(b - a * 2))
    joined = left.withColumn("__bucket", F.explode(near)).join(right.withColumn("__bucket", place("b_bpm10")), "__bucket")
    return joined.drop("__bucket").withColumn("gap2", gap2).where(F.col("gap2") * 100 <= a * (2 * round(tolerance * 100)))


def key_profiles() -> list[tuple[int, int, int, float]]:
    """(pitch, major, step, weight): the 24 rotated profiles."""
    return [(p, m, s, float(profile[(s - p) % 12])) for m, profile in ((1, MAJOR_PROFILE), (0, MINOR_PROFILE)) for p in range(12) for s in range(12)]


def estimate_key(chroma: DataFrame) -> DataFrame:
    """track_id, pitch_class, major, camelot, r1, r2, confidence from chroma (track_id, chroma array of 12).

    Pearson correlation with 24 rotated profiles; the best wins, ties by pitch, then major. Confidence is
    (r1 - r2) / r1 in [0, 1]. Silent or flat chroma: C major, 0."""
    spark = chroma.sparkSession
    profiles = spark.createDataFrame(key_profiles(), "pitch int, major int, step int, weight double")
    steps = chroma.select("track_id", F.posexplode("chroma").alias("step", "v"))
    fits = steps.join(F.broadcast(profiles), "step").groupBy("track_id", "pitch", "major").agg(F.corr("v", "weight").alias("r"), F.sum("v").alias("total"), F.stddev_pop("v").alias("spread"))
    fits = fits.withColumn("r", F.round(F.coalesce(F.when(F.isnan("r"), 0.0).otherwise(F.col("r")), F.lit(0.0)), 9))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("neg"), "pitch", (1 - F.col("major")).alias("minor"))))
    top = fits.groupBy("track_id").agg(ranked.alias("t"), F.max("total").alias("total"), F.max("spread").alias("spread"))
    flat = (F.col("total") <= 1e-6) | (F.col("spread") <= 1e-6)
    best = lambda field, default: F.when(flat, default).otherwise(F.col("t")[0][field])
    r1, r2 = -F.col("t")[0]["neg"], -F.col("t")[1]["neg"]
    out = top.select(
        "track_id",
        best("pitch", F.lit(0)).alias("pitch_class"),
        best("minor", F.lit(0)).alias("minor"),
        F.when(flat | (r1 <= 1e-6), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r1 - r2) / r1))).alias("confidence"),
    )
    major = F.col("minor") == 0
    return out.select("track_id", "pitch_class", F.when(major, "major").otherwise("minor").alias("key_mode"), pitch_name(F.col("pitch_class")).alias("key_name"), camelot_code(F.col("pitch_class"), major).alias("camelot"), F.round("confidence", 6).alias("confidence"))


def best_offset(beats: DataFrame, per_bar: int = BEATS_PER_BAR) -> DataFrame:
    """track_id, k: the beat of the bar whose energies (beat_idx, energy) have the largest sum, the first of equals;
    0 for fewer beats than a bar."""
    by = beats.groupBy("track_id", (F.col("beat_idx") % per_bar).alias("k")).agg(F.round(F.sum("energy"), 6).alias("score"), F.count(F.lit(1)).alias("n"))
    top = by.groupBy("track_id").agg(F.min_by("k", F.struct(-F.col("score"), "k")).alias("k"), F.sum("n").alias("n"))
    return top.select("track_id", F.when(F.col("n") < per_bar, 0).otherwise(F.col("k")).cast("int").alias("k"))


def beat_intervals(beats: DataFrame) -> DataFrame:
    """track_id, d: differences of successive beat times t."""
    w = W.partitionBy("track_id").orderBy("beat_idx")
    return beats.select("track_id", (F.col("t") - F.lag("t").over(w)).alias("d")).where("d IS NOT NULL")


def refine_bpm(beats: DataFrame, raw: DataFrame) -> DataFrame:
    """track_id, bpm, mean_interval: tempo from the intervals that lie within a quarter of the median, else the raw
    tempo (raw: track_id, raw_bpm); corrected by octaves."""
    d = beat_intervals(beats)
    med = d.groupBy("track_id").agg(F.percentile("d", 0.5).alias("med"), F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"))
    near = F.abs(F.col("d") - F.col("med")) < F.col("med") * 0.25
    kept = d.join(med, "track_id").groupBy("track_id").agg(F.count_if(near).alias("kept"), F.avg(F.when(near, F.col("d"))).alias("d"), F.first("med").alias("med"), F.first("n").alias("n"), F.first("mean_d").alias("mean_d"))
    joined = raw.join(kept, "track_id", "left")
    use = (F.col("n") >= 3) & (F.col("med") > 0) & (F.col("kept") >= 3)
    bpm = octave_correct(F.when(F.coalesce(use, F.lit(False)), 60.0 / F.col("d")).otherwise(F.col("raw_bpm")))
    mean_interval = F.coalesce("mean_d", F.when(F.col("raw_bpm") > 0, 60.0 / F.col("raw_bpm")).otherwise(0.0))
    return joined.select("track_id", F.round(bpm, 6).alias("bpm"), F.round(mean_interval, 6).alias("mean_interval"))
