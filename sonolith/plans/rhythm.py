"""Queries on rhythm, key and loudness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolith.constants import CEILING_DBTP, SILENCE_PEAK, TARGET_LUFS
from sonolith.operators import frames as R
from sonolith.operators import harmony as H
from sonolith.plans.views import FRAME, SIGNAL_SQL, signal
from sonolith.session import table

# beats stand for the signal's local peaks; beat times are in steps of half a second
BEATS_SQL = f"""{SIGNAL_SQL}, pk AS (SELECT track_id, i, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM signal WINDOW w AS (PARTITION BY track_id ORDER BY i)),
  beats AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY i) - 1 AS beat_idx, i * 0.125::DOUBLE AS t, v AS energy FROM pk WHERE p < v AND v > q)"""
OCTAVE_SQL = "CASE WHEN {b} <= 0 THEN 0 ELSE ({b} * pow(2, greatest(0, ceil(log2(70.0::DOUBLE / {b}))))) / pow(2, greatest(0, ceil(log2({b} * pow(2, greatest(0, ceil(log2(70.0::DOUBLE / {b})))) / 180.0::DOUBLE)))) END"


def _beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = R.local_peaks(signal(spark, sf_dir).select("track_id", "i", F.col("v").alias("x")))
    return peaks.select("track_id", (F.row_number().over(W.partitionBy("track_id").orderBy("i")) - 1).cast("long").alias("beat_idx"), (F.col("i") * 0.125).alias("t"), F.col("x").alias("energy"))


def octave_correction(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 7) % 400 - 10).cast("double").alias("raw"))
    return raw.select("p_partkey", "raw", F.round(H.octave_correct(F.col("raw")), 6).alias("bpm"))


OCTAVE = f"WITH r AS (SELECT p_partkey, ((p_partkey * 7) % 400 - 10)::DOUBLE AS raw FROM part) SELECT p_partkey, raw, CASE WHEN raw <= 0 THEN 0 ELSE round({OCTAVE_SQL.format(b='(CASE WHEN raw <= 0 THEN 1 ELSE raw END)')}, 6) END AS bpm FROM r"


def bpm_from_intervals(spark, sf_dir):
    beats = _beats(spark, sf_dir)
    raw = signal(spark, sf_dir).groupBy("track_id").agg((60.0 + F.max("track_id") % 97).alias("raw_bpm"))
    return H.refine_bpm(beats, raw)


BPM = f"""WITH {BEATS_SQL}, d AS (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY beat_idx) AS d FROM beats),
m AS (SELECT track_id, median(d) AS med, count(d) AS n, avg(d) AS mean_d FROM d WHERE d IS NOT NULL GROUP BY track_id),
k AS (SELECT d.track_id, count(*) FILTER (abs(d - med) < 0.25 * med) AS kept, avg(d) FILTER (abs(d - med) < 0.25 * med) AS d, any_value(med) AS med, any_value(n) AS n, any_value(mean_d) AS mean_d FROM d JOIN m ON d.track_id = m.track_id WHERE d IS NOT NULL GROUP BY d.track_id),
r AS (SELECT track_id, 60.0::DOUBLE + track_id % 97 AS raw FROM (SELECT DISTINCT track_id FROM signal)),
b AS (SELECT r.track_id, raw, mean_d, CASE WHEN coalesce(n >= 3 AND med > 0 AND kept >= 3, false) THEN 60.0::DOUBLE / d ELSE raw END AS b FROM r LEFT JOIN k ON r.track_id = k.track_id)
SELECT track_id, round({OCTAVE_SQL.format(b="b")}, 6) AS bpm, round(coalesce(mean_d, 60.0::DOUBLE / raw), 6) AS mean_interval FROM b"""


def downbeat_offset(spark, sf_dir):
    return H.best_offset(_beats(spark, sf_dir))


DOWNBEAT_SQL = f"""{BEATS_SQL}, s AS (SELECT track_id, (beat_idx % 4)::INT AS k, round(sum(energy), 6) AS score, count(*) AS n FROM beats GROUP BY ALL),
  off AS (SELECT track_id, CASE WHEN sum(n) < 4 THEN 0 ELSE arg_max(k, score * 1000 - k / 1000.0::DOUBLE) END AS k FROM s GROUP BY track_id)"""
DOWNBEAT = f"WITH {DOWNBEAT_SQL} SELECT track_id, k::INT AS k FROM off"


def phrase_grid(spark, sf_dir):
    """Beats with their bar and their phrase of 16 beats, counted from the first downbeat."""
    beats = _beats(spark, sf_dir).join(H.best_offset(_beats(spark, sf_dir)), "track_id")
    place = F.col("beat_idx") - F.col("k")
    return beats.select("track_id", "beat_idx", (F.pmod(place, F.lit(4)) == 0).alias("is_downbeat"), F.floor(place / 4).alias("bar"), F.floor(place / 16).alias("phrase"))


PHRASE = f"WITH {DOWNBEAT_SQL} SELECT b.track_id, beat_idx, (beat_idx - k + 4) % 4 = 0 AS is_downbeat, floor((beat_idx - k) / 4.0::DOUBLE)::BIGINT AS bar, floor((beat_idx - k) / 16.0::DOUBLE)::BIGINT AS phrase FROM beats b JOIN off ON b.track_id = off.track_id"


def bpm_confidence(spark, sf_dir):
    """Distinctiveness of the highest autocorrelation peak (lags 2-12), times its clipped height: the runner-up is the
    highest peak whose lag is not about twice the best one's, nor the best one's about twice its."""
    ac = R.autocorrelation(signal(spark, sf_dir).select("track_id", "i", F.col("v").alias("x")), 13)
    flat = ac.select("track_id", F.col("lag").cast("long").alias("i"), F.round("ac", 6).alias("x"))
    peaks = R.local_peaks(flat).where("i >= 2 AND i <= 12")
    best = peaks.groupBy("track_id").agg(F.min_by(F.struct("i", "x"), F.struct(-F.col("x"), "i")).alias("b"))
    octave = (F.abs(F.col("i") / F.col("b.i") - 2) < 0.15) | (F.abs(F.col("b.i") / F.col("i") - 2) < 0.15)
    rest = peaks.join(best, "track_id").where((F.col("i") != F.col("b.i")) & ~octave).groupBy("track_id").agg(F.max("x").alias("h2"))
    h1, h2 = F.col("b.x"), F.greatest(F.lit(0.0), F.coalesce("h2", F.lit(0.0)))
    score = F.when(h1 > 0, (h1 - h2) / h1 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * h1))).otherwise(0.0)
    return flat.select("track_id").distinct().join(best, "track_id", "left").join(rest, "track_id", "left").select("track_id", F.round(F.coalesce(F.greatest(F.lit(0.0), score), F.lit(0.0)), 6).alias("confidence"))


BPM_CONFIDENCE = f"""WITH {SIGNAL_SQL}, s AS (SELECT a.track_id, l.l AS lag, sum(a.v * b.v) AS s FROM signal a, range(14) l(l), signal b WHERE a.track_id = b.track_id AND b.i = a.i + l.l GROUP BY ALL),
a AS (SELECT track_id, lag, round(CASE WHEN z > 0 THEN s / z ELSE 0 END, 6) AS x FROM (SELECT *, max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY track_id) AS z FROM s)),
n AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q FROM a WINDOW w AS (PARTITION BY track_id ORDER BY lag)), pk AS (SELECT track_id, lag, x FROM n WHERE p < x AND x > q AND lag BETWEEN 2 AND 12),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY x DESC, lag) AS r FROM pk) WHERE r = 1),
h AS (SELECT pk.track_id, max(pk.x) AS h2 FROM pk JOIN b ON pk.track_id = b.track_id WHERE pk.lag <> b.lag AND abs(pk.lag::DOUBLE / b.lag - 2) >= 0.15 AND abs(b.lag::DOUBLE / pk.lag - 2) >= 0.15 GROUP BY pk.track_id)
SELECT t.track_id, round(coalesce(greatest(0, CASE WHEN b.x > 0 THEN (b.x - greatest(0, coalesce(h2, 0))) / b.x * greatest(0, least(1, 2 * b.x)) ELSE 0 END), 0), 6) AS confidence
FROM (SELECT DISTINCT track_id FROM a) t LEFT JOIN b ON t.track_id = b.track_id LEFT JOIN h ON t.track_id = h.track_id"""


def _chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), F.transform(F.slice("embedding", 41, 12), lambda x: F.abs(x.cast("double"))).alias("chroma"))


def key_estimate(spark, sf_dir):
    return H.estimate_key(_chroma(spark, sf_dir))


KEY = f"""WITH c AS (SELECT vec_id AS track_id, unnest(range(12)) AS step, abs(unnest(embedding[41:52])::DOUBLE) AS v FROM embeddings),
w AS (SELECT p, m, s, CASE m WHEN 1 THEN {list(H.MAJOR_PROFILE)}[(s - p + 12) % 12 + 1] ELSE {list(H.MINOR_PROFILE)}[(s - p + 12) % 12 + 1] END::DOUBLE AS weight FROM range(12) a(p), (VALUES (1), (0)) b(m), range(12) c(s)),
f AS (SELECT track_id, p, m, round(corr(v, weight), 9) AS r FROM c JOIN w ON c.step = w.s GROUP BY ALL),
o AS (SELECT *, row_number() OVER x AS n, lead(r) OVER x AS r2 FROM f WINDOW x AS (PARTITION BY track_id ORDER BY r DESC, p, m DESC))
SELECT track_id, p::INT AS pitch_class, CASE m WHEN 1 THEN 'major' ELSE 'minor' END AS key_mode, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][p + 1] AS key_name,
  CASE m WHEN 1 THEN ((p * 7 + 7) % 12 + 1)::VARCHAR || 'B' ELSE ((p * 7 + 4) % 12 + 1)::VARCHAR || 'A' END AS camelot,
  round(CASE WHEN r <= 1e-6 THEN 0 ELSE greatest(0, least(1, (r - r2) / r)) END, 6) AS confidence FROM o WHERE n = 1"""


def true_peak_sample(spark, sf_dir):
    peak = F.max(F.abs("v")) / 1000.0
    return signal(spark, sf_dir).groupBy("track_id").agg(F.round(F.when(peak <= 1e-6, SILENCE_PEAK).otherwise(20 * F.log10(peak)), 5).alias("peak_db"))


TRUE_PEAK = f"WITH {SIGNAL_SQL} SELECT track_id, round(CASE WHEN max(abs(v)) / 1000 <= 1e-6 THEN -80 ELSE 20 * log10(max(abs(v)) / 1000) END, 5) AS peak_db FROM signal GROUP BY track_id"

LOUD_SQL = f"{SIGNAL_SQL}, q AS (SELECT track_id, i // {FRAME} AS fr, avg(v * v) / 1e6 AS ms FROM signal GROUP BY ALL), l AS (SELECT track_id, fr, ms, CASE WHEN ms > 0 THEN -0.691 + 10 * log10(ms) ELSE -200 END AS lk FROM q)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    power = R.framed(signal(spark, sf_dir), FRAME).groupBy("track_id", "fr").agg((F.avg(F.col("v") * F.col("v")) / 1e6).alias("ms"))
    return power.withColumn("lk", F.when(F.col("ms") > 0, -0.691 + 10 * F.log10("ms")).otherwise(-200.0))


def gated_loudness(spark, sf_dir):
    """Integrated loudness by the two gates: blocks above -70, then those within 10 of the mean of these."""
    blocks = _blocks(spark, sf_dir)
    level = lambda m: F.lit(-0.691) + 10 * F.log10(m)
    gate = blocks.where("lk >= -70").groupBy("track_id").agg((level(F.avg("ms")) - 10).alias("gate"))
    loud = blocks.join(gate, "track_id").where("lk >= -70 AND lk > gate").groupBy("track_id").agg(level(F.avg("ms")).alias("lufs"))
    return blocks.select("track_id").distinct().join(loud, "track_id", "left").select("track_id", F.round(F.greatest(F.lit(-70.0), F.coalesce("lufs", F.lit(-70.0))), 4).alias("lufs"))


GATED_SQL = f"""{LOUD_SQL}, g AS (SELECT track_id, -0.691 + 10 * log10(avg(ms)) - 10 AS gate FROM l WHERE lk >= -70 GROUP BY track_id),
  i AS (SELECT l.track_id, -0.691 + 10 * log10(avg(ms)) AS lufs FROM l JOIN g ON l.track_id = g.track_id WHERE lk >= -70 AND lk > gate GROUP BY l.track_id)"""
GATED = f"WITH {GATED_SQL} SELECT t.track_id, round(greatest(-70, coalesce(lufs, -70)), 4) AS lufs FROM (SELECT DISTINCT track_id FROM l) t LEFT JOIN i ON t.track_id = i.track_id"


def loudness_range(spark, sf_dir):
    """95th less 10th percentile of the blocks above -70 and within 20 of their mean."""
    blocks = _blocks(spark, sf_dir).where("lk >= -70")
    gate = blocks.groupBy("track_id").agg((F.lit(-0.691) + 10 * F.log10(F.avg("ms")) - 20).alias("gate"))
    return blocks.join(gate, "track_id").where("lk >= gate").groupBy("track_id").agg(F.round(F.percentile("lk", 0.95) - F.percentile("lk", 0.10), 4).alias("lra"))


RANGE = f"""WITH {LOUD_SQL}, g AS (SELECT track_id, -0.691 + 10 * log10(avg(ms)) - 20 AS gate FROM l WHERE lk >= -70 GROUP BY track_id)
SELECT l.track_id, round(quantile_cont(lk, 0.95) - quantile_cont(lk, 0.10), 4) AS lra FROM l JOIN g ON l.track_id = g.track_id WHERE lk >= -70 AND lk >= gate GROUP BY l.track_id"""


def loudness_gain(spark, sf_dir):
    """Gain to the target loudness, held below the peak ceiling."""
    both = gated_loudness(spark, sf_dir).join(true_peak_sample(spark, sf_dir), "track_id")
    return both.select("track_id", F.round(F.least(F.lit(TARGET_LUFS) - F.col("lufs"), F.lit(CEILING_DBTP) - F.col("peak_db")), 3).alias("gain_db"))


GAIN = f"WITH a AS ({GATED}), b AS ({TRUE_PEAK}) SELECT a.track_id, round(least(-14 - lufs, -1 - peak_db), 3) AS gain_db FROM a JOIN b ON a.track_id = b.track_id"

QUERIES = {f.__name__: f for f in (octave_correction, bpm_from_intervals, downbeat_offset, phrase_grid, bpm_confidence, key_estimate, true_peak_sample, gated_loudness, loudness_range, loudness_gain)}
ORACLES = {"octave_correction": OCTAVE, "bpm_from_intervals": BPM, "downbeat_offset": DOWNBEAT, "phrase_grid": PHRASE, "bpm_confidence": BPM_CONFIDENCE, "key_estimate": KEY, "true_peak_sample": TRUE_PEAK, "gated_loudness": GATED, "loudness_range": RANGE, "loudness_gain": GAIN}
