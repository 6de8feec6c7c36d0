"""Queries over signals: frames, spectra, bands, onsets, peaks, blocks, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolith.operators import frames as R
from sonolith.operators import structure as T
from sonolith.plans.views import FRAME, SIGNAL_SQL, signal

N = 16  # samples of a DFT frame: 9 bins
BIN_HZ = 22050 / N
EDGES, NAMES = [1, 2, 4, 8], ["low", "mid", "high"]

RMS_SQL = f"{SIGNAL_SQL}, blocks AS (SELECT track_id, i // {FRAME} AS fr, sqrt(avg(v * v)) AS rms FROM signal GROUP BY ALL)"
DFT_SQL = f"""{SIGNAL_SQL}, w AS (SELECT n, k, cos(2 * pi() * n * k / {N}) AS c, sin(2 * pi() * n * k / {N}) AS s FROM range({N}) a(n), range({N // 2 + 1}) b(k)),
  dft AS (SELECT track_id, i // {N} AS fr, k::INT AS k, sqrt(sum(v * c) * sum(v * c) + sum(v * s) * sum(v * s)) AS mag FROM signal JOIN w ON n = i % {N} GROUP BY ALL HAVING count(*) = {N})"""
BANDS_SQL = f"""{DFT_SQL}, bp AS (SELECT track_id, fr, CASE WHEN k < 2 THEN 0 WHEN k < 4 THEN 1 ELSE 2 END AS band, sum(mag * mag) AS power FROM dft WHERE k >= 1 GROUP BY ALL),
  bl AS (SELECT track_id, fr, band, CASE WHEN max(power) OVER t <= 1e-10 THEN -80 ELSE greatest(-80, 10 * log10(greatest(1e-10, power)) - 10 * log10(max(power) OVER t)) END AS level FROM bp WINDOW t AS (PARTITION BY track_id)),
  bands AS (SELECT track_id, fr, band, (coalesce(lag(level) OVER w, level) + level + coalesce(lead(level) OVER w, level)) / 3 AS db FROM bl WINDOW w AS (PARTITION BY track_id, band ORDER BY fr))"""


def _dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dft_frames(signal(spark, sf_dir), N)


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.band_energy(_dft(spark, sf_dir), EDGES, NAMES)


def frame_rms(spark, sf_dir):
    return R.frame_rms(signal(spark, sf_dir), FRAME).select("track_id", "fr", F.round("rms", 6).alias("rms"))


FRAME_RMS = f"WITH {RMS_SQL} SELECT track_id, fr, round(rms, 6) AS rms FROM blocks"


def zero_crossings(spark, sf_dir):
    return R.zero_crossings(signal(spark, sf_dir), FRAME).select("track_id", "fr", F.round("zcr", 6).alias("zcr"))


ZERO_CROSSINGS = f"""WITH {SIGNAL_SQL}, s AS (SELECT track_id, i, CASE WHEN abs(v) <= 1e-10 THEN false ELSE v < 0 END AS s FROM signal),
f AS (SELECT track_id, i, coalesce((s <> lag(s) OVER (PARTITION BY track_id ORDER BY i))::INT, 0) AS flip FROM s)
SELECT track_id, i // {FRAME} AS fr, round(avg(flip), 6) AS zcr FROM f GROUP BY ALL"""


def smooth3_nearest(spark, sf_dir):
    w = W.partitionBy("track_id").orderBy("i")
    return signal(spark, sf_dir).select("track_id", "i", F.round(R.smooth3(F.col("v"), w), 6).alias("v"))


SMOOTH3 = f"""WITH {SIGNAL_SQL} SELECT track_id, i, round((coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v)) / 3, 6) AS v
FROM signal WINDOW w AS (PARTITION BY track_id ORDER BY i)"""


def db_topdb(spark, sf_dir):
    return signal(spark, sf_dir).select("track_id", "i", F.round(R.to_db(F.abs("v"), W.partitionBy("track_id")), 5).alias("db"))


DB_TOPDB = f"""WITH {SIGNAL_SQL}, d AS (SELECT track_id, i, 20 * log10(greatest(1e-5, abs(v))) - 20 * log10(greatest(1e-5, max(abs(v)) OVER (PARTITION BY track_id))) AS db FROM signal)
SELECT track_id, i, round(greatest(db, max(db) OVER (PARTITION BY track_id) - 80), 5) AS db FROM d"""


def dft_magnitude(spark, sf_dir):
    return _dft(spark, sf_dir).select("track_id", "fr", "k", F.round("mag", 5).alias("mag"))


DFT_MAGNITUDE = f"WITH {DFT_SQL} SELECT track_id, fr, k, round(mag, 5) AS mag FROM dft"


def centroid_bandwidth(spark, sf_dir):
    return R.moments(_dft(spark, sf_dir), F.col("k") * BIN_HZ).select("track_id", "fr", F.round("centroid", 4).alias("centroid"), F.round("bandwidth", 4).alias("bandwidth"))


CENTROID = f"""WITH {DFT_SQL}, c AS (SELECT track_id, fr, sum(mag) AS s, sum(mag * k * {BIN_HZ}) / sum(mag) AS c FROM dft GROUP BY ALL)
SELECT d.track_id, d.fr, round(any_value(c), 4) AS centroid, round(sqrt(sum(mag / s * (k * {BIN_HZ} - c) * (k * {BIN_HZ} - c))), 4) AS bandwidth
FROM dft d JOIN c ON d.track_id = c.track_id AND d.fr = c.fr GROUP BY d.track_id, d.fr"""


def rolloff(spark, sf_dir):
    return R.rolloff(_dft(spark, sf_dir), 0.85)


ROLLOFF = f"""WITH {DFT_SQL}, r AS (SELECT track_id, fr, k, sum(mag) OVER (PARTITION BY track_id, fr ORDER BY k) AS run, sum(mag) OVER (PARTITION BY track_id, fr) AS total FROM dft)
SELECT track_id, fr, min(k) AS bin FROM r WHERE round(run, 9) >= round(total * 0.85::DOUBLE, 9) GROUP BY ALL"""


def flatness(spark, sf_dir):
    return R.flatness(_dft(spark, sf_dir)).select("track_id", "fr", F.round("flatness", 5).alias("flatness"))


FLATNESS = f"WITH {DFT_SQL} SELECT track_id, fr, round(exp(avg(ln(greatest(1e-10, mag * mag)))) / avg(greatest(1e-10, mag * mag)), 5) AS flatness FROM dft GROUP BY ALL"


def band_energy(spark, sf_dir):
    return _bands(spark, sf_dir).select("track_id", "fr", "band", "name", F.round("db", 4).alias("db"))


BAND_ENERGY = f"WITH {BANDS_SQL} SELECT track_id, fr, band, ['low', 'mid', 'high'][band + 1] AS name, round(db, 4) AS db FROM bands"


def band_means(spark, sf_dir):
    return _bands(spark, sf_dir).groupBy("track_id", "name").agg(F.round(F.avg("db"), 4).alias("db"))


BAND_MEANS = f"WITH {BANDS_SQL} SELECT track_id, ['low', 'mid', 'high'][band + 1] AS name, round(avg(db), 4) AS db FROM bands GROUP BY ALL"


def onset_flux(spark, sf_dir):
    return R.onset_flux(_bands(spark, sf_dir)).select("track_id", "fr", F.round("onset", 4).alias("onset"))


ONSET_FLUX = f"""WITH {BANDS_SQL}, r AS (SELECT track_id, fr, greatest(0, coalesce(db - lag(db) OVER (PARTITION BY track_id, band ORDER BY fr), 0)) AS rise FROM bands)
SELECT track_id, fr, round(avg(rise), 4) AS onset FROM r GROUP BY ALL"""


def autocorrelation(spark, sf_dir):
    return R.autocorrelation(signal(spark, sf_dir).select("track_id", "i", F.col("v").alias("x")), 8).select("track_id", "lag", F.round("ac", 3).alias("ac"))


AUTOCORRELATION = f"""WITH {SIGNAL_SQL}, s AS (SELECT a.track_id, l.l::INT AS lag, sum(a.v * b.v) AS s FROM signal a, range(9) l(l), signal b WHERE a.track_id = b.track_id AND b.i = a.i + l.l GROUP BY ALL)
SELECT track_id, lag, round(CASE WHEN z > 0 THEN s / z ELSE 0 END, 3) AS ac FROM (SELECT *, max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY track_id) AS z FROM s)"""


def local_peaks(spark, sf_dir):
    return R.local_peaks(signal(spark, sf_dir).select("track_id", "i", F.col("v").alias("x")))


LOCAL_PEAKS = f"""WITH {SIGNAL_SQL}, p AS (SELECT track_id, i, v AS x, lag(v) OVER w AS p, lead(v) OVER w AS q FROM signal WINDOW w AS (PARTITION BY track_id ORDER BY i))
SELECT track_id, i, x FROM p WHERE p < x AND x > q"""


def waveform_peaks(spark, sf_dir):
    return R.framed(signal(spark, sf_dir), 32).groupBy("track_id", "fr").agg(F.min("v").alias("low"), F.max("v").alias("high"))


WAVEFORM_PEAKS = f"WITH {SIGNAL_SQL} SELECT track_id, i // 32 AS fr, min(v) AS low, max(v) AS high FROM signal GROUP BY ALL"


def block_downsample(spark, sf_dir):
    return R.block_mean(signal(spark, sf_dir).select("track_id", "i", F.col("v").alias("x")), 9).select("track_id", "b", F.round("x", 6).alias("x"))


BLOCK_DOWNSAMPLE = f"""WITH {SIGNAL_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS len FROM signal)
SELECT track_id, i // 9 AS b, round(avg(v), 6) AS x FROM n WHERE len > 9 GROUP BY ALL HAVING count(*) = 9 UNION ALL SELECT track_id, i, round(v, 6) FROM n WHERE len <= 9"""


def frame_alignment(spark, sf_dir):
    """Frame energies, cut or padded to the frames that centred frames of the signal give: one more than its length by
    the hop."""
    samples = signal(spark, sf_dir)
    rms = R.frame_rms(samples, FRAME)
    lengths = samples.groupBy("track_id").agg((F.floor(F.count(F.lit(1)) / FRAME) + 1).alias("n"))
    return R.align(rms.select("track_id", "fr", F.round("rms", 6).alias("x")), lengths)


FRAME_ALIGNMENT = f"""WITH {RMS_SQL}, g AS (SELECT track_id, unnest(range(count(*) // {FRAME} + 1)) AS fr FROM signal GROUP BY track_id)
SELECT g.track_id, g.fr, last_value(round(rms, 6) IGNORE NULLS) OVER (PARTITION BY g.track_id ORDER BY g.fr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x
FROM g LEFT JOIN blocks b ON b.track_id = g.track_id AND b.fr = g.fr"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frame_rms(signal(spark, sf_dir), FRAME).withColumnRenamed("fr", "sidx")


def section_labels(spark, sf_dir):
    return T.label_sections(_blocks(spark, sf_dir)).select("track_id", "sidx", F.round("e", 6).alias("e"), "label")


LABELS_SQL = f"""{RMS_SQL}, e AS (SELECT track_id, fr AS sidx, CASE WHEN max(rms) OVER t <= 1e-6 THEN 0 ELSE rms / max(rms) OVER t END AS e FROM blocks WINDOW t AS (PARTITION BY track_id)),
m AS (SELECT *, count(*) OVER t AS n, row_number() OVER (PARTITION BY track_id ORDER BY sidx) AS rn, median(e) OVER t AS med,
  first_value(sidx) OVER (PARTITION BY track_id ORDER BY round(e, 9) DESC, sidx) AS peak FROM e WINDOW t AS (PARTITION BY track_id)),
d AS (SELECT *, sidx = peak OR (rn > 1 AND rn < n AND round(e, 9) >= 0.88) AS drp FROM m),
l AS (SELECT *, round(lag(e) OVER w, 9) AS before, lead(drp) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY track_id ORDER BY sidx)),
labels AS (SELECT track_id, sidx, e, CASE WHEN drp THEN 'drop' WHEN rn = 1 THEN 'intro' WHEN rn = n THEN 'outro' WHEN nxt AND round(e, 9) > before THEN 'build'
  WHEN round(e, 9) <= round(med, 9) THEN 'breakdown' WHEN round(e, 9) > before THEN 'build' ELSE 'breakdown' END AS label FROM l)"""
SECTION_LABELS = f"WITH {LABELS_SQL} SELECT track_id, sidx, round(e, 6) AS e, label FROM labels"


def section_summary(spark, sf_dir):
    """Sections of each label: count, length in samples and mean energy."""
    labels = T.label_sections(_blocks(spark, sf_dir))
    return labels.groupBy("track_id", "label").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * FRAME).alias("samples"), F.round(F.avg("e"), 5).alias("e"))


SECTION_SUMMARY = f"WITH {LABELS_SQL} SELECT track_id, label, count(*) AS n, count(*) * {FRAME} AS samples, round(avg(e), 5) AS e FROM labels GROUP BY ALL"


def section_rms(spark, sf_dir):
    """Energies of sections of 10 + track_id % 7 samples, over samples that do not start at their borders."""
    s = signal(spark, sf_dir)
    size = 10 + F.col("track_id") % 7
    ends = s.groupBy("track_id").agg(F.max("i").alias("last"))
    sections = ends.select("track_id", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / size))).alias("sidx")).select("track_id", "sidx", (F.col("sidx") * F.col("size")).alias("lo"), ((F.col("sidx") + 1) * F.col("size")).alias("hi"))
    return T.section_rms(s, sections).select("track_id", "sidx", F.round("rms", 6).alias("rms"))


SECTION_RMS = f"WITH {SIGNAL_SQL} SELECT track_id, i // (10 + track_id % 7) AS sidx, round(sqrt(avg(v * v)), 6) AS rms FROM signal GROUP BY ALL"


def section_boundaries(spark, sf_dir):
    """Peaks of a signal as boundaries that keep a distance of 5 samples."""
    s = signal(spark, sf_dir)
    peaks = R.local_peaks(s.select("track_id", "i", F.col("v").alias("x"))).groupBy("track_id").agg(F.array_sort(F.collect_list(F.col("i").cast("double"))).alias("times"))
    ends = s.groupBy("track_id").agg((F.max("i") + 1).cast("double").alias("end"))
    kept = peaks.join(ends, "track_id").select("track_id", T.keep_boundaries(F.col("times"), F.col("end"), 5.0).alias("b"))
    return kept.select("track_id", F.posexplode("b").alias("pos", "t"))


SECTION_BOUNDARIES = f"""WITH RECURSIVE {SIGNAL_SQL}, p AS (SELECT track_id, i, v AS x, lag(v) OVER w AS p, lead(v) OVER w AS q FROM signal WINDOW w AS (PARTITION BY track_id ORDER BY i)),
k AS (SELECT track_id, list(i::DOUBLE ORDER BY i) AS times FROM p WHERE p < x AND x > q GROUP BY track_id),
e AS (SELECT track_id, (max(i) + 1)::DOUBLE AS fin FROM signal GROUP BY track_id),
r AS (SELECT k.track_id, times, fin, 1 AS j, []::DOUBLE[] AS kept FROM k JOIN e ON k.track_id = e.track_id
  UNION ALL SELECT track_id, times, fin, j + 1, CASE WHEN len(kept) = 0 OR times[j] - kept[-1] >= 5 THEN list_append(kept, times[j]) ELSE kept END FROM r WHERE j <= len(times)),
f AS (SELECT track_id, CASE WHEN len(kept) > 1 AND fin - kept[-1] < 5 THEN list_append(kept[1:len(kept) - 1], fin) ELSE list_append(kept, fin) END AS b FROM r WHERE j = len(times) + 1)
SELECT track_id, (unnest(range(len(b))))::INT AS pos, unnest(b) AS t FROM f"""


def sections_json(spark, sf_dir):
    labels = T.label_sections(_blocks(spark, sf_dir))
    timed = labels.select("track_id", "sidx", (F.col("sidx") * 0.5).alias("start"), ((F.col("sidx") + 1) * 0.5).alias("end"), "label", F.round("e", 2).alias("e"))
    return T.sections_json(timed)


SECTIONS_JSON = f"""WITH {LABELS_SQL}, o AS (SELECT track_id, sidx, '{{"start":' || (sidx * 0.5::DOUBLE)::VARCHAR || ',"end":' || ((sidx + 1) * 0.5::DOUBLE)::VARCHAR || ',"label":"' || label || '","energy":' || round(e, 2)::VARCHAR || '}}' AS j FROM labels)
SELECT track_id, '[' || string_agg(j, ',' ORDER BY sidx) || ']' AS sections FROM o GROUP BY track_id"""

QUERIES = {f.__name__: f for f in (frame_rms, zero_crossings, smooth3_nearest, db_topdb, dft_magnitude, centroid_bandwidth, rolloff, flatness, band_energy, band_means, onset_flux, autocorrelation, local_peaks, waveform_peaks, block_downsample, frame_alignment, section_labels, section_summary, section_rms, section_boundaries, sections_json)}
ORACLES = {
    "frame_rms": FRAME_RMS, "zero_crossings": ZERO_CROSSINGS, "smooth3_nearest": SMOOTH3, "db_topdb": DB_TOPDB, "dft_magnitude": DFT_MAGNITUDE, "centroid_bandwidth": CENTROID, "rolloff": ROLLOFF,
    "flatness": FLATNESS, "band_energy": BAND_ENERGY, "band_means": BAND_MEANS, "onset_flux": ONSET_FLUX, "autocorrelation": AUTOCORRELATION, "local_peaks": LOCAL_PEAKS, "waveform_peaks": WAVEFORM_PEAKS,
    "block_downsample": BLOCK_DOWNSAMPLE, "frame_alignment": FRAME_ALIGNMENT, "section_labels": SECTION_LABELS, "section_summary": SECTION_SUMMARY, "section_rms": SECTION_RMS,
    "section_boundaries": SECTION_BOUNDARIES, "sections_json": SECTIONS_JSON,
}
