"""Queries on transitions, mixes and light timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolith.operators import frames as R
from sonolith.operators import harmony as H
from sonolith.operators import lights as L
from sonolith.operators import structure as T
from sonolith.plans.rhythm import BEATS_SQL, DOWNBEAT_SQL, _beats
from sonolith.plans.signals import BANDS_SQL, LABELS_SQL, N, _bands
from sonolith.plans.views import FRAME, SIGNAL_SQL, signal
from sonolith.session import table

STEP = 0.125  # seconds of a sample of the stand-in signals

DOWN_SQL = f"{DOWNBEAT_SQL}, db AS (SELECT b.track_id, t FROM beats b JOIN off ON b.track_id = off.track_id WHERE (beat_idx - k + 4) % 4 = 0)"
ENDS_SQL = f"ends AS (SELECT track_id, count(*) * {STEP}::DOUBLE AS seconds FROM signal GROUP BY track_id)"


def _downbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = _beats(spark, sf_dir)
    return beats.join(H.best_offset(beats), "track_id").where(F.pmod(F.col("beat_idx") - F.col("k"), F.lit(4)) == 0).select("track_id", "t")


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).groupBy("track_id").agg((F.count(F.lit(1)) * STEP).alias("seconds"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = R.frame_rms(signal(spark, sf_dir), FRAME).withColumnRenamed("fr", "sidx")
    return T.label_sections(blocks).withColumn("t", F.col("sidx") * (FRAME * STEP))


def transition_points(spark, sf_dir):
    """Exit: the section border in the last third, at least 60 % in and 1 s before the end, an outro's first, the
    latest. Entry: the first downbeat at or after the border in the first third, an intro's first, the earliest."""
    ends = _ends(spark, sf_dir)
    borders = _sections(spark, sf_dir).join(ends, "track_id")
    late = borders.where((F.col("t") * 3 >= F.col("seconds") * 2) & (F.col("t") * 10 >= F.col("seconds") * 6) & (F.col("t") + 1.0 <= F.col("seconds")))
    out = late.groupBy("track_id").agg(F.max_by("t", F.struct((F.col("label") == "outro").cast("int"), "t")).alias("out_at"))
    early = borders.where(F.col("t") * 3 <= F.col("seconds"))
    start = early.groupBy("track_id").agg(F.min_by("t", F.struct((F.col("label") != "intro").cast("int"), "t")).alias("entry"))
    first = start.join(_downbeats(spark, sf_dir), "track_id", "left").groupBy("track_id", "entry").agg(F.min(F.when(F.col("t") >= F.col("entry"), F.col("t"))).alias("down"))
    return ends.select("track_id").join(out, "track_id", "left").join(first, "track_id", "left").select("track_id", "out_at", F.coalesce("down", "entry").alias("in_at"))


TRANSITIONS = f"""WITH {LABELS_SQL}, {DOWN_SQL.replace(SIGNAL_SQL + ', ', '', 1)}, {ENDS_SQL},
b AS (SELECT l.track_id, label, sidx * {FRAME * STEP}::DOUBLE AS t, seconds FROM labels l JOIN ends e ON l.track_id = e.track_id),
o AS (SELECT track_id, t AS out_at FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY (label = 'outro') DESC, t DESC) AS r FROM b WHERE t * 3 >= seconds * 2 AND t * 10 >= seconds * 6 AND t + 1 <= seconds) WHERE r = 1),
st AS (SELECT track_id, t AS entry FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY (label <> 'intro'), t) AS r FROM b WHERE t * 3 <= seconds) WHERE r = 1),
f AS (SELECT st.track_id, entry, min(db.t) FILTER (db.t >= entry) AS down FROM st LEFT JOIN db ON st.track_id = db.track_id GROUP BY ALL)
SELECT e.track_id, out_at, coalesce(down, entry) AS in_at FROM ends e LEFT JOIN o ON e.track_id = o.track_id LEFT JOIN f ON e.track_id = f.track_id"""


def tempo_match(spark, sf_dir):
    """Stretch ratio and offset of each track against the one before it in its brand's set."""
    w = W.partitionBy("p_brand").orderBy("p_partkey")
    bpm = (700 + (F.col("p_partkey") * 37) % 1100) / 10.0
    t = table(spark, sf_dir, "part").select("p_brand", "p_partkey", bpm.alias("bpm"), (F.col("p_partkey") % 50 / 10.0).alias("down")).withColumns({"pb": F.lag("bpm").over(w), "pd": F.lag("down").over(w)}).where("pb IS NOT NULL")
    ratio = F.col("pb") / F.col("bpm")
    return t.select("p_partkey", F.round(ratio, 6).alias("ratio"), F.round(F.col("pd") - F.col("down") * ratio, 6).alias("offset"), (F.abs(ratio - 1.0) <= 0.06).alias("inaudible"))


TEMPO_MATCH = """WITH t AS (SELECT p_brand, p_partkey, (700 + (p_partkey * 37) % 1100) / 10.0::DOUBLE AS bpm, (p_partkey % 50) / 10.0::DOUBLE AS down FROM part),
p AS (SELECT *, lag(bpm) OVER w AS pb, lag(down) OVER w AS pd FROM t WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
SELECT p_partkey, round(pb / bpm, 6) AS ratio, round(pd - down * (pb / bpm), 6) AS "offset", abs(pb / bpm - 1.0) <= 0.06 AS inaudible FROM p WHERE pb IS NOT NULL"""


def equal_power_gains(spark, sf_dir):
    t = F.col("id") / 255.0
    return spark.range(256).select("id", F.round(F.cos(t * F.pi() / 2), 9).alias("fade_out"), F.round(F.sin(t * F.pi() / 2), 9).alias("fade_in"))


EQUAL_POWER = "SELECT i AS id, round(cos(i / 255.0::DOUBLE * pi() / 2), 9) AS fade_out, round(sin(i / 255.0::DOUBLE * pi() / 2), 9) AS fade_in FROM range(256) t(i)"


def overlap_add(spark, sf_dir):
    """Tracks 2k and 2k + 1 in one line: the second begins 16 samples before the first ends, with equal-power fades."""
    s, size = signal(spark, sf_dir), 16
    n = s.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    pair = F.floor(F.col("track_id") / 2)
    first = n.where("track_id % 2 = 0").select(pair.alias("pair"), F.col("n").alias("n0"))
    both = s.withColumn("pair", pair).join(first, "pair").where(F.col("n0") >= size)
    x = (F.when(F.col("track_id") % 2 == 0, F.col("i") - (F.col("n0") - size)).otherwise(F.col("i")) / float(size - 1)) * F.pi() / 2
    fade = F.when((F.col("track_id") % 2 == 0) & (F.col("i") >= F.col("n0") - size), F.cos(x)).when((F.col("track_id") % 2 == 1) & (F.col("i") < size), F.sin(x)).otherwise(1.0)
    at = F.when(F.col("track_id") % 2 == 0, F.col("i")).otherwise(F.col("i") + F.col("n0") - size)
    return both.groupBy("pair", at.alias("i")).agg(F.round(F.sum(F.col("v") * fade), 5).alias("v"), F.count(F.lit(1)).alias("voices"))


OVERLAP = f"""WITH {SIGNAL_SQL}, n AS (SELECT track_id // 2 AS pair, count(*) AS n0 FROM signal WHERE track_id % 2 = 0 GROUP BY track_id),
g AS (SELECT pair, CASE WHEN track_id % 2 = 0 THEN i ELSE i + n0 - 16 END AS i, v * CASE WHEN track_id % 2 = 0 AND i >= n0 - 16 THEN cos((i - (n0 - 16)) / 15.0::DOUBLE * pi() / 2) WHEN track_id % 2 = 1 AND i < 16 THEN sin(i / 15.0::DOUBLE * pi() / 2) ELSE 1 END AS v
  FROM signal s JOIN n ON s.track_id // 2 = n.pair WHERE n0 >= 16)
SELECT pair, i, round(sum(v), 5) AS v, count(*) AS voices FROM g GROUP BY ALL"""


def seam_fade(spark, sf_dir):
    """A fade of three samples at both ends of each signal."""
    w = W.partitionBy("track_id")
    s = signal(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(w))
    gain = F.least(F.lit(1.0), (F.col("i") + 1) / 4.0, (F.col("n") - F.col("i")) / 4.0)
    return s.select("track_id", "i", F.round(F.col("v") * gain, 6).alias("v"))


SEAM = f"WITH {SIGNAL_SQL} SELECT track_id, i, round(v * least(1, (i + 1) / 4.0::DOUBLE, (count(*) OVER (PARTITION BY track_id) - i) / 4.0::DOUBLE), 6) AS v FROM signal"


def mix_checks(spark, sf_dir):
    """Steps in loudness of more than 2 between successive blocks of a signal."""
    w = W.partitionBy("track_id").orderBy("fr")
    level = R.frame_rms(signal(spark, sf_dir), FRAME).withColumn("db", F.when(F.col("rms") > 0, 20 * F.log10("rms")).otherwise(-80.0))
    steps = level.withColumn("jump", F.abs(F.col("db") - F.lag("db").over(w))).where("jump IS NOT NULL")
    return steps.groupBy("track_id").agg(F.count_if(F.col("jump") > 2).alias("loud_jumps"), F.round(F.max("jump"), 4).alias("largest"))


MIX_CHECKS = f"""WITH {LABELS_SQL.split(', e AS (', 1)[0]}, d AS (SELECT track_id, fr, CASE WHEN rms > 0 THEN 20 * log10(rms) ELSE -80 END AS db FROM blocks),
j AS (SELECT track_id, abs(db - lag(db) OVER (PARTITION BY track_id ORDER BY fr)) AS jump FROM d)
SELECT track_id, count(*) FILTER (jump > 2) AS loud_jumps, round(max(jump), 4) AS largest FROM j WHERE jump IS NOT NULL GROUP BY track_id"""

GRID_SQL = f"{ENDS_SQL}, steps AS (SELECT track_id, unnest(range(floor(seconds * 60)::BIGINT)) AS frame FROM ends), grid AS (SELECT track_id, frame, frame / 60.0::DOUBLE AS t FROM steps)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.timeline(_ends(spark, sf_dir))


def light_frames_asof(spark, sf_dir):
    """Each light frame with the energy and the label of the section it lies in, and its colour."""
    s = _sections(spark, sf_dir).select("track_id", "t", "label", "e")
    seen = R.as_of(_grid(spark, sf_dir), s, ["label", "e"])
    part = lambda k: F.rint(F.round(F.element_at(F.create_map(*[x for n, c in L.PALETTES.items() for x in (F.lit(n), F.lit(float(c[k])))]), F.col("label")) * F.col("e"), 6)).cast("int")
    return seen.select("track_id", "frame", "label", *[part(k).alias(n) for k, n in enumerate(("r", "g", "b"))])


LIGHT_FRAMES = f"""WITH {LABELS_SQL}, {GRID_SQL}, s AS (SELECT track_id, sidx * {FRAME * STEP}::DOUBLE AS t, label, e FROM labels),
a AS (SELECT g.track_id, frame, label, e FROM grid g ASOF JOIN s ON g.track_id = s.track_id AND g.t >= s.t)
SELECT track_id, frame, label, {", ".join("round_even(round(CASE label " + " ".join(f"WHEN '{n}' THEN {c[k]}" for n, c in L.PALETTES.items()) + f" END * e, 6), 0)::INT AS {x}" for k, x in enumerate("rgb"))} FROM a"""


def beat_flash(spark, sf_dir):
    downs = _downbeats(spark, sf_dir).withColumn("at", F.col("t"))
    seen = R.as_of(_grid(spark, sf_dir), downs, ["at"])
    return seen.select("track_id", "frame", F.round(L.flash(F.col("t") - F.col("at")), 5).alias("level"))


BEAT_FLASH = f"""WITH {DOWN_SQL}, {GRID_SQL}, a AS (SELECT g.track_id, frame, g.t - db.t AS since FROM grid g ASOF LEFT JOIN db ON g.track_id = db.track_id AND g.t >= db.t)
SELECT track_id, frame, round(coalesce(CASE WHEN since >= 0 AND since < 0.12::DOUBLE THEN 0.9::DOUBLE * (1 - since / 0.12::DOUBLE) END, 0), 5) AS level FROM a"""


def asymmetric_decay(spark, sf_dir):
    levels = signal(spark, sf_dir).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("i", F.abs("v").alias("v")))).alias("s"))
    falling = levels.select("track_id", L.decay(F.transform("s", lambda x: x["v"]), 1.0 / 3).alias("d"))
    return falling.select("track_id", F.posexplode("d").alias("i", "level")).select("track_id", "i", F.round("level", 4).alias("level"))


DECAY = f"""WITH RECURSIVE {SIGNAL_SQL}, r AS (SELECT track_id, i, abs(v) AS cur FROM signal WHERE i = 0
  UNION ALL SELECT s.track_id, s.i, CASE WHEN abs(s.v) > r.cur THEN abs(s.v) ELSE r.cur + (abs(s.v) - r.cur) * (1.0::DOUBLE / 3) END FROM r JOIN signal s ON s.track_id = r.track_id AND s.i = r.i + 1)
SELECT track_id, i::INT AS i, round(cur, 4) AS level FROM r"""


def gamma_lut(spark, sf_dir):
    return spark.range(256).select(F.col("id").cast("int").alias("v"), L.gamma(F.col("id").cast("double")).alias("g"))


GAMMA_LUT = "SELECT i::INT AS v, round_even(255 * pow(i / 255.0::DOUBLE, 2.2::DOUBLE), 0)::INT AS g FROM range(256) t(i)"

FIXTURES = [("strip_left", 0, 150, "ambient"), ("strip_right", 150, 150, "ambient"), ("bar_front", 0, 60, "beat")]


def fixture_pixels(spark, sf_dir):
    """Fixtures of each pixel; where they overlap, their light is added."""
    pixels = L.fixture_pixels(spark.createDataFrame(FIXTURES, "id string, offset int, count int, role string"))
    return pixels.groupBy("pixel").agg(F.concat_ws("+", F.array_sort(F.collect_list("id"))).alias("ids"), F.concat_ws("+", F.array_sort(F.collect_set("role"))).alias("roles"), F.count(F.lit(1)).alias("n"))


FIXTURE_PIXELS = """WITH f(id, o, c, role) AS (VALUES ('strip_left', 0, 150, 'ambient'), ('strip_right', 150, 150, 'ambient'), ('bar_front', 0, 60, 'beat')),
p AS (SELECT (o + i)::INT AS pixel, id, role FROM f, range(150) t(i) WHERE i < c)
SELECT pixel, string_agg(id, '+' ORDER BY id) AS ids, string_agg(DISTINCT role, '+' ORDER BY role) AS roles, count(*) AS n FROM p GROUP BY pixel"""


def band_colours(spark, sf_dir):
    """Colour of each signal block: band colours by weight, the bands' levels being the block's five moments."""
    s = R.framed(signal(spark, sf_dir), FRAME).where("n < 5")
    colours = spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(L.BAND_COLOURS.values())], "n long, r double, g double, b double, w double")
    level = F.least(F.lit(1.0), F.abs("v") / 100.0)
    mixed = s.join(F.broadcast(colours), "n").groupBy("track_id", "fr").agg(*[F.least(F.lit(255.0), F.round(F.sum(F.col(c) * F.col("w") * level), 3)).alias(c) for c in "rgb"])
    return mixed


BAND_COLOURS = f"""WITH {SIGNAL_SQL}, c(n, r, g, b, w) AS (VALUES {", ".join(f"({k}, {c[0]}, {c[1]}, {c[2]}, {c[3]}::DOUBLE)" for k, c in enumerate(L.BAND_COLOURS.values()))})
SELECT track_id, i // {FRAME} AS fr, {", ".join(f"least(255.0::DOUBLE, round(sum({x} * w * least(1, abs(v) / 100)), 3)) AS {x}" for x in "rgb")} FROM signal JOIN c ON c.n = i % {FRAME} GROUP BY ALL"""


def key_hue(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 12) * 30).cast("int").alias("hue"))


def onset_chase(spark, sf_dir):
    """Pixel that a chase of 400 pixels a second over 300 pixels has reached at each light frame since the last
    downbeat; none before the first."""
    downs = _downbeats(spark, sf_dir).withColumn("at", F.col("t"))
    seen = R.as_of(_grid(spark, sf_dir), downs, ["at"]).where("at IS NOT NULL")
    pixel = F.floor(F.round((F.col("t") - F.col("at")) * 400, 6)).cast("int")
    return seen.select("track_id", "frame", pixel.alias("pixel")).where("pixel < 300")


CHASE = f"""WITH {DOWN_SQL}, {GRID_SQL}, a AS (SELECT g.track_id, frame, floor(round((g.t - db.t) * 400, 6))::INT AS pixel FROM grid g ASOF JOIN db ON g.track_id = db.track_id AND g.t >= db.t)
SELECT * FROM a WHERE pixel < 300"""


def flash_rate_limit(spark, sf_dir):
    """Flashes on beats, at most three a second."""
    beats = _beats(spark, sf_dir).groupBy("track_id").agg(F.array_sort(F.collect_list("t")).alias("times"))
    return beats.select("track_id", F.explode(L.limit_flashes(F.col("times"))).alias("t"))


FLASH_LIMIT = f"""WITH RECURSIVE {DOWNBEAT_SQL}, l AS (SELECT track_id, list(t ORDER BY t) AS times FROM beats GROUP BY track_id),
r AS (SELECT track_id, times, 1 AS j, []::DOUBLE[] AS kept FROM l UNION ALL SELECT track_id, times, j + 1, CASE WHEN len(kept) = 0 OR times[j] - kept[-1] >= 1.0::DOUBLE / 3 - 1e-9 THEN list_append(kept, times[j]) ELSE kept END FROM r WHERE j <= len(times))
SELECT track_id, unnest(kept) AS t FROM r WHERE j = len(times) + 1"""


def palette_crossfade(spark, sf_dir):
    """Palette colour of each light frame: from a section's border on, the colour of the section before gives way to its
    own within two seconds."""
    w = W.partitionBy("track_id").orderBy("t")
    s = _sections(spark, sf_dir).select("track_id", "t", F.col("t").alias("since"), "label", F.coalesce(F.lag("label").over(w), "label").alias("before"))
    seen = R.as_of(_grid(spark, sf_dir), s, ["since", "label", "before"])
    share = L.crossfade(F.col("t") - F.col("since"))
    colour = lambda name, k: F.element_at(F.create_map(*[x for n, c in L.PALETTES.items() for x in (F.lit(n), F.lit(float(c[k])))]), F.col(name))
    return seen.select("track_id", "frame", *[F.round(colour("before", k) * (1.0 - share) + colour("label", k) * share, 4).alias(n) for k, n in enumerate("rgb")])


def _palette_sql(name: str, k: int) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{n}' THEN {c[k]}::DOUBLE" for n, c in L.PALETTES.items()) + " END"


PALETTE_CROSSFADE = f"""WITH {LABELS_SQL}, {GRID_SQL}, s AS (SELECT track_id, sidx * {FRAME * STEP}::DOUBLE AS t, label, coalesce(lag(label) OVER (PARTITION BY track_id ORDER BY sidx), label) AS before FROM labels),
a AS (SELECT g.track_id, frame, label, before, least(1.0::DOUBLE, (g.t - s.t) / 2.0::DOUBLE) AS w FROM grid g ASOF JOIN s ON g.track_id = s.track_id AND g.t >= s.t)
SELECT track_id, frame, {", ".join(f"round({_palette_sql('before', k)} * (1.0::DOUBLE - w) + {_palette_sql('label', k)} * w, 4) AS {x}" for k, x in enumerate("rgb"))} FROM a"""


def power_limit(spark, sf_dir):
    """Share of each light frame's brightness that a strip of 300 pixels may have within 5 A."""
    frames = light_frames_asof(spark, sf_dir)
    share = L.limit_power(L.strip_current(F.col("r") + F.col("g") + F.col("b")), 5.0)
    return frames.select("track_id", "frame", F.round(share, 6).alias("share"))


POWER_LIMIT = f"SELECT track_id, frame, round(least(1.0::DOUBLE, 5.0::DOUBLE / greatest(1e-9::DOUBLE, (r + g + b) / 255.0::DOUBLE * (0.02::DOUBLE * 300))), 6) AS share FROM ({LIGHT_FRAMES})"

LIVE_BANDS = ("sub", "mid", "brilliance")  # colours of the stand-in's low, mid and high band


def band_light_frames(spark, sf_dir):
    """Colour of each light frame from the band levels of the spectral frame it lies in, 0 at -80 dB and full at 0 dB."""
    colours = spark.createDataFrame([(k, *map(float, L.BAND_COLOURS[n])) for k, n in enumerate(LIVE_BANDS)], "band int, r double, g double, b double, w double")
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("db") + 80.0) / 80.0))
    lit = _bands(spark, sf_dir).join(F.broadcast(colours), "band").groupBy("track_id", "fr").agg(*[F.least(F.lit(255.0), F.sum(F.col(c) * F.col("w") * level)).alias(c) for c in "rgb"])
    seen = R.as_of(_grid(spark, sf_dir), lit.withColumn("t", F.col("fr") * (N * STEP)), list("rgb"))
    return seen.where("r IS NOT NULL").select("track_id", "frame", *[F.round(c, 3).alias(c) for c in "rgb"])


BAND_LIGHT_FRAMES = f"""WITH {BANDS_SQL}, {GRID_SQL}, c(band, r, g, b, w) AS (VALUES {", ".join(f"({k}, {c[0]}, {c[1]}, {c[2]}, {c[3]}::DOUBLE)" for k, c in enumerate(L.BAND_COLOURS[n] for n in LIVE_BANDS))}),
lit AS (SELECT track_id, fr * {N * STEP}::DOUBLE AS t, {", ".join(f"least(255.0::DOUBLE, sum({x} * w * greatest(0, least(1, (db + 80) / 80)))) AS {x}" for x in "rgb")} FROM bands JOIN c ON bands.band = c.band GROUP BY track_id, fr)
SELECT g.track_id, frame, round(r, 3) AS r, round(lit.g, 3) AS g, round(b, 3) AS b FROM grid g ASOF JOIN lit ON g.track_id = lit.track_id AND g.t >= lit.t"""


def peak_chase(spark, sf_dir):
    """Pixel that a chase of 400 pixels a second over 300 pixels has reached at each light frame since the last peak."""
    peaks = _beats(spark, sf_dir).select("track_id", "t", F.col("t").alias("at"))
    seen = R.as_of(_grid(spark, sf_dir), peaks, ["at"]).where("at IS NOT NULL")
    pixel = F.floor(F.round((F.col("t") - F.col("at")) * 400, 6)).cast("int")
    return seen.select("track_id", "frame", pixel.alias("pixel")).where("pixel < 300")


PEAK_CHASE = f"""WITH {BEATS_SQL}, {GRID_SQL}, a AS (SELECT g.track_id, frame, floor(round((g.t - p.t) * 400, 6))::INT AS pixel FROM grid g ASOF JOIN beats p ON g.track_id = p.track_id AND g.t >= p.t)
SELECT * FROM a WHERE pixel < 300"""


def bass_swap_points(spark, sf_dir):
    """Where the basses swap in the transition from a track's exit to its end: the downbeat nearest to 58 % of it among
    those at 50 to 66 %, else 58 % itself."""
    out = transition_points(spark, sf_dir).where("out_at IS NOT NULL").select("track_id", "out_at")
    span = out.join(_ends(spark, sf_dir), "track_id").select("track_id", "out_at", "seconds", (F.col("seconds") - F.col("out_at")).alias("length"))
    share = F.round((F.col("t") - F.col("out_at")) / F.col("length"), 9)
    near = span.join(_downbeats(spark, sf_dir), "track_id").withColumn("share", share).where(F.col("share").between(0.5, 0.66))
    best = near.groupBy("track_id").agg(F.min_by("t", F.struct(F.round(F.abs(F.col("share") - 0.58), 9), "t")).alias("down"))
    placed = span.join(best, "track_id", "left")
    return placed.select("track_id", "out_at", F.round(F.coalesce("down", F.col("out_at") + 0.58 * F.col("length")), 6).alias("swap_at"), F.col("down").isNotNull().alias("on_downbeat"))


BASS_SWAP = f"""WITH tp AS ({TRANSITIONS}), {DOWN_SQL}, {ENDS_SQL},
sp AS (SELECT tp.track_id, out_at, seconds - out_at AS length FROM tp JOIN ends ON tp.track_id = ends.track_id WHERE out_at IS NOT NULL),
nr AS (SELECT sp.track_id, t, round((t - out_at) / length, 9) AS share FROM sp JOIN db ON sp.track_id = db.track_id),
bs AS (SELECT track_id, t AS down FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(abs(share - 0.58::DOUBLE), 9), t) AS r FROM nr WHERE share BETWEEN 0.5::DOUBLE AND 0.66::DOUBLE) WHERE r = 1)
SELECT sp.track_id, out_at, round(coalesce(down, out_at + 0.58::DOUBLE * length), 6) AS swap_at, down IS NOT NULL AS on_downbeat FROM sp LEFT JOIN bs ON sp.track_id = bs.track_id"""


def clock_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.clock_index(F.col("p_partkey") / 8.0, F.lit(-40.0)).alias("frame"))


QUERIES = {f.__name__: f for f in (transition_points, tempo_match, equal_power_gains, overlap_add, seam_fade, mix_checks, light_frames_asof, beat_flash, asymmetric_decay, gamma_lut, fixture_pixels, band_colours, key_hue, onset_chase, flash_rate_limit, clock_lookup, palette_crossfade, power_limit, band_light_frames, peak_chase, bass_swap_points)}
ORACLES = {
    "transition_points": TRANSITIONS, "tempo_match": TEMPO_MATCH, "equal_power_gains": EQUAL_POWER, "overlap_add": OVERLAP, "seam_fade": SEAM, "mix_checks": MIX_CHECKS, "light_frames_asof": LIGHT_FRAMES, "beat_flash": BEAT_FLASH,
    "asymmetric_decay": DECAY, "gamma_lut": GAMMA_LUT, "fixture_pixels": FIXTURE_PIXELS, "band_colours": BAND_COLOURS, "key_hue": "SELECT p_partkey, ((p_partkey % 12) * 30)::INT AS hue FROM part", "onset_chase": CHASE,
    "flash_rate_limit": FLASH_LIMIT, "clock_lookup": "SELECT p_partkey, greatest(0, trunc((p_partkey / 8.0::DOUBLE + -40.0::DOUBLE / 1000) * 60)::INT) AS frame FROM part",
    "palette_crossfade": PALETTE_CROSSFADE, "power_limit": POWER_LIMIT, "band_light_frames": BAND_LIGHT_FRAMES, "peak_chase": PEAK_CHASE, "bass_swap_points": BASS_SWAP,
}
