"""Queries over the library: candidates, similarity, scores, normalisation, set planning."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolith.operators import harmony as H
from sonolith.operators import similarity as S
from sonolith.operators.ranking import scored_pairs
from sonolith.plans.views import DISTANCE_SQL, LIBRARY_SQL, library, prefixed
from sonolith.session import table

SALTS = 16  # parts of the tracks of one key code
SEEDS = 100  # the query tracks are those whose id is divisible by this

COSINE_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform({a}, lambda z: z::DOUBLE * z::DOUBLE)) * list_sum(list_transform({b}, lambda z: z::DOUBLE * z::DOUBLE)))"


def camelot_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.range(24).select((F.col("id") % 12).cast("int").alias("pitch"), (F.col("id") < 12).alias("major"))
    return keys.select("pitch", F.when(F.col("major"), "major").otherwise("minor").alias("mode"), H.pitch_name(F.col("pitch")).alias("name"), H.camelot_code(F.col("pitch"), F.col("major")).alias("camelot"))


CAMELOT_MAP = """SELECT p::INT AS pitch, m AS mode, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][p + 1] AS name,
  CASE m WHEN 'major' THEN ((p * 7 + 7) % 12 + 1)::VARCHAR || 'B' ELSE ((p * 7 + 4) % 12 + 1)::VARCHAR || 'A' END AS camelot
FROM range(12) t(p), (VALUES ('major'), ('minor')) u(m)"""


def library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = library(spark, sf_dir).where(F.col("bpm10").between(1200, 1300) & F.col("camelot").isin("8A", "8B", "9A", "7A") & F.lower("title").contains("e"))
    return found.select("id", "artist", "title", "bpm10", "camelot")


LIBRARY_FILTER = f"""WITH {LIBRARY_SQL} SELECT id, artist, title, bpm10, number::VARCHAR || CASE WHEN major THEN 'B' ELSE 'A' END AS camelot
FROM library WHERE bpm10 BETWEEN 1200 AND 1300 AND lower(title) LIKE '%e%'
  AND (number = 8 OR number IN (7, 9) AND NOT major)"""


def tempo_compatible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = library(spark, sf_dir).where("bpm_conf >= 50").select("id", "bpm10")
    return H.tempo_join(prefixed(tracks.where(F.col("id") % SEEDS == 0), "a"), prefixed(tracks, "b")).where("a_id <> b_id").select("a_id", "b_id", "gap2")


TEMPO_PAIRS = f"""WITH {LIBRARY_SQL}, p AS (
  SELECT a.id AS a_id, b.id AS b_id, a.bpm10 AS t, least(abs(b.bpm10 - a.bpm10) * 2, abs(2 * b.bpm10 - a.bpm10) * 2, abs(b.bpm10 - 2 * a.bpm10)) AS gap2
  FROM library a, library b WHERE a.id % 100 = 0 AND a.id <> b.id AND a.bpm_conf >= 50 AND b.bpm_conf >= 50)
SELECT a_id, b_id, gap2 FROM p WHERE gap2 * 100 <= 12 * t"""


def harmonic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds with the tracks in a compatible key, by an equi-join on the wheel's codes; tracks whose key is uncertain
    pass in any case."""
    tracks = library(spark, sf_dir).select("id", "number", "major", "key_conf")
    a, b = prefixed(tracks.where(F.col("id") % SEEDS == 0), "a"), prefixed(tracks, "b")
    code = lambda n, m: (F.pmod(n - 1, F.lit(12)) * 2 + m.cast("int")).cast("int")
    n, m = F.col("a_number"), F.col("a_major")
    some = F.array(code(n, ~m), *[code(n + d, m) for d in (-2, -1, 0, 1, 2)])
    codes = F.sequence(F.lit(0), F.lit(23))
    # an uncertain seed meets every code, and a sure one every code of uncertain tracks: they are keys of their own, so
    # a pair is met once. Tracks are dealt to SALTS parts of a code, and seeds go to each of them
    unsure = F.col("b_key_conf") < 40
    keys = F.when(F.col("a_key_conf") < 40, F.concat(codes, F.transform(codes, lambda x: x + 24))).otherwise(F.concat(some, F.transform(codes, lambda x: x + 24)))
    left = a.withColumn("code", F.explode(keys)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = b.withColumns({"code": code(F.col("b_number"), F.col("b_major")) + F.when(unsure, 24).otherwise(0), "salt": F.pmod(F.xxhash64("b_id"), F.lit(SALTS)).cast("int")})
    far = H.wheel_distance(F.col("a_number"), F.col("a_major"), F.col("b_number"), F.col("b_major"))
    return left.join(right, ["code", "salt"]).where("a_id <> b_id").select("a_id", "b_id", far.alias("distance"))


HARMONIC_PAIRS = f"""WITH {LIBRARY_SQL}, p AS (
  SELECT a.id AS a_id, b.id AS b_id, ({DISTANCE_SQL.format(a="a", b="b")})::INT AS distance, least(a.key_conf, b.key_conf) AS conf
  FROM library a, library b WHERE a.id % 100 = 0 AND a.id <> b.id)
SELECT a_id, b_id, distance FROM p WHERE distance <= 2 OR conf < 40"""


def timbre_knn_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 40).alias("v"))
    return S.nearest(rows, rows.where(F.col("id") % SEEDS == 0), 5).select("query_id", F.col("id").alias("vec_id"), F.round("cos", 5).alias("cos"), "rank")


TIMBRE_KNN = f"""WITH c AS (
  SELECT a.vec_id AS query_id, b.vec_id, {COSINE_SQL.format(a="a.embedding[1:40]", b="b.embedding[1:40]")} AS cos
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 6) DESC, vec_id) AS rank FROM c)
SELECT query_id, vec_id, round(cos, 5) AS cos, rank::INT AS rank FROM r WHERE rank <= 5"""


def _scored(spark: SparkSession, sf_dir: str, best: int | None = None) -> DataFrame:
    """Scores of the seed tracks' pairs with the tracks that tempo and key allow."""
    tracks = library(spark, sf_dir).where("bpm_conf >= 50")
    return scored_pairs(tracks, tracks.where(F.col("id") % SEEDS == 0), table(spark, sf_dir, "part").count(), best)


_SCORED = f"""{LIBRARY_SQL}, p AS (
  SELECT a.id AS a_id, b.id AS b_id, least(abs(b.bpm10 - a.bpm10) * 2, abs(2 * b.bpm10 - a.bpm10) * 2, abs(b.bpm10 - 2 * a.bpm10)) AS gap2,
    a.bpm10 AS t, {DISTANCE_SQL.format(a="a", b="b")} AS distance, least(a.key_conf, b.key_conf) AS conf, a.timbre AS at_, b.timbre AS bt,
    a.band AS ab, b.band AS bb, 1.0::DOUBLE - abs(b.energy - least(100, a.energy + 10)) / 100.0::DOUBLE AS energy
  FROM library a, library b WHERE a.id % {{every}} = 0 AND a.id <> b.id AND a.bpm_conf >= 50 AND b.bpm_conf >= 50),
f AS (SELECT * FROM p WHERE gap2 * 100 <= 12 * t AND (distance <= 2 OR conf < 40)),
s AS (SELECT a_id, b_id,
    0.45::DOUBLE * greatest(0, {COSINE_SQL.format(a="at_", b="bt")}) AS timbre_part,
    0.2::DOUBLE * greatest(0, {COSINE_SQL.format(a="ab", b="bb")}) AS band_part,
    0.15::DOUBLE * greatest(0, least(1, 1.0::DOUBLE - distance / 3.0::DOUBLE)) AS harmonic_part,
    0.1::DOUBLE * greatest(0, least(1, 1.0::DOUBLE - (gap2 / 2.0::DOUBLE) / (0.06::DOUBLE * t))) AS tempo_part,
    0.1::DOUBLE * greatest(0, least(1, energy)) AS energy_part FROM f),
z AS (SELECT a_id, b_id, round(timbre_part, 6) AS timbre_part, round(band_part, 6) AS band_part, round(harmonic_part, 6) AS harmonic_part,
    round(tempo_part, 6) AS tempo_part, round(energy_part, 6) AS energy_part,
    round(timbre_part + band_part + harmonic_part + tempo_part + energy_part, 6) AS score FROM s)"""


def next_track_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each seed track the ten best next tracks, with the score's parts."""
    return _scored(spark, sf_dir, 10)


NEXT_TRACK = f"WITH {_SCORED.format(every=100)}, r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id)::INT AS rank FROM z) SELECT * FROM r WHERE rank <= 10"


def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


SCORE_BREAKDOWN = f"WITH {_SCORED.format(every=100)} SELECT * FROM z"


def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "embeddings").select(F.posexplode(F.slice("embedding", 1, 40)).alias("dim", "x"))
    return long.groupBy("dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


FEATURE_STATS = """WITH e AS (SELECT unnest(embedding[1:40])::DOUBLE AS x, unnest(range(40)) AS dim FROM embeddings)
SELECT dim::INT AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM e GROUP BY dim"""


def zscore_l2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 40).cast("array<double>").alias("v"))
    return S.standardised(rows).select("vec_id", F.posexplode("v").alias("dim", "x")).select("vec_id", "dim", F.round("x", 5).alias("x"))


ZSCORE = """WITH e AS (SELECT vec_id, unnest(embedding[1:40])::DOUBLE AS x, unnest(range(40)) AS dim FROM embeddings),
s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS d FROM e GROUP BY dim),
z AS (SELECT vec_id, e.dim, CASE WHEN d > 0 THEN (x - m) / d ELSE 0 END AS z FROM e JOIN s ON e.dim = s.dim),
n AS (SELECT vec_id, sqrt(sum(z * z)) AS n FROM z GROUP BY vec_id)
SELECT z.vec_id, dim::INT AS dim, round(CASE WHEN n > 0 THEN z / n ELSE 0 END, 5) AS x FROM z JOIN n ON z.vec_id = n.vec_id"""


def chroma_band_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chroma vectors scaled to length 1, and band vectors as z-scores over the library."""
    part = lambda first, n: table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", first, n).cast("array<double>").alias("v"))
    long = [v.select("vec_id", F.lit(name).alias("part"), F.posexplode("v").alias("dim", "x")) for name, v in (("chroma", S.scaled(part(41, 12))), ("band", S.zscored(part(53, 8))))]
    return long[0].unionAll(long[1]).withColumn("x", F.round("x", 5))


CHROMA_BAND = """WITH e AS (SELECT vec_id, unnest(embedding[41:52])::DOUBLE AS x, unnest(range(12)) AS dim FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id),
b AS (SELECT vec_id, unnest(embedding[53:60])::DOUBLE AS x, unnest(range(8)) AS dim FROM embeddings),
s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS d FROM b GROUP BY dim)
SELECT e.vec_id, 'chroma' AS part, dim::INT AS dim, round(CASE WHEN n > 0 THEN x / n ELSE 0 END, 5) AS x FROM e JOIN n ON e.vec_id = n.vec_id
UNION ALL SELECT vec_id, 'band', b.dim::INT, round(CASE WHEN d > 0 THEN (x - m) / d ELSE 0 END, 5) FROM b JOIN s ON b.dim = s.dim"""


def set_energy_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each brand's tracks, in order of id, follow each energy preset."""
    w = W.partitionBy("p_brand")
    part = table(spark, sf_dir, "part").select("p_brand", ((F.col("p_partkey") * 29) % 101 / 100.0).alias("e"), (F.row_number().over(w.orderBy("p_partkey")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    x = F.col("i") / F.greatest(F.lit(1), F.col("n") - 1)
    presets = F.array(*[F.struct(F.lit(p).alias("preset"), S.target_energy(p, x).cast("double").alias("target")) for p in ("linear_rise", "classic_arc", "flat", "descending")])
    fits = part.select("p_brand", "e", F.explode(presets).alias("t")).select("p_brand", "t.preset", "t.target", (1.0 - F.abs(F.col("e") - F.col("t.target"))).alias("fit"))
    return fits.groupBy("p_brand", "preset").agg(F.round(F.avg("target"), 6).alias("target"), F.round(F.avg("fit"), 6).alias("fit"), F.count(F.lit(1)).alias("n"))


SET_ENERGY = f"""WITH p AS (SELECT p_brand, ((p_partkey * 29) % 101) / 100.0::DOUBLE AS e, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
q AS (SELECT p_brand, e, i::DOUBLE / greatest(1, n - 1) AS x FROM p),
f AS (SELECT p_brand, preset, e, CASE preset WHEN 'linear_rise' THEN 0.3::DOUBLE + 0.6::DOUBLE * x WHEN 'classic_arc' THEN 0.35::DOUBLE + 0.55::DOUBLE * sin(x * {3.141592653589793 * 0.9!r}::DOUBLE) WHEN 'flat' THEN 0.6::DOUBLE ELSE 0.9::DOUBLE - 0.6::DOUBLE * x END AS target
  FROM q, (VALUES ('linear_rise'), ('classic_arc'), ('flat'), ('descending')) t(preset))
SELECT p_brand, preset, round(avg(target), 6) AS target, round(avg(1.0 - abs(e - target)), 6) AS fit, count(*) AS n FROM f GROUP BY p_brand, preset"""


def set_pair_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key distance and colour of each track to the one before it in its brand's set."""
    w = W.partitionBy("p_brand").orderBy("id")
    items = library(spark, sf_dir).select("p_brand", "id", "number", "major", F.row_number().over(w).alias("position"), F.lag("number").over(w).alias("pn"), F.lag("major").over(w).alias("pm")).where("pn IS NOT NULL")
    d = H.wheel_distance(F.col("pn"), F.col("pm"), F.col("number"), F.col("major"))
    return items.select("p_brand", "position", "id", d.alias("distance"), F.when(d <= 1, "green").when(d == 2, "yellow").otherwise("red").alias("colour"))


SET_PAIRS = f"""WITH {LIBRARY_SQL}, a AS (SELECT p_brand, id, number, major, row_number() OVER w AS position FROM library WINDOW w AS (PARTITION BY p_brand ORDER BY id)),
d AS (SELECT y.p_brand, y.position::INT AS position, y.id, ({DISTANCE_SQL.format(a="x", b="y")})::INT AS distance FROM a x JOIN a y ON x.p_brand = y.p_brand AND y.position = x.position + 1)
SELECT *, CASE WHEN distance <= 1 THEN 'green' WHEN distance = 2 THEN 'yellow' ELSE 'red' END AS colour FROM d"""


def _next(spark: SparkSession, tracks: DataFrame, last: list[int], most: int, target: float) -> dict[bool, dict[int, list[tuple[int, float]]]]:
    """Of each of the given last tracks the `most` best next ones of the whole library, with scores: within the strict
    tempo tolerance, and within the relaxed one."""
    pairs = H.tempo_join(prefixed(tracks.where(F.col("id").isin(last)), "a"), prefixed(tracks, "b"), 0.10).where("a_id <> b_id")
    far = H.wheel_distance(F.col("a_number"), F.col("a_major"), F.col("b_number"), F.col("b_major"))
    pairs = pairs.withColumn("distance", far).where((F.col("distance") <= 2) | (F.least("a_key_conf", "b_key_conf") < 40))
    energy = 1.0 - F.abs(F.col("b_energy") / 100.0 - target)
    parts = S.score(S.cosine(F.col("a_timbre"), F.col("b_timbre")), S.cosine(F.col("a_band"), F.col("b_band")), F.col("distance"), F.col("gap2"), F.col("a_bpm10"), energy)
    strict = F.col("gap2") * 100 <= F.col("a_bpm10") * 12
    rank = F.row_number().over(W.partitionBy("a_id", "strict").orderBy(F.col("score").desc(), "b_id"))
    rows = pairs.select("a_id", "b_id", F.round(parts["score"], 6).alias("score"), strict.alias("strict")).withColumn("rank", rank).where(F.col("rank") <= most)
    out: dict[bool, dict[int, list[tuple[int, float]]]] = {True: {}, False: {}}
    for r in sorted(rows.collect(), key=lambda r: (-r["score"], r["b_id"])):
        out[False].setdefault(r["a_id"], []).append((r["b_id"], r["score"]))
        if r["strict"]:
            out[True].setdefault(r["a_id"], []).append((r["b_id"], r["score"]))
    return out


SET_TRACKS, BEAM = 12, 10
SET_SECONDS = 45 * 60


def _start(tracks: DataFrame) -> int:
    return tracks.agg(F.min("id")).first()[0]


def seconds_of(track: int) -> int:
    """Length of a track of the stand-in library."""
    return 150 + track * 17 % 211


def plan_set_greedy(spark, sf_dir):
    """A set of SET_SECONDS from the library's first track: each step asks the whole library for the best tracks after
    the last one, and draws one of the five best that are unused; the set ends where it is long enough or no track
    follows, not even within the relaxed tempo tolerance. The loop is as long as the set."""
    tracks = library(spark, sf_dir).where("bpm_conf >= 50")
    rng, chosen, begins = random.Random(7), [_start(tracks)], [0]
    while (played := begins[-1] + seconds_of(chosen[-1])) < SET_SECONDS:
        found = _next(spark, tracks, chosen[-1:], 5 + len(chosen), 0.35 + 0.55 * math.sin(played / SET_SECONDS * math.pi * 0.9))
        pick = S.draw(found[True].get(chosen[-1], []), found[False].get(chosen[-1], []), set(chosen), rng)
        if pick is None:
            break
        chosen.append(pick)
        begins.append(played)
    return spark.createDataFrame([(k + 1, t, b) for k, (t, b) in enumerate(zip(chosen, begins, strict=True))], "position int, track_id long, begins_sec int")


def plan_set_beam(spark, sf_dir):
    """The set of the largest total score among those that BEAM partial sets reach; each step asks the library for the
    tracks after the sets' last ones."""
    tracks = library(spark, sf_dir).where("bpm_conf >= 50")
    beam = [(0.0, [_start(tracks)])]
    for k in range(1, SET_TRACKS):
        found = _next(spark, tracks, sorted({path[-1] for _, path in beam}), BEAM + k, 0.6)[True]
        grown = S.widen(beam, found, BEAM)
        if not grown:
            break
        beam = grown
    return spark.createDataFrame([(k + 1, t) for k, t in enumerate(beam[0][1])], "position int, track_id long")


QUERIES = {f.__name__: f for f in (next_track_top10, tempo_compatible_pairs, harmonic_pairs, timbre_knn_top5, score_breakdown, library_filter, camelot_map, feature_stats, zscore_l2_vectors, chroma_band_vectors, set_energy_curve, set_pair_compatibility, plan_set_greedy, plan_set_beam)}
ORACLES = {"next_track_top10": NEXT_TRACK, "tempo_compatible_pairs": TEMPO_PAIRS, "harmonic_pairs": HARMONIC_PAIRS, "timbre_knn_top5": TIMBRE_KNN, "score_breakdown": SCORE_BREAKDOWN, "library_filter": LIBRARY_FILTER, "camelot_map": CAMELOT_MAP, "feature_stats": FEATURE_STATS, "zscore_l2_vectors": ZSCORE, "chroma_band_vectors": CHROMA_BAND, "set_energy_curve": SET_ENERGY, "set_pair_compatibility": SET_PAIRS}
