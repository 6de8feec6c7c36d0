"""Deterministic stand-ins for signals and the catalogue, derived from the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolith.operators.harmony import camelot_code, camelot_number
from sonolith.session import table

FRAME = 8

SIGNAL_SQL = """signal AS (
  SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
         (round(value * 100) - floor((sum(round(value * 100)) OVER (PARTITION BY user_id)) / count(*) OVER (PARTITION BY user_id))) / 100 AS v FROM events)"""

LIBRARY_SQL = """library AS (
  SELECT p_partkey AS id, p_brand AS artist, p_name AS title, 700 + (p_partkey * 37) % 1100 AS bpm10,
         40 + (p_partkey * 7) % 61 AS bpm_conf, (p_partkey % 12)::INT AS pitch, p_size % 2 = 1 AS major,
         30 + (p_partkey * 13) % 71 AS key_conf, (p_partkey * 29) % 101 AS energy,
         CASE WHEN p_size % 2 = 1 THEN ((p_partkey % 12) * 7 + 7) % 12 + 1
              ELSE ((p_partkey % 12) * 7 + 4) % 12 + 1 END AS number,
         embedding[1:40] AS timbre, embedding[53:60] AS band, p_retailprice AS price, p_brand, p_size
  FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""

DISTANCE_SQL = """CASE WHEN {a}.major = {b}.major AND least((12 + {a}.number - {b}.number) % 12, (12 + {b}.number - {a}.number) % 12) <= 2
    THEN least((12 + {a}.number - {b}.number) % 12, (12 + {b}.number - {a}.number) % 12)
    WHEN {a}.major <> {b}.major AND {a}.number = {b}.number THEN 1 ELSE 99 END"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, i, v: the values of a user's events in order, less their mean, in whole hundredths."""
    by = W.partitionBy("user_id")
    cents = F.round(F.col("value") * 100)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"),
        (F.row_number().over(by.orderBy("ts", "event_id")) - 1).cast("long").alias("i"),
        ((cents - F.floor(F.sum(cents).over(by) / F.count(F.lit(1)).over(by))) / 100).alias("v"),
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track a part, with tempo (tenths of BPM), key, confidences (hundredths), energy and vectors."""
    part, vectors = table(spark, sf_dir, "part"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    k, pitch, major = F.col("p_partkey"), (F.col("p_partkey") % 12).cast("int"), F.col("p_size") % 2 == 1
    own = part.withColumns({
        "id": k, "artist": F.col("p_brand"), "title": F.col("p_name"), "bpm10": 700 + (k * 37) % 1100, "bpm_conf": 40 + (k * 7) % 61,
        "pitch": pitch, "major": major, "key_conf": 30 + (k * 13) % 71, "energy": (k * 29) % 101,
        "number": camelot_number(pitch, major), "camelot": camelot_code(pitch, major), "price": F.col("p_retailprice"),
    })
    joined = own.join(vectors, k % vectors.count() == F.col("vec_id"))  # the count is read from the files' footers
    return joined.select("id", "artist", "title", "bpm10", "bpm_conf", "pitch", "major", "key_conf", "energy", "number", "camelot", "price", "p_brand", "p_size", F.slice("embedding", 1, 40).alias("timbre"), F.slice("embedding", 53, 8).alias("band"))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])
