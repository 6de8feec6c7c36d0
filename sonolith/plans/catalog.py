"""Queries over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.operators import catalog as C
from sonolith.session import table

VERSION = 3

EXISTING_SQL = """existing AS (SELECT p_brand || '/' || p_partkey::VARCHAR || '.mp3' AS file_path, p_type || p_partkey::VARCHAR AS file_hash, p_name AS title, p_brand AS artist,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS album, (p_retailprice / 7)::FLOAT AS duration_sec, (22050 * (1 + p_size % 2))::INT AS sample_rate,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' END AS analyzed_at FROM part WHERE p_partkey % 10 <> 1)"""
INCOMING_SQL = """incoming AS (SELECT p_brand || '/' || p_partkey::VARCHAR || '.mp3' AS file_path, p_type || p_partkey::VARCHAR || CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END AS file_hash,
    CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS title, p_brand AS artist, CASE WHEN p_partkey % 8 = 0 THEN 'new' WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS album,
    (p_retailprice / 7)::FLOAT AS duration_sec, (22050 * (1 + p_size % 2))::INT AS sample_rate FROM part WHERE p_partkey % 10 <> 2)"""
UPSERT_SQL = f"""{EXISTING_SQL}, {INCOMING_SQL}, j AS (SELECT o.file_path AS op, n.file_path AS np, o.file_hash AS oh, n.file_hash AS nh, o.title AS ot, n.title AS nt, o.artist AS oa, n.artist AS na,
    o.album AS ob, n.album AS nb, o.duration_sec AS od, n.duration_sec AS nd, o.sample_rate AS os, n.sample_rate AS ns, o.analyzed_at AS at_ FROM existing o FULL JOIN incoming n ON o.file_path = n.file_path),
  s AS (SELECT *, CASE WHEN op IS NULL THEN 'INSERTED' WHEN np IS NULL THEN 'ABSENT' WHEN oh <> nh THEN 'HASH_CHANGED'
    WHEN ot IS DISTINCT FROM nt OR oa IS DISTINCT FROM na OR ob IS DISTINCT FROM nb OR od IS DISTINCT FROM nd OR os IS DISTINCT FROM ns THEN 'METADATA_UPDATED' ELSE 'UNCHANGED' END AS status FROM j),
  snap AS (SELECT coalesce(np, op) AS file_path, CASE status WHEN 'ABSENT' THEN oh ELSE nh END AS file_hash, CASE status WHEN 'ABSENT' THEN ot ELSE nt END AS title, CASE status WHEN 'ABSENT' THEN oa ELSE na END AS artist,
    CASE status WHEN 'ABSENT' THEN ob ELSE nb END AS album, CASE status WHEN 'ABSENT' THEN od ELSE nd END AS duration_sec, CASE status WHEN 'ABSENT' THEN os ELSE ns END AS sample_rate,
    CASE WHEN status IN ('METADATA_UPDATED', 'UNCHANGED', 'ABSENT') THEN at_ END AS analyzed_at, status FROM s)"""


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").where(k % 10 != 1).select(
        F.concat("p_brand", F.lit("/"), k.cast("string"), F.lit(".mp3")).alias("file_path"), F.concat("p_type", k.cast("string")).alias("file_hash"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        F.when(k % 4 != 0, F.col("p_type")).alias("album"), (F.col("p_retailprice") / 7).cast("float").alias("duration_sec"), (22050 * (1 + F.col("p_size") % 2)).cast("int").alias("sample_rate"),
        F.when(k % 3 != 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("analyzed_at"),
    )


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").where(k % 10 != 2).select(
        F.concat("p_brand", F.lit("/"), k.cast("string"), F.lit(".mp3")).alias("file_path"), F.concat(F.col("p_type"), k.cast("string"), F.when(k % 7 == 0, "x").otherwise("")).alias("file_hash"),
        F.when(k % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("artist"), F.when(k % 8 == 0, "new").when(k % 4 != 0, F.col("p_type")).alias("album"),
        (F.col("p_retailprice") / 7).cast("float").alias("duration_sec"), (22050 * (1 + F.col("p_size") % 2)).cast("int").alias("sample_rate"),
    )


def upsert_snapshot(spark, sf_dir):
    return C.upsert(_existing(spark, sf_dir), _incoming(spark, sf_dir))


def upsert_status_counts(spark, sf_dir):
    return upsert_snapshot(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def incremental_todo(spark, sf_dir):
    """Tracks to analyse after the scan: new or changed ones, and those of an older version."""
    snap = upsert_snapshot(spark, sf_dir).withColumn("analysis_version", (1 + F.length("title") % 4).cast("int"))
    return C.to_analyze(snap, VERSION).select("file_path", "status", "analysis_version")


INCREMENTAL = f"WITH {UPSERT_SQL} SELECT file_path, status, (1 + length(title) % 4)::INT AS analysis_version FROM snap WHERE analyzed_at IS NULL OR 1 + length(title) % 4 < {VERSION}"


def renormalize_needed(spark, sf_dir):
    """Whether each brand's part of the library grew enough to normalise again."""
    both = upsert_snapshot(spark, sf_dir).groupBy(F.substring_index("file_path", "/", 1).alias("brand"))
    sizes = both.agg(F.count_if(F.col("status") != "INSERTED").alias("before"), F.count(F.lit(1)).alias("after"))
    return sizes.withColumn("needed", C.normalise_again(F.col("before"), F.col("after")))


RENORMALIZE = f"WITH {UPSERT_SQL} SELECT split_part(file_path, '/', 1) AS brand, count(*) FILTER (status <> 'INSERTED') AS before, count(*) AS after, count(*) * 5 > count(*) FILTER (status <> 'INSERTED') * 6 AS needed FROM snap GROUP BY ALL"


def quick_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.quick_hash(F.col("text").cast("binary")).alias("file_hash"))


QUICK_HASH = "SELECT doc_id, sha256(text || strlen(text)::VARCHAR) AS file_hash FROM documents"


def exact_copies(spark, sf_dir):
    """Files of equal hash."""
    hashes = quick_hash(spark, sf_dir)
    return hashes.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


EXACT_COPIES = f"SELECT file_hash, count(*) AS n, min(doc_id) AS first FROM ({QUICK_HASH}) GROUP BY file_hash HAVING count(*) > 1"

PATH_SQL = "paths AS (SELECT p_partkey, 'music/' || p_type || '/' || p_brand || CASE p_partkey % 4 WHEN 0 THEN ' - ' WHEN 1 THEN ' — ' WHEN 2 THEN ' – ' ELSE '_' END || p_name || CASE p_partkey % 6 WHEN 0 THEN '.mp3' WHEN 1 THEN '.WAV' WHEN 2 THEN '.txt' WHEN 3 THEN '.Flac' WHEN 4 THEN '.ogg' ELSE '.jpg' END AS path FROM part)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    sep = F.when(k % 4 == 0, " - ").when(k % 4 == 1, " — ").when(k % 4 == 2, " – ").otherwise("_")
    end = F.element_at(F.array(*map(F.lit, (".mp3", ".WAV", ".txt", ".Flac", ".ogg", ".jpg"))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("music/"), F.col("p_type"), F.lit("/"), F.col("p_brand"), sep, F.col("p_name"), end).alias("path"))


def extension_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(C.is_audio(F.col("path")))


EXTENSION_FILTER = f"WITH {PATH_SQL} SELECT * FROM paths WHERE p_partkey % 6 NOT IN (2, 5)"


def filename_fallback(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", C.split_name(C.stem(F.col("path"))).alias("s")).select("p_partkey", "s.artist", "s.title")


FILENAME_FALLBACK = """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN trim(p_brand) END AS artist, CASE WHEN p_partkey % 4 <> 3 THEN trim(p_name) ELSE trim(p_brand || '_' || p_name) END AS title FROM part"""


def metadata_coalesce(spark, sf_dir):
    """Tags where they are set, else what the file name says; durations to three places."""
    named = _paths(spark, sf_dir).select("p_partkey", C.split_name(C.stem(F.col("path"))).alias("s"))
    tags = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("tag "), "p_name")).alias("tag"), (F.col("p_partkey") / 7).alias("d"))
    return tags.join(named, "p_partkey").select("p_partkey", F.coalesce(F.nullif("tag", F.lit("")), "s.title").alias("title"), "s.artist", F.round("d", 3).alias("duration_sec"))


METADATA = f"""SELECT p.p_partkey, coalesce(nullif(CASE p.p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'tag ' || p_name END, ''), f.title) AS title, f.artist, round(p.p_partkey::DOUBLE / 7, 3) AS duration_sec
FROM part p JOIN ({FILENAME_FALLBACK}) f ON p.p_partkey = f.p_partkey"""


def track_by_path(spark, sf_dir):
    snap = upsert_snapshot(spark, sf_dir)
    return snap.where(F.col("file_path").endswith("/77.mp3")).select(C.track_id(F.col("file_path")).alias("id"), "file_path", "title", "status")


TRACK_BY_PATH = f"WITH {UPSERT_SQL} SELECT substr(sha256(file_path), 1, 32) AS id, file_path, title, status FROM snap WHERE file_path LIKE '%/77.mp3'"


def track_by_id(spark, sf_dir):
    """The track whose id is asked for; ids come from paths, so a lookup by id needs no index of its own."""
    wanted = _incoming(spark, sf_dir).agg(C.track_id(F.max("file_path")).alias("id"))
    snap = upsert_snapshot(spark, sf_dir).withColumn("id", C.track_id(F.col("file_path")))
    return snap.join(F.broadcast(wanted), "id").select("id", "file_path", "artist", "title", "status")


TRACK_BY_ID = f"WITH {UPSERT_SQL} SELECT substr(sha256(file_path), 1, 32) AS id, file_path, artist, title, status FROM snap WHERE file_path = (SELECT max(file_path) FROM incoming)"


def count_tracks(spark, sf_dir):
    return upsert_snapshot(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


def job_progress(spark, sf_dir):
    """Jobs by state: orders stand for jobs."""
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
    return table(spark, sf_dir, "orders").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


JOB_PROGRESS = "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'queued' END AS state, count(*) AS n FROM orders GROUP BY ALL"

QUERIES = {f.__name__: f for f in (upsert_snapshot, upsert_status_counts, incremental_todo, renormalize_needed, quick_hash, exact_copies, extension_filter, filename_fallback, metadata_coalesce, track_by_path, track_by_id, count_tracks, job_progress)}
ORACLES = {
    "upsert_snapshot": f"WITH {UPSERT_SQL} SELECT * FROM snap", "upsert_status_counts": f"WITH {UPSERT_SQL} SELECT status, count(*) AS n FROM snap GROUP BY status", "incremental_todo": INCREMENTAL,
    "renormalize_needed": RENORMALIZE, "quick_hash": QUICK_HASH, "exact_copies": EXACT_COPIES, "extension_filter": EXTENSION_FILTER, "filename_fallback": FILENAME_FALLBACK, "metadata_coalesce": METADATA,
    "track_by_path": TRACK_BY_PATH, "track_by_id": TRACK_BY_ID, "count_tracks": f"WITH {UPSERT_SQL} SELECT count(*) AS n FROM snap", "job_progress": JOB_PROGRESS,
}
