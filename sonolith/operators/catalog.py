"""Catalogue maintenance: hashes, names, change classification, incremental selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.constants import AUDIO_EXTENSIONS, QUICK_HASH_BYTES

# Separators of artist and title, in the order they are tried.
SEPARATORS = (" - ", " — ", " – ")
FIELDS = ("title", "artist", "album", "duration_sec", "sample_rate")


def quick_hash(content: Column, chunk: int = QUICK_HASH_BYTES) -> Column:
    """sha256 of the first and the last chunk of the bytes and their number in decimal; of all bytes up to two
    chunks."""
    size = F.octet_length(content)
    ends = F.when(size <= 2 * chunk, content).otherwise(F.concat(F.substring(content, 1, chunk), F.substring(content, -chunk, chunk)))
    return F.sha2(F.concat(ends, size.cast("string").cast("binary")), 256)


def is_audio(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1)).isin(*AUDIO_EXTENSIONS)


def stem(path: Column) -> Column:
    """File name without folders and the last extension, stripped."""
    return F.trim(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def split_name(name: Column) -> Column:
    """struct(artist, title) of a stem: split once at the first separator of the list that occurs."""
    plain = F.struct(F.lit(None).cast("string").alias("artist"), name.alias("title"))
    out = plain
    for sep in reversed(SEPARATORS):
        at = F.instr(name, sep)
        artist, title = F.trim(F.substring(name, F.lit(1), at - 1)), F.trim(F.substring(name, at + len(sep), F.length(name)))
        out = F.when(at > 0, F.struct(F.nullif(artist, F.lit("")).alias("artist"), F.coalesce(F.nullif(title, F.lit("")), name).alias("title"))).otherwise(out)
    return out


def track_id(path: Column) -> Column:
    """A deterministic id of a track."""
    return F.substring(F.sha2(path, 256), 1, 32)


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next snapshot: one row a file_path with its status.

    INSERTED, HASH_CHANGED (all fields new, analyzed_at reset), METADATA_UPDATED (some field differs, nulls are equal,
    durations compare as floats), UNCHANGED, or ABSENT for rows that the scan did not meet, which stay. One full outer
    join on file_path; both sides have unique paths."""
    o, n = existing.alias("o"), incoming.alias("n")
    differs = ~F.lit(True)
    for f in FIELDS:
        a, b = (F.col(f"{s}.{f}").cast("float") if f == "duration_sec" else F.col(f"{s}.{f}") for s in "on")
        differs = differs | ~a.eqNullSafe(b)
    status = (
        F.when(F.col("o.file_path").isNull(), "INSERTED").when(F.col("n.file_path").isNull(), "ABSENT")
        .when(F.col("o.file_hash") != F.col("n.file_hash"), "HASH_CHANGED").when(differs, "METADATA_UPDATED").otherwise("UNCHANGED")
    )
    joined = o.join(n, F.col("o.file_path") == F.col("n.file_path"), "full").withColumn("status", status)
    pick = lambda f: F.when(F.col("status") == "ABSENT", F.col(f"o.{f}")).otherwise(F.col(f"n.{f}")).alias(f)
    analyzed = F.when(F.col("status").isin("METADATA_UPDATED", "UNCHANGED", "ABSENT"), F.col("o.analyzed_at")).alias("analyzed_at")
    return joined.select(pick("file_path"), pick("file_hash"), *map(pick, FIELDS), analyzed, "status")


def to_analyze(tracks: DataFrame, version: int, force: bool = False) -> DataFrame:
    """Tracks without an analysis, or with one of an older version; all of them with force."""
    return tracks if force else tracks.where(F.col("analyzed_at").isNull() | (F.col("analysis_version") < version))


def normalise_again(then: Column, now: Column) -> Column:
    """Whether the library grew by more than a fifth since the statistics were made."""
    return now * 5 > then * 6
