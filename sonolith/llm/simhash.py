"""Operator 4: SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm.components import components, meet
from sonolith.llm.textops import U64, arrow_bytes, lower_ascii, trimmed
from sonolith.session import stash, table

BITS = 64
SEED = 42
#: Members of one block group that are compared in one task; larger groups are split into tiles of this many.
TILE = 2048
#: Members of a group that are compared with the others at once.
STRIP = 128
#: Shingles whose bits are spread out at once.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int, seed: int = SEED) -> int:
    """SimHash of a lower-cased text: a bit is set if it is set in over half the XXH64 of its word shingles."""
    words = text.split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.append(0, ends[:-1] + 1)
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), U64, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        part = hashes[i : i + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each row; null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            low, off = lower_ascii(data).tobytes(), offsets.tolist()
            fps = np.array([fingerprint(low[a:b], shingle) for a, b in zip(off[:-1], off[1:], strict=True)], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, fp long")


def block_masks(radius: int) -> list[int]:
    """Masks of block combinations such that two fingerprints within radius agree on one whole mask: radius + 3
    blocks, of which at least 3 have no differing bit."""
    blocks = np.array_split(np.arange(BITS), radius + 3)
    return [sum(1 << int(b) for k in pick for b in blocks[k]) for pick in combinations(range(len(blocks)), 3)]


def _close_in_run(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of one group's links: each member with its component's first member."""
    n = len(fps)
    if n == 2:
        near = np.bitwise_count(fps[:1] ^ fps[1:]) <= radius
        return (np.array([1]), np.array([0])) if near[0] else (np.zeros(0, int), np.zeros(0, int))
    link = np.concatenate([np.bitwise_count(fps[i : i + STRIP, None] ^ fps[None, :]) <= radius for i in range(0, n, STRIP)])
    label = np.arange(n, dtype=np.int32)
    while True:
        low = np.concatenate([np.where(link[i : i + STRIP], label[None, :], np.int32(n)).min(axis=1) for i in range(0, n, STRIP)])
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def links(fps: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """u, v: edges whose components are those of all pairs of fps (distinct longs, column fp) at radius or fewer
    differing bits.

    Each fingerprint goes to one row per block combination; rows that agree on a combination are a group. A group of
    up to `tile` members is compared in one task; a larger one is cut by hash into parts, and each pair of parts is a
    group of its own, so no task holds more than two parts, and no pair is lost. A group emits fewer edges than it has
    members.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << BITS) if m >> 63 else m)).alias("b")) for k, m in enumerate(block_masks(radius))])
    rows = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.xxhash64("m.t", "m.b").alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / F.lit(tile)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, part) * F.col("parts") + F.greatest(j, part))
    tiled = rows.join(hot, "key", "left").select("fp", "key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others)).alias("tile"))
    dealt = tiled.repartition("key", "tile").sortWithinPartitions("key", "tile")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)

        def flush(block: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((block[1:, 0] != block[:-1, 0]) | (block[1:, 1] != block[:-1, 1])) + 1
            starts, ends = np.append(0, cut), np.append(cut, len(block))
            some = ends - starts > 1
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
                own = block[a:b, 2]
                i, j = _close_in_run(own.view(U64), radius)
                us.append(own[i])
                vs.append(own[j])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        for batch in batches:
            cols = [np.asarray(batch.column(batch.schema.get_field_index(c)), dtype=np.int64) for c in ("key", "tile", "fp")]
            block = np.concatenate([held, np.column_stack(cols)])
            if not len(block):
                continue
            tail = len(block) - 1
            same = (block[:, 0] == block[tail, 0]) & (block[:, 1] == block[tail, 1])
            start = len(block) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = np.ascontiguousarray(block[start:])
            if start:
                yield flush(np.ascontiguousarray(block[:start]))
        if len(held):
            yield flush(held)

    return dealt.mapInArrow(trimmed(run), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id of each row: component_id is the smallest doc_id reachable over fingerprints that
    differ in at most radius bits.

    Null or empty text has fingerprint zero and is linked like any other; fewer words than the shingle: the whole
    sequence is the shingle. Equal fingerprints are one node, so copies never become pairs. Repeated rows stay, one
    each; a null doc_id keeps its row, and its component is that of the others (null if it has no other member). Other
    columns are not read. An empty table gives no rows.
    """
    own = stash(fingerprints(docs, shingle), "fingerprints")
    nodes = stash(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    member = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = meet(rooted.select("fp", "root", F.col("n").alias("copies")), lowest, "root", nodes.count()).select("fp", "component_id", F.col("copies").alias("n"))
    return meet(own, of, "fp", own.count()).select("doc_id", "fp", "component_id")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; cases as in near_duplicates()."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
