"""Vector similarity, scores and set planning."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolith.constants import SCORE_WEIGHTS

#: Query vectors that are compared at once.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, cos, rank: for each row of queries (id, v) its k nearest other rows (id, v) by cosine, ties by id.

    Queries go in blocks of bounded size; each Arrow batch of rows gives its k best a query, and those are ranked."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).orderBy("id").collect()
        names = np.array([r["id"] for r in block], np.int64)
        q = np.array([r["v"] for r in block], float).reshape(len(block), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterable[pa.RecordBatch], q=q, names=names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.asarray(batch.column(0), dtype=np.int64)
                if not len(ids) or not len(names):
                    continue
                x = np.array(batch.column(1).to_pylist(), float)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                cos = q @ x.T
                cos[names[:, None] == ids[None, :]] = -np.inf
                place = np.argsort(ids, kind="stable")  # ties are ranked by id, as below
                ids, cos = ids[place], cos[:, place]
                take = np.argsort(-np.round(cos, 6), axis=1, kind="stable")[:, : k + 1]
                value = np.take_along_axis(cos, take, 1)
                ok = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, take.shape[1])[ok.ravel()]), pa.array(ids[take][ok]), pa.array(value[ok])], names=["query_id", "id", "cos"])

        part = rows.select("id", "v").mapInArrow(run, "query_id long, id long, cos double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("cos", 6).desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def zscored(rows: DataFrame) -> DataFrame:
    """vec_id, v: coordinates of rows (vec_id, v) less their mean over their standard deviation; 0 where that is 0."""
    long = rows.select("vec_id", F.posexplode("v").alias("dim", "x"))
    stats = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("s"))
    z = F.zip_with("v", "s", lambda x, s: F.when(s["std"] > 0, (x - s["mean"]) / s["std"]).otherwise(0.0))
    return rows.join(F.broadcast(packed)).select("vec_id", z.alias("v"))


def scaled(rows: DataFrame) -> DataFrame:
    """vec_id, v: rows (vec_id, v) scaled to length 1; zero vectors stay zero."""
    known = rows.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    return known.select("vec_id", F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("v"))


def standardised(rows: DataFrame) -> DataFrame:
    """vec_id, v: the z-scores of rows (vec_id, v), scaled to length 1."""
    return scaled(zscored(rows))


def score(timbre: Column, band: Column, distance: Column, gap2: Column, bpm10: Column, energy: Column, tolerance: float = 0.06) -> dict[str, Column]:
    """The weighted parts of a pair's score, clamped to [0, 1] before weighting, and their total."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    w = SCORE_WEIGHTS
    parts = {
        "timbre_part": w["timbre"] * F.greatest(F.lit(0.0), timbre),
        "band_part": w["band"] * F.greatest(F.lit(0.0), band),
        "harmonic_part": w["harmonic"] * clamp(1.0 - distance / 3.0),
        "tempo_part": w["tempo"] * clamp(1.0 - (gap2 / 2.0) / (tolerance * bpm10)),
        "energy_part": w["energy"] * clamp(energy),
    }
    return parts | {"score": sum(parts.values(), F.lit(0.0))}


def target_energy(preset: str, x: Column) -> Column:
    """Energy that a preset asks for at position x in [0, 1]."""
    return {"linear_rise": 0.3 + 0.6 * x, "classic_arc": 0.35 + 0.55 * F.sin(x * np.pi * 0.9), "flat": F.lit(0.6), "descending": 0.9 - 0.6 * x}[preset]


Ranked = list[tuple[int, float]]  # next tracks and scores, best first


def draw(strict: Ranked, relaxed: Ranked, used: set[int], rng: random.Random, top: int = 5) -> int | None:
    """One of the `top` best unused tracks, by score; from the relaxed ones if there is no strict one; else none."""
    options = [e for e in strict if e[0] not in used][:top] or [e for e in relaxed if e[0] not in used][:top]
    return rng.choices([t for t, _ in options], [max(1e-9, s) for _, s in options])[0] if options else None


def widen(beam: list[tuple[float, list[int]]], edges: dict[int, Ranked], width: int) -> list[tuple[float, list[int]]]:
    """The `width` best sets that are one track longer than those of the beam (total score, tracks)."""
    grown = [(s + e, [*path, t]) for s, path in beam for t, e in edges.get(path[-1], ()) if t not in path]
    return sorted(grown, key=lambda b: (-b[0], b[1]))[:width]


def plan_greedy(edges: dict[int, Ranked], relaxed: dict[int, Ranked], seed_track: int, minutes: dict[int, float], total: float, seed: int = 0) -> list[int]:
    """Tracks of a set over a known graph of next tracks, until the set is long enough or there is no next track."""
    rng, chosen = random.Random(seed), [seed_track]
    while sum(minutes[t] for t in chosen) < total:
        pick = draw(edges.get(chosen[-1], []), relaxed.get(chosen[-1], []), set(chosen), rng)
        if pick is None:
            break
        chosen.append(pick)
    return chosen


def plan_beam(edges: dict[int, Ranked], seed_track: int, steps: int, width: int = 10) -> list[int]:
    """The set of the largest total score among those that a beam of `width` partial sets reaches."""
    beam = [(0.0, [seed_track])]
    for _ in range(steps):
        grown = widen(beam, edges, width)
        if not grown:
            break
        beam = grown
    return beam[0][1]
