"""Scored pairs against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonolith.operators import harmony as H
from sonolith.operators import ranking as R
from sonolith.operators import similarity as S
from sonolith.plans import library as L

SCHEMA = "id long, bpm10 long, number int, major boolean, key_conf long, energy long, timbre array<float>, band array<float>"


def tracks(n=400):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(n):
        vector = [rng.normal(size=size).astype(np.float32).tolist() for size in (6, 3)] if k % 7 else rows[-1][6:] if rows else [[1.0] * 6, [1.0] * 3]
        rows.append([k, int(rng.choice([700, 750, 752, 1400, 1500, 1504, 1600])), int(rng.integers(1, 13)), [True, False, None][int(rng.choice(3, p=[0.45, 0.45, 0.1]))], int(rng.integers(30, 101)), int(rng.integers(0, 101)), *vector])
    rows[5][6], rows[6][7], rows[8][6], rows[9][6] = [0.0] * 6, None, [None] * 6, [1.0] * 5
    return [tuple(r) for r in rows]


def plain(df):
    """The definition: every pair, column by column."""
    a, b = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for p in "ab")
    near = F.least(F.abs(F.col("b_bpm10") - F.col("a_bpm10")) * 2, F.abs(2 * F.col("b_bpm10") - F.col("a_bpm10")) * 2, F.abs(F.col("b_bpm10") - 2 * F.col("a_bpm10")))
    far = H.wheel_distance(F.col("a_number"), F.col("a_major"), F.col("b_number"), F.col("b_major"))
    pairs = a.where("a_id % 20 = 0").crossJoin(b).where("a_id <> b_id").withColumns({"gap2": near, "distance": far})
    pairs = pairs.where("gap2 * 100 <= 12 * a_bpm10 AND (distance <= 2 OR least(a_key_conf, b_key_conf) < 40)")
    energy = 1.0 - F.abs(F.col("b_energy") - F.least(F.lit(100), F.col("a_energy") + 10)) / 100.0
    parts = S.score(S.cosine(F.col("a_timbre"), F.col("b_timbre")), S.cosine(F.col("a_band"), F.col("b_band")), F.col("distance"), F.col("gap2"), F.col("a_bpm10"), energy)
    return {(r.a_id, r.b_id): tuple(r)[2:] for r in pairs.select("a_id", "b_id", *parts.values()).collect()}


def test_pairs_are_all_that_tempo_and_key_allow(spark, monkeypatch):
    monkeypatch.setattr(R, "SEED_BLOCK", 7)
    df = spark.createDataFrame(tracks(), SCHEMA).repartition(5).cache()
    want = plain(df)
    rows = R.scored_pairs(df, df.where("id % 20 = 0"), 400).collect()
    assert len(rows) == len(want) > 500 and {(r.a_id, r.b_id) for r in rows} == set(want)
    assert all(abs(x - y) < 6e-7 for r in rows for x, y in zip(tuple(r)[2:], want[r.a_id, r.b_id], strict=True))
    best = R.scored_pairs(df, df.where("id % 20 = 0"), 400, 3).collect()
    for seed in {r.a_id for r in rows}:
        mine = sorted((-r.score, r.b_id) for r in rows if r.a_id == seed)[:3]
        assert [(-r.score, r.b_id) for r in sorted(best, key=lambda r: r["rank"]) if r.a_id == seed] == mine


def test_every_pair_of_a_seed_is_scored(spark):
    """The ten best are the first of all."""
    top = L.next_track_top10(spark, "/root/testdata/sf0.01").drop("rank")
    assert top.exceptAll(L.score_breakdown(spark, "/root/testdata/sf0.01")).count() == 0


@pytest.mark.parametrize("name", ["next_track_top10", "score_breakdown"])
def test_pairs_are_no_rows_of_a_join(spark, name):
    plan = L.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Join") == 1  # that of parts and vectors


def test_parts_of_a_track_alone_are_taken_once():
    rows = [r for r in tracks() if r[1] == 1500]
    a = R.Tracks(pa.Table.from_pylist([dict(zip(R.FIELDS, r, strict=True)) for r in rows]))
    i, j = np.arange(len(rows) - 1), np.arange(len(rows))
    parts = R._parts(a, i, a, j, np.zeros(len(j), int))
    assert [p.shape for p in parts] == [(len(i) if many else 1, len(j)) for many in (1, 1, 0, 0, 1, 1)]
    with np.errstate(invalid="ignore"):
        assert np.array_equal(parts[5], parts[0] + parts[1] + parts[2] + parts[3] + parts[4], equal_nan=True)
    assert not R._cosines(np.zeros((2, 3)), np.ones((4, 3)), np.zeros(2), np.full(4, 3.0)).any()
