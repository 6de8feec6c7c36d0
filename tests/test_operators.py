from pyspark.sql import functions as F

from sonolith.operators import frames as R
from sonolith.operators import harmony as H
from sonolith.operators import similarity as S
from sonolith.operators import structure as T


def test_wheel(spark):
    keys = spark.range(24).select((F.col("id") % 12).cast("int").alias("p"), (F.col("id") < 12).alias("m"))
    got = {(r.name, r.m): r.c for r in keys.select(H.pitch_name(F.col("p")).alias("name"), "m", H.camelot_code(F.col("p"), F.col("m")).alias("c")).collect()}
    assert len(set(got.values())) == 24
    assert [got[k] for k in (("C", True), ("A", True), ("F#", True), ("A", False), ("F#", False), ("D", False))] == ["8B", "11B", "2B", "8A", "11A", "7A"]


def test_tempo_join_misses_none(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.randint(700, 1800)) for i in range(400)]
    for tolerance in (0.06, 0.10):
        left = spark.createDataFrame(rows, "a_id int, a_bpm10 int")
        right = spark.createDataFrame(rows, "b_id int, b_bpm10 int")
        got = [(r.a_id, r.b_id) for r in H.tempo_join(left, right, tolerance).collect()]
        pct = round(tolerance * 200)
        want = {(i, j) for i, a in rows for j, b in rows if min(abs(b - a) * 2, abs(2 * b - a) * 2, abs(b - 2 * a)) * 100 <= pct * a}
        assert len(got) == len(set(got)) and set(got) == want


def test_labels_and_boundaries(spark):
    one = spark.createDataFrame([(1, 0, 0.5)], "track_id int, sidx int, rms double")
    assert T.label_sections(one).first().label == "drop"
    still = spark.createDataFrame([(1, i, 0.0) for i in range(3)], one.schema)
    assert [r.label for r in T.label_sections(still).orderBy("sidx").collect()] == ["drop", "breakdown", "outro"]
    edge = spark.createDataFrame([(1, i, e) for i, e in enumerate((0.2, 0.5, 1.0, 0.88, 0.3, 0.1))], one.schema)
    assert [r.label for r in T.label_sections(edge).orderBy("sidx").collect()] == ["intro", "build", "drop", "drop", "breakdown", "outro"]
    kept = spark.createDataFrame([([0.0, 1.0, 2.5, 3.0, 9.5],)], "t array<double>").select(T.keep_boundaries(F.col("t"), F.lit(10.0), 2.0).alias("b")).first().b
    assert kept == [0.0, 2.5, 10.0]


def test_downbeats(spark):
    beats = spark.createDataFrame([(1, i, 10.0 if i in (1, 5) else 1.0) for i in range(8)] + [(2, i, float(i)) for i in range(3)], "track_id int, beat_idx int, energy double")
    assert {r.track_id: r.k for r in H.best_offset(beats).collect()} == {1: 1, 2: 0}


def test_as_of(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 2.5), (2, 1.0)], "track_id int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b")], "track_id int, t double, v string")
    assert sorted((r.track_id, r.t, r.v) for r in R.as_of(left, right, ["v"]).collect()) == [(1, 0.5, None), (1, 1.0, "a"), (1, 2.5, "b"), (2, 1.0, None)]


def test_sets():
    edges = {1: [(2, 0.9), (3, 0.8)], 2: [(3, 0.7), (1, 0.6)], 3: [(1, 0.5)]}
    minutes = dict.fromkeys((1, 2, 3, 4), 4.0)
    assert S.plan_greedy(edges, {3: [(4, 0.1)]}, 1, minutes, 16.0, seed=1)[0] == 1
    assert S.plan_greedy(edges, edges, 1, minutes, 12.0, seed=3) == S.plan_greedy(edges, edges, 1, minutes, 12.0, seed=3)
    assert S.plan_beam(edges, 1, 2) == [1, 2, 3]
