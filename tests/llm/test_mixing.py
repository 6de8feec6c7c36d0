import hashlib
import heapq
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from sonolith.llm import mixing
from sonolith.llm.mixing import OP5_SQL, PACKET, mix_plan, mixed


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: total * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
            free.discard(s)
    return target


def brute_taken(data, target):
    """Words taken of each row, by serving packet after packet from a heap of the sources' next ones."""
    size = [len((t or "").encode().split()) for _, t, _, _ in data]
    key = lambda i: (hashlib.md5(f"{f'null{size[i]}' if data[i][0] is None else data[i][0]}:mix".encode()).hexdigest(), data[i][0] or 0, size[i])
    heap, taken, left = [], [0] * len(data), int(1.5 * sum(size))
    for s in target:
        own = sorted((i for i in range(len(data)) if data[i][2] == s), key=key)
        packets = iter([(i, min(PACKET, size[i] - k)) for _ in range(2) for i in own for k in range(0, size[i], PACKET)])
        heap.append([0, s is None, s or "", 0, packets, None])
    queue = []

    def push(entry):
        at = entry[3]
        for i, n in entry[4]:
            heapq.heappush(queue, [(at + n) / target[None if entry[1] else entry[2]], entry[1], entry[2], at + n, entry[4], (i, n)])
            break

    for entry in heap:
        push(entry)
    while left and queue:
        entry = heapq.heappop(queue)
        i, n = entry[5]
        taken[i] += min(n, left)
        left -= min(n, left)
        push(entry)
    return taken


def rows(n, seed):
    rng = random.Random(seed)
    out = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "é", "Z", None, "zz"]), "x") for i in range(n)]
    return out + [(n, None, "a", "x"), (n + 1, "", "only-empty", "x"), (None, "null id", "b", "x"), out[3], out[3], (n + 2, "w\x0bw w " * 9000, "b", "x")]


def test_plan(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_PACKETS", 16)
    for n, seed in ((400, 1), (7, 2)):
        data = rows(n, seed)
        df = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
        got = mix_plan(df).toPandas()
        assert len(got) == len(data)
        size = {}
        for _, t, s, _ in data:
            size[s] = size.get(s, 0) + len((t or "").encode().split())
        want = brute_targets(size)
        source = {d: s for d, _, s, _ in data}
        got["source"] = [source[None if pd.isna(d) else int(d)] for d in got.doc_id]
        for s, part in got.groupby(got.source.map(str)):
            s = None if s == "None" else s
            assert abs(part.target.iloc[0] - want[s]) < 1e-6 * max(1, want[s])
            assert part.source_size.iloc[0] == size[s]
            assert abs(want[s] - part.taken.sum()) <= 2 * PACKET
        assert (got.taken <= 2 * got["size"]).all() and got.taken.sum() == int(1.5 * sum(size.values()))
        served = sorted((-1 if d is None else d, len((t or "").encode().split()), n) for (d, t, _, _), n in zip(data, brute_taken(data, want), strict=True))
        assert served == sorted((-1 if pd.isna(d) else int(d), int(z), int(n)) for d, z, n in zip(got.doc_id, got["size"], got.taken, strict=True))
        finish = got.finish.dropna()
        assert (finish.diff().dropna() >= 0).all()
        again = mix_plan(df.repartition(7)).toPandas()
        pd.testing.assert_frame_equal(got.drop(columns="source").sort_values(["doc_id", "finish"]).reset_index(drop=True), again.sort_values(["doc_id", "finish"]).reset_index(drop=True))


def test_against_sql(spark):
    data = rows(300, 5)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text", "source", "size"]).astype({"doc_id": "Int64"}))
    want = con.execute(OP5_SQL).df().sort_values(["doc_id", "finish"]).reset_index(drop=True)
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    got = mix_plan(df).toPandas().sort_values(["doc_id", "finish"]).reset_index(drop=True)
    for c in want.columns:
        assert (want[c].fillna(-1).to_numpy(float) == got[c].fillna(-1).to_numpy(float)).all(), c


def test_documents(spark):
    data = rows(500, 9)
    df = spark.createDataFrame(data, "doc_id long, text string, source string, __SIZE string")
    out = mixed(df)
    assert out.columns == df.columns
    seen = out.groupBy("doc_id").count().where("count > 2 and doc_id <> 3").count()
    assert seen == 0
    assert out.where(F.col("text").isNull() | (F.col("text") == "")).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_plan(df).count() == 0 and mixed(df).count() == 0
    blank = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mix_plan(blank).collect()] == [(1, 0, 0, 0.0, 0, None)]
