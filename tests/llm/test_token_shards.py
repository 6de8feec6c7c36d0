import hashlib
import random

import numpy as np
import pytest

from sonolith.llm.token_shards import END_ID, Permutation, Tokenizer, read_slots, token_shards


def test_permutation_is_a_keyed_bijection():
    for n in (1, 2, 3, 7, 64, 65, 1000, 4097):
        p = Permutation(n, "a")
        got = p.slots(np.arange(n))
        assert sorted(got.tolist()) == list(range(n))
        assert (p.indexes(got) == np.arange(n)).all()
    a, b = (Permutation(1000, k).slots(np.arange(1000)) for k in "ab")
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.15


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    words = ["The", "the", "rain", "é", "日本", "it's", "\n", "  x", "1234", "!!"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60))), "x") for i in range(150)]
    rows += [(500, None, "x"), (501, "", "x"), (None, "no number here", "x"), rows[0], rows[0], (502, "long text " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(5)
    path = f"file://{tmp_path}/shards"
    length, per = 32, 16
    manifest = sorted(token_shards(df, path, length=length, per_shard=per).collect(), key=lambda r: r.slot)
    n = len(manifest)
    assert [r.slot for r in manifest] == list(range(n)) and sorted(r.seq_index for r in manifest) == list(range(n))
    records = read_slots(path, 0, n)
    assert records.shape == (n, length)
    for r in manifest:
        assert r.sha256 == hashlib.sha256(records[r.slot].tobytes()).hexdigest()
        assert (r.shard, r.byte_offset) == (r.slot // per, r.slot % per * length * 2)
        assert r.slot == Permutation(n, "order").slots(np.array([r.seq_index]))[0]
    stream = records[[r.slot for r in sorted(manifest, key=lambda r: r.seq_index)]].reshape(-1)
    used = sum(r.n_tokens for r in manifest)
    assert (stream[used:] == END_ID).all() and len(stream) - used < length
    ends = np.flatnonzero(stream[:used] == END_ID)
    tok = Tokenizer()
    back = [tok.ready().decode(p.tolist()) for p in np.split(stream[:used], ends + 1)[:-1] for p in [p[:-1]]]
    assert sorted(back) == sorted(t for _, t, _ in rows if t)
    whose = [d for r in sorted(manifest, key=lambda r: r.seq_index) for d in r.doc_ids]
    assert {d for d in whose} == {i for i, t, _ in rows if t}
    assert (read_slots(path, 5, 30) == records[5:35]).all() and len(read_slots(path, n - 2, 10)) == 2


def test_tokenising_twice_gives_the_same(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["a", "bb", "ccc"], k=rng.randint(0, 50)))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    a, b = (sorted(token_shards(df, f"file://{tmp_path}/{k}", length=16, per_shard=8, keep_tokens=k).collect()) for k in (True, False))
    n = sum(len(Tokenizer().encode(t)) for _, t in rows)
    assert len(a) == len(b) == -(-n // 16)
    assert sum(r.n_tokens for r in b) == n


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_shards(df, f"file://{tmp_path}/none").count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert token_shards(blank, f"file://{tmp_path}/blank").count() == 0


def test_vocabulary_is_a_parameter():
    with pytest.raises(FileNotFoundError):
        Tokenizer("/nowhere/ranks")


def test_second_pass_splits_files_as_the_first(spark, tmp_path):
    """Cores that come or go between the passes do not change the partitions."""
    spark.createDataFrame([(i, f"text number {i} " * 40) for i in range(4000)], "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/docs")
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    spark.conf.set(names[2], "1")
    try:
        spark.conf.set(names[0], "8")
        manifest = token_shards(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/out", length=64, per_shard=64, keep_tokens=False)
        spark.conf.set(names[0], "2")
        assert sum(r.n_tokens for r in manifest.collect()) > 0
    finally:
        for name in names:
            spark.conf.unset(name)
