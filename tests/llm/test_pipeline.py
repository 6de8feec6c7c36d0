import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sonolith.llm.wide_simhash import similar_groups, without_copies


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_similar_groups_against_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, base = [], []
    for _ in range(60):
        base.append(rng.choices(vocabulary, k=rng.randint(150, 400)))
    for k, words in enumerate(base):
        rows.append(" ".join(words))
        for _ in range(k % 4):
            copy = list(words)
            for _ in range(rng.choice([1, 2, 3, 40])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    data = [(i * 2, t, "x") for i, t in enumerate(rows)]
    odd = [(9001, None, "x"), (9003, "", "x"), (None, "a b c", "x"), data[4], (9005, data[7][1], "x"), (9007, "one", "x")]
    df = spark.createDataFrame(data + odd, "doc_id long, text string, node string")
    for tile in (2048, 4):
        got = {}
        for r in similar_groups(df, tile=tile).collect():
            got.setdefault(r.doc_id, set()).add(r.component_id)
        assert len(got) == len(data) + 5 and all(len(v) == 1 for v in got.values())
        sure = maybe = 0
        for i in range(len(data)):
            for j in range(i):
                s = jaccard(data[i][1], data[j][1])
                same = got[data[i][0]] == got[data[j][0]]
                if s >= 0.8:
                    sure += 1
                    maybe += same
                elif s < 0.5:
                    assert not same
        assert sure > 40 and maybe == sure
        assert got[9001] == got[9003] == {9001} and got[9005] == got[data[7][0]] and got[9007] == {9007}
    kept = without_copies(df).collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and None in ids and 9003 not in ids and 9005 not in ids


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(12)
    parts = {"en": ["the", "ing", "wh", "er", "tion", "st"], "de": ["sch", "ich", "ü", "ung", "ver", "ei"]}
    docs = []
    for i in range(240):
        lang = "de" if i % 3 == 0 else "en"
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(30, 90))]
        docs.append([i, " ".join(words), lang, rng.choice(["a", "b", "c"]), 0])
    docs[10][1] = docs[3][1]
    docs[11][1] = docs[4][1] + " end"
    docs[12][1] = "123 456 !!"
    docs[13][1] = None
    item = " ".join("".join(rng.choices(parts["en"], k=3)) for _ in range(25))
    docs[20][1] += " " + item
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_stages(spark, corpus):
    sf_dir, docs = corpus
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == now.columns
        seen[name] = out.collect()
        now = spark.createDataFrame(seen[name], now.schema)
    kept = [{r.doc_id for r in seen[n]} for n, _ in corpus_pipeline.STAGES[:3]]
    every = {d[0] for d in docs}
    assert every - kept[0] == {12, 13}
    assert kept[0] - kept[1] == {10, 11}
    assert kept[1] - kept[2] == {20}
    sizes = {}
    for r in seen["benchmark decontamination"]:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    taken = {}
    for r in seen["mixing sources"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    target, total = {}, 1.5 * sum(sizes.values())
    share = {"a": 5, "b": 2, "c": 1}
    target["a"] = min(2 * sizes["a"], total * 5 / 8)
    rest = total - target["a"]
    target["b"] = min(2 * sizes["b"], rest * 2 / 3)
    target["c"] = rest - target["b"]
    assert len(share) == 3 and all(abs(taken[s] - target[s]) <= 90 for s in taken)


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0]).collect()
    assert [r.slot for r in sorted(out, key=lambda r: r.slot)] == list(range(len(out)))
    assert {d for r in out for d in r.doc_ids}.isdisjoint({10, 11, 12, 13, 20})


def test_similar_groups_are_exact_at_the_similarity(spark):
    """Pairs from just above to just below 0.8: all of the former are linked, none of the latter."""
    rng, rows, near = random.Random(21), [], 0
    for k in range(400):
        n = rng.choice([10, 11, 12, 13, 60, 150, 300])
        words = [f"v{k}x{i}" for i in range(n)]
        size = n - 4
        copy = list(words)
        if n < 20:
            copy[-1] = "end"
        else:  # each of c words far from others changes five shingles
            c = max(1, round(size * rng.choice([0.18, 0.2, 0.21, 0.22, 0.25, 0.28]) / 1.8 / 5))
            for i in rng.sample(range(5, n - 5, 6), min(c, len(range(5, n - 5, 6)))):
                copy[i] = f"c{k}x{i}"
        rows += [" ".join(words), " ".join(copy)]
        near += 0.8 <= jaccard(*rows[-2:]) < 0.85
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_groups(df).collect()}
    assert near > 40 and len(got) == len(rows)
    for k in range(0, len(rows), 2):
        assert (got[k] == got[k + 1]) == (jaccard(rows[k], rows[k + 1]) >= 0.8), (k, jaccard(rows[k], rows[k + 1]))


def test_repeated_ids_with_other_texts(spark):
    """A doc_id whose one text is a copy loses that text only."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcde"}
    rows = [(1, text["a"], "1"), (2, text["a"], "2"), (2, text["b"], "3"), (3, text["c"], "4"), (3, text["c"], "5"), (4, text["d"], "6"), (4, text["d"] + " end", "7"), (4, text["e"], "8"), (None, text["a"], "9")]
    kept = {r.tag for r in without_copies(spark.createDataFrame(rows, "doc_id long, text string, tag string")).collect()}
    assert kept - {"4", "5", "6", "7"} == {"1", "3", "8", "9"}
    assert len(kept & {"4", "5"}) == len(kept & {"6", "7"}) == 1


CLASHING = ("lang_pred", "lang_score", "contamination", "toxic_score", "__key", "__node", "__SIZE", "__found", "__copies", "__end", "node", "root", "component_id", "size", "value")


def test_stages_keep_columns_of_any_name(spark, corpus):
    sf_dir, docs = corpus
    now = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    for k, name in enumerate(CLASHING):
        now = now.withColumn(name, F.col("doc_id") * 100 + k)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == now.columns, name
        rows = out.collect()
        assert len(rows) > 20 and all(r[c] == r.doc_id * 100 + k for r in rows for k, c in enumerate(CLASHING)), name
        now = spark.createDataFrame(rows, now.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).count() > 0


def test_stages_on_odd_tables(spark, corpus, tmp_path):
    """Empty tables; rows of nulls; repeated rows and ids; a tie between equal texts."""
    sf_dir, docs = corpus
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    text = docs[5][1]
    odd = [(None, None, None, None, None), (None, None, None, None, None), (7, "", "en", "a", 0), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (2, text, "en", None, 1), (2, docs[6][1], None, "a", 1), (None, docs[7][1], "en", "a", None)]
    for rows in ([], odd):
        now = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf_dir)
            assert out.columns == now.columns
            got = out.collect()
            if rows and name == "SimHash near-dedup":
                assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(2, text), (2, docs[6][1]), (0, docs[7][1])])
            now = spark.createDataFrame(got, schema)
        now.write.parquet(f"{tmp_path}/last-{len(rows)}")
        assert (corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{tmp_path}/last-{len(rows)}"), sf_dir).count() > 0) == bool(rows)
    none = spark.createDataFrame([], "item_id long, text string")
    (tmp_path / "bare").mkdir()
    none.write.parquet(f"{tmp_path}/bare/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/bare/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/bare").count() == 0


def test_copies_are_chosen_alike_in_each_run(spark):
    rows = [(1, "one two three four five six", tag) for tag in "fabced"] + [(2, "seven eight nine ten eleven twelve", "z")]
    for k in (1, 3):
        kept = without_copies(spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(k)).collect()
        assert sorted(r.tag for r in kept) == ["a", "z"]
