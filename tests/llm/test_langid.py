import random

import numpy as np
from pyspark.sql import functions as F

from sonolith.llm.langid import DIM, Featurizer, fit_temperature, fold, identify, train, train_ftrl

SYLLABLES = {"en": ["the", "ing", "th", "wh", "sh", "er", "tion"], "de": ["sch", "ich", "ü", "ß", "ei", "ung", "ver"], "fr": ["eau", "é", "ç", "que", "oi", "eux", "è"]}


def make(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def rows(n=600):
    rng = random.Random(11)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", "fr"])
        out.append((i, make(rng, lang, rng.randint(3, 60)), lang))
    return out


def test_held_out_accuracy_and_cases(spark):
    data = rows()
    odd = [(9000, None, "en"), (9001, "", "de"), (9002, "123 -- %%% \n", "fr"), (None, make(random.Random(1), "de", 30), None), (9003, make(random.Random(2), "fr", 30000), None), (9004, "THE THING WHING SHTION THER", None), (9005, "𝒳" * 5 + " 日本語", None), data[3]]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in data + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    held = df.withColumn("held", fold("doc_id", 4) == 2)
    out = identify(held, train(held.where(~F.col("held")))).collect()
    assert len(out) == len(data) + len(odd)
    test = [r for r in out if r.held and r.doc_id is not None and r.doc_id < 9000]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].lang_score == 0.0 for i in (9000, 9001, 9002))
    assert by[None].lang_pred == "de" and by[9003].lang_pred == "fr" and by[9004].lang_pred == "en"
    assert all(0 <= r.lang_score <= 1 for r in out) and by[9005].lang_pred in ("en", "de", "fr")
    again = {r.doc_id: r.lang_score for r in identify(held, train(held.repartition(5).where(~F.col("held")))).collect()}
    assert all(abs(again[r.doc_id] - r.lang_score) < 1e-6 for r in out)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert train(empty) is None and identify(empty, None).count() == 0
    assert [(r.lang_pred, r.lang_score) for r in identify(spark.createDataFrame([(1, "the", None)], empty.schema), None).collect()] == [("und", 0.0)]


def test_penalties_make_weights_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, *rng.integers(10, 500, 5)]), np.ones(6, np.float32) / 6**0.5, y) for y in rng.integers(0, 2, 400)]
    rows = [(np.unique(i), np.ones(len(np.unique(i)), np.float32) / 6**0.5, int(y)) for i, _, y in rows]
    w = train_ftrl(rows, 2, l1=0.5)
    assert (w[:DIM] != 0).mean() < 0.02 and w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]


def test_temperature_restores_calibration():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(fit_temperature(logits * 5, y) - 5) < 0.6


def test_features_count_every_gram():
    index, counts = Featurizer()("Abc, ab")
    # " abc ab ": 8 symbols, 7 pairs, 6 triples
    assert counts.sum() == 8 + 7 + 6
