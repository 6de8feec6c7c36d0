import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sonolith.llm.langid import fold
from sonolith.llm.toxicity import CELLS, ORDER, SYMBOLS, Grams, kneser_ney, score, train


def brute_symbols(text):
    import unicodedata

    out = []
    for ch in text or "":
        base = unicodedata.normalize("NFD", ch.lower())[:1]
        s = 1 + ord(base) - 97 if "a" <= base <= "z" else 27 if ch.isdigit() else 28 if ch.isalpha() else 0
        if s or not out or out[-1]:
            out.append(s)
    lead = [0] * (ORDER - 1)
    line = lead + (out[1:] if out and out[0] == 0 else out)
    return line + ([0] if line[-1] or len(line) == len(lead) else [])


def brute_grams(text):
    line = brute_symbols(text)
    return [tuple(line[i - ORDER + 1 : i + 1]) for i in range(ORDER - 1, len(line))]


def cells(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Grams()(data, np.array([0, len(data)]))[0].tolist()


def test_grams():
    for text in ("Idiot, é1 日", "a", "ab  cd", "x\n\ny "):
        want = [sum(s * SYMBOLS ** (ORDER - 1 - k) for k, s in enumerate(g)) for g in brute_grams(text)]
        got = cells(text)
        assert got[: len(want)] == want or Counter(got) == Counter(want), text


def test_rows_do_not_mix():
    texts = ["abc", "", "é?", "idiot idiot"]
    raw = [t.encode() for t in texts]
    cell, row = Grams()(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(texts):
        if t:
            assert cell[row == k].tolist() == cells(t)


def brute_kn(own, both, gram, d=0.75):
    """Interpolated Kneser-Ney by definition, with the two lowest orders shared."""

    def counts(k, table):
        out = Counter({g: c for g, c in table.items()})
        for _ in range(ORDER - k):
            out = Counter(g[1:] for g in out)
        return out

    p = 1 / SYMBOLS
    for k in range(1, ORDER + 1):
        table = counts(k, both if k < 3 else own)
        by = defaultdict(dict)
        for g, c in table.items():
            by[g[:-1]][g[-1]] = c
        g = gram[ORDER - k :]
        seen = by.get(g[:-1])
        if seen:
            total = sum(seen.values())
            p = max(seen.get(g[-1], 0) - d, 0) / total + d * len(seen) / total * p
    return math.log(p)


def test_kneser_ney_by_definition():
    a, b = Counter(brute_grams("the idiot said that the idiot did it")), Counter(brute_grams("that was the thing to do and say then"))
    dense = [np.zeros(CELLS), np.zeros(CELLS)]
    for v, table in zip(dense, (a, b), strict=True):
        for g, c in table.items():
            v[sum(s * SYMBOLS ** (ORDER - 1 - k) for k, s in enumerate(g))] = c
    got = kneser_ney(dense[0], dense[0] + dense[1])
    for g in [*a, *b, (1, 2, 3, 4), (0, 0, 0, 26)]:
        assert abs(got[sum(s * SYMBOLS ** (ORDER - 1 - k) for k, s in enumerate(g))] - brute_kn(a, a + b, g)) < 1e-9


def make(n=900):
    rng = random.Random(4)
    plain, bad = ["the", "rain", "falls", "on", "town", "and", "river", "stone"], ["idiot", "scum", "vequta", "vequre"]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.15)
        words = rng.choices(plain, k=rng.randint(20, 120))
        for _ in range(max(1, len(words) // 20) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_cases(spark):
    docs, labels = make()
    truth = dict(labels)
    odd = [(5000, None), (5001, ""), (None, "idiot scum"), (5002, "the rain falls " * 30000), (5003, "idiot scum idiot"), docs[2], docs[2]]
    df = spark.createDataFrame([(*r, "x") for r in docs + odd], "doc_id long, text string, toxic string").withColumn("held", fold("doc_id", 5) == 0)
    marks = spark.createDataFrame([*labels, (None, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    out = score(df, train(df.where(~F.col("held")), marks)).collect()
    assert len(out) == len(docs) + len(odd)
    test = [r for r in out if r.held and r.doc_id is not None and r.doc_id < 5000]
    assert sum((r.toxic_score >= 0.5) == truth[r.doc_id] for r in test) / len(test) > 0.97
    by = {r.doc_id: r.toxic_score for r in out}
    assert by[5000] == by[5001] < 0.5 and by[5002] < 0.5 and by[5003] > 0.5 and by[None] > 0.5


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert train(empty, marks) is None and score(empty, None).count() == 0
    one = spark.createDataFrame([(1, "a b")], empty.schema)
    assert train(one, marks) is None and score(one, None).first().toxic_score == 0.0
