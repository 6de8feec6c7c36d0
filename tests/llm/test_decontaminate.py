import random
import re
from collections import Counter

import numpy as np

from sonolith.llm.decontaminate import BlockIndex, find_matches


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def bag(w, k=5):
    k = min(k, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(text, item):
    """The best similarity of any window of the item's size."""
    w, v = words(text), words(item)
    if not v:
        return 0.0
    want, best = bag(v), 0.0
    for p in range(len(w) - len(v) + 1):
        got = bag(w[p : p + len(v)])
        best = max(best, sum((got & want).values()) / sum((got | want).values()))
    return best


def make(rng, vocabulary):
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 60)))) for i in range(25)]
    items += [(100, "Only four words here"), (101, "two words"), (102, None), (None, "no id for this one"), (103, " ,. "), items[0], (104, "again again again again again again again again and more of it")]
    docs = []
    for i in range(160):
        w = rng.choices(vocabulary, k=rng.randint(0, 150))
        if i % 2:
            item = [x for x in items if x[1]][i % 25][1].split()
            if i % 3 == 0 and len(item) > 5:
                item[rng.randrange(len(item))] = "changed"
            if i % 5 == 0:
                item = item[: max(1, int(len(item) * 0.9))]
            p = rng.randint(0, len(w))
            w[p:p] = item
        docs.append((i, (", " if i % 7 == 0 else " ").join(w).title() if i % 4 == 0 else " ".join(w), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "word", "x"), (None, items[3][1], "x"), (903, "filler words " * 30000 + items[5][1], "x"), docs[1], docs[1], (904, "x ONLY four-words HERE y two   words again again again again again again again again and more of it", "x")]
    return items, docs


def test_against_all_windows(spark):
    rng = random.Random(8)
    items, docs = make(rng, [f"w{i}" for i in range(400)] + ["é", "of", "the"])
    df = spark.createDataFrame(docs, "doc_id long, text string, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    usable = [(i, t) for i, t in items if i is not None and t]
    for block in (16 << 20, 700):
        out = find_matches(df, bench, block_bytes=block).collect()
        assert len(out) == len(docs)
        for row in out:
            got = sorted((m.item_id, round(m.similarity, 9)) for m in row.contamination)
            if row.doc_id == 903:
                assert 5 in [i for i, _ in got]
                continue
            want = sorted((i, round(s, 9)) for i, t in usable if (s := brute(row.text, t)) >= 0.8)
            assert got == want, row.doc_id
            w = words(row.text)
            for m in row.contamination:
                item = bag(words(dict(usable)[m.item_id]))
                here = bag(w[m.start : m.start + m.n_words])
                assert abs(sum((here & item).values()) / sum((here | item).values()) - m.similarity) < 1e-9


def test_block_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    probes = items[rng.integers(0, 300, 200)].copy()
    for k in range(len(probes)):
        for b in rng.choice(64, rng.integers(0, 9), replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(b)
    p, i = BlockIndex(items, 6).near(probes)
    want = {(a, b) for a in range(200) for b in range(300) if bin(int(probes[a] ^ items[b])).count("1") <= 6}
    assert set(zip(p.tolist(), i.tolist(), strict=True)) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_matches(docs, none).first().contamination == []
    assert find_matches(docs.where("false"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_texts_shorter_than_an_item(spark):
    """Against the whole text as one window."""
    rng = random.Random(31)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=rng.randint(12, 70)))) for i in range(30)]
    items += [(50, " ".join(f"s{k}" for k in range(59))), (51, "only four words here")]
    docs = [(1000, " ".join(items[30][1].split()[:-3])), (1001, "only four words"), (1002, "w1 w2 w3")]
    for i in range(150):
        w = items[i % 30][1].split()
        cut = rng.randint(1, 1 + len(w) // 5)
        w = w[cut:] if i % 3 == 0 else w[:-cut]
        if i % 4 == 0:
            w[len(w) // 2] = "changed"
        docs.append((i, " ".join(w)))
    out = find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = 0
    for row in out:
        w, want = words(row.text), {}
        for i, t in items:
            v = bag(words(t))
            if len(w) < len(words(t)):
                got = bag(w)
                want[i] = sum((got & v).values()) / sum((got | v).values())
            else:
                want[i] = brute(row.text, t)
        want = {i: round(s, 9) for i, s in want.items() if s >= 0.8}
        assert {m.item_id: round(m.similarity, 9) for m in row.contamination} == want, row.doc_id
        assert all(m.start + m.n_words <= len(w) for m in row.contamination)
        found += len(want)
    assert found > 60
    first = next(r for r in out if r.doc_id == 1000).contamination
    assert [(m.item_id, m.start, m.n_words, round(m.similarity, 9)) for m in first] == [(50, 0, 56, round(52 / 55, 9))]
