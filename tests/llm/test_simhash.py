import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sonolith.llm.components import components
from sonolith.llm.simhash import block_masks, links, near_duplicates


def brute_fingerprint(text, k=4):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["É x", "Émile", "ABC"]
    texts = [None, "", " \t\n", "one", "One", "one two three", "É É É É É", "a\x0bb\x0cc d e"]
    for _ in range(120):
        words = rng.choices(vocabulary, k=rng.randint(1, 120))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append("  ".join(copy))
    texts.append("long " * 70000)
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)]
    rows += [rows[9], (None, None, "x"), (None, "only this one here with no number", "x")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = {t: brute_fingerprint(t) for _, t, _ in rows}
    nodes = sorted(set(fps.values()))
    linked = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= 4]
    root = brute_roots(nodes, linked)
    low = {}
    for d, t, _ in rows:
        if d is not None:
            low[root[fps[t]]] = min(d, low.get(root[fps[t]], d))
    key = lambda r: str(r)
    want = sorted(((d, fps[t], low.get(root[fps[t]])) for d, t, _ in rows), key=key)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == want
    assert len(linked) > 20


def test_large_groups_are_split_without_loss(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(400)}
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    linked = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % 2**64).bit_count() <= 4]
    want = brute_roots(signed, linked)
    for tile in (2048, 16):
        got = {r.node: r.root for r in components(links(df, 4, tile)).collect()}
        assert {f: got.get(f, f) for f in signed} == want


def test_masks_guarantee_a_shared_block():
    masks = block_masks(4)
    rng = random.Random(1)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not diff & m for m in masks)


def test_components_of_paths_and_stars(spark):
    rows = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, 8), (2000, 1999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61))
    assert all(got[i] == 1000 for i in range(1000, 1100))
    assert got[2000] == got[1999] == 1999
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string").withColumn("key", F.lit(1))).count() == 0
