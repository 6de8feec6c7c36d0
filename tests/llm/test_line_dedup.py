import random

import numpy as np
import pytest
import xxhash

from sonolith.llm.line_dedup import BUCKET_BITS, MANY, MAP_BITS, Lines, Order, Sets, _bits, _marked, by_document, class_ids, least_difference, levels_of, line_decisions, overlap_needed, suffix_signatures, without_repeats
from sonolith.llm.textops import SpanHasher


def tokens(line):
    return frozenset(line.translate({c: c + 32 for c in range(65, 91)}).encode().split())


def text_id(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, t=0.8):
    """Decisions by comparing all pairs of lines: by doc_id, text and line."""
    every = {}
    for d, text in rows:
        for k, line in enumerate((text or "").split("\n") if text else []):
            every[d, text, k] = tokens(line)
    place = lambda x: (x[0] is None, x[0] or 0, text_id(x[1]), x[2])
    first = {}
    for at in sorted(every, key=place):
        first.setdefault(every[at], at)
    links, later = dict.fromkeys(first, 0), dict.fromkeys(first, False)
    sets = [s for s in first if s]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if len(a & b) / len(a | b) >= t - 1e-12:
                links[a] += 1
                links[b] += 1
                late = max(a, b, key=lambda s: place(first[s]))
                later[late] = True
    return {at: (len(s), bool(s) and (at != first[s] or later[s]), links[s] if s else 0) for at, s in every.items()}


def decided(df, rows, **options):
    """The decisions in the form of brute()."""
    texts = {(d, text_id(t)): t for d, t in rows}
    got, times = {}, {}
    for r in line_decisions(df, **options).collect():
        if r.line >= 0:
            at = (r.doc_id, texts[r.doc_id, r.text_id], r.line)
            assert got.setdefault(at, (r.n, r.removed, r.links)) == (r.n, r.removed, r.links)
            times[at] = times.get(at, 0) + 1
    assert all(n == rows.count(at[:2]) for at, n in times.items())
    return got


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["the", "of", "É", "a"] * 20
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(0, rng.choice([30, 30, 200])))) for _ in range(120)]
    rows = []
    for d in range(90):
        own = []
        for _ in range(rng.randint(0, 8)):
            words = rng.choice(lines).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(words)
            own.append("  ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        rows.append((d * 5 + 1, "\n".join(own)))
    rows += [(9000, None), (9001, ""), (9002, "\n\n"), (None, lines[3]), (9003, "w1 " * 20000 + "\n" + "\n".join(lines[:5])), rows[7], (9004, "one\ntwo\none\nONE ")]
    odd = "one of these lines is of a row with no id\n" + lines[9]
    rows += [(None, odd), (None, "other line\n" + odd), (None, odd), (9005, lines[20]), (9005, lines[20] + "\n" + lines[21] + " x"), (36, lines[3] + "\nmore"), (9006, "the of a\nthe of É\n" + "a" * 300 + " b c d\n\n")]
    return rows


@pytest.mark.parametrize("options", [{}, {"tile": 5, "hot": 10, "batch_rows": 500}])
def test_against_all_pairs(spark, options):
    rows = make(3)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line int").repartition(3)
    want = brute(rows)
    assert decided(df, rows, **options) == want
    assert sum(v[2] for v in want.values()) > 150


@pytest.mark.parametrize("similarity", [0.55, 0.9])
def test_similarities(spark, similarity):
    rows = make(4)[:70]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert decided(df, rows, similarity=similarity, hot=3, tile=8) == brute(rows, similarity)


def test_many_variants_of_a_line(spark):
    rng = random.Random(9)
    for size, options in ((30, {}), (260, {"tile": 16, "hot": 8})):
        base = [f"x{i}" for i in range(size)]
        rows = []
        for d in range(150):
            words = list(base)
            for _ in range(size // 30):
                words[rng.randrange(size)] = f"y{d % 40}"
            rows.append((d, " ".join(words)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert decided(df, rows, **options) == brute(rows)


def test_documents(spark):
    rows = make(5)
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, __ID string")
    want = brute(rows)
    expect = sorted(str((d, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not t or not want[d, t, k][1]))) for d, t in rows)
    out = without_repeats(df)
    assert out.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == expect
    by = by_document(line_decisions(df)).collect()
    assert len(by) == len({(d, t or "") for d, t in rows})
    for r in by:
        text = next(t for d, t in rows if d == r.doc_id and text_id(t) == r.text_id)
        own = [want[r.doc_id, text, k] for k in range(r.n_lines)]
        assert r.n_lines == (text.count("\n") + 1 if text else 0) and r.removed_lines == [k for k, w in enumerate(own) if w[1]]
        assert r.n_removed == len(r.removed_lines) and r.n_links == sum(w[2] for w in own)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_decisions(df).count() == 0 and without_repeats(df).count() == 0


def test_lines_of_rows():
    texts = ["a b\n\nb a a", "", "x\n", "\ny", "y"]
    raw = [t.encode() for t in texts]
    data, offsets, lines = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), Lines()
    row, number, begins, stops = lines.spans(data, offsets)
    assert list(zip(row.tolist(), number.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0)]
    assert [bytes(data[a:z]).decode() for a, z in zip(begins, stops, strict=True)] == ["a b", "", "b a a", "x", "", "", "y", "y"]
    own, cut, end, token = lines.sets(data, begins, stops, None)
    assert own.tolist() == [0, 2, 3, 6, 7] and (end - cut).tolist() == [2, 2, 1, 1, 1]
    h, h2 = class_ids(token, cut)
    assert h[0] == h[1] != h[2] and h[3] == h[4] and h2[0] == h2[1] != h[0]


def test_tokens_go_by_the_order():
    rng = np.random.default_rng(2)
    order = Order(levels_of(rng.integers(0, 1000, 1 << BUCKET_BITS)))
    raw = np.frombuffer(b" ".join(str(x).encode() for x in rng.integers(0, 50, 90)), np.uint8)
    _, _, _, token = Lines().sets(raw, np.array([0]), np.array([len(raw)]), order)
    assert token.tolist() == sorted(token.tolist(), key=lambda h: (int(order.level(np.array([h], np.uint64))[0]), h)) and len(token) > 30


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(4)
    pruned = 0
    for k in range(600):
        n = int(rng.integers(2, 500))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        keep = int(n * rng.random())
        b = np.concatenate([a[:keep], rng.integers(0, 2**63, int(rng.integers(2, 500))).astype(np.uint64)])
        from_, m = k % 2, len(b)
        sign = suffix_signatures(np.concatenate([a, b]), np.array([n, n + m]), np.array([from_, n + from_]), np.array([n, m]))
        low = int(least_difference(sign[:, :1], sign[:, 1:], np.array([n]), np.array([m]))[0])
        assert low <= n + m - 2 * keep
        pruned += low > 20
    assert pruned > 100 and MANY == 200


def test_long_words_that_a_polynomial_confuses():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    assert len(a) == 2048
    raw = np.frombuffer((a + b).encode(), np.uint8)
    h = SpanHasher()(raw, np.array([0, 2048]), np.array([2048, 4096]))
    assert a != b and h[0] != h[1]


def test_cheap_tests_of_a_pair_lose_none_that_is_similar():
    rng = np.random.default_rng(8)
    order = Order(np.zeros(1 << BUCKET_BITS, np.uint8))
    words = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))  # in the order: by hash, as all levels are 0
    kept = [np.sort(rng.choice(400, size=int(n), replace=False)) for n in rng.integers(4, 120, 40)]
    kept += [np.sort(np.unique(np.append(rng.choice(k, size=max(4, len(k) * 9 // 10), replace=False), rng.integers(0, 400, 2)))) for k in kept for _ in range(4)]
    sets = Sets([words[k].tobytes() for k in kept], order)
    i, j = np.triu_indices(len(kept), 1)
    shared, first, second = sets.common(i, j)
    similar = shared >= np.maximum(1, overlap_needed(sets.sizes[i], sets.sizes[j], 0.8))
    near = sets.near(i, j, 0.8)
    assert similar.sum() > 100 and near[similar].all() and near.sum() < 0.3 * len(i)
    some, head, after = sets.common(i[similar], j[similar], 0.8)
    assert (some >= 2).all() and (head == first[similar]).all() and (after == second[similar]).all()


def test_lines_are_marked_by_their_place():
    """The map of the lines to fetch is made by Spark's expressions and read by the workers."""
    doc, text, line = np.array([5, (1 << 63) - 1, 0]), np.array([-3, 1 << 62, 77]), np.array([0, 9, 1 << 20])
    mask = (1 << MAP_BITS) - 1
    plain = [(int(t) % (1 << 64) >> 64 - MAP_BITS) ^ int(n) & mask ^ int(d) & mask for d, t, n in zip(doc, text, line, strict=True)]
    assert _bits(doc, text, line).tolist() == plain


def test_map_of_spark_is_that_of_the_workers(spark):
    rows = [(5, -3, 0), ((1 << 63) - 1, 1 << 62, 9), (0, 77, 1 << 20)]
    found = _marked(spark.createDataFrame(rows, "doc long, text_id long, line long"))
    assert np.flatnonzero(np.unpackbits(found, bitorder="little")).tolist() == sorted(_bits(*np.array(rows).T).tolist())


def test_common_tokens_are_found_by_merging(monkeypatch):
    rng = np.random.default_rng(17)
    order = Order(rng.integers(0, 90, 1 << BUCKET_BITS).astype(np.uint8))
    names = rng.integers(1, 1 << 63, 60).astype(np.uint64)
    names = names[np.lexsort((names, order.level(names)))]
    raw = [names[np.sort(rng.choice(60, n, replace=False))] for n in (1, 5, 20, 33, 60, 7, 20, 41)]
    sets, merged = Sets([r.tobytes() for r in raw], order), []
    i, j = np.triu_indices(len(raw), 1)

    class Sorted(np.ndarray):
        def sort(self, *args, **named):
            merged.append(named.get("kind"))
            assert (np.diff(np.asarray(self)) < 0).sum() <= 1  # two runs
            np.asarray(self).sort(*args, **named)

    concatenate = np.concatenate
    monkeypatch.setattr(np, "concatenate", lambda parts, *args: concatenate(parts, *args).view(Sorted))
    shared, first, second = (np.asarray(x) for x in sets.common(i, j))
    monkeypatch.undo()
    assert merged == ["stable"]
    for a, b, n, x, y in zip(i, j, shared, first, second, strict=True):
        both = [t for t in raw[a].tolist() if t in set(raw[b].tolist())]
        assert n == len(both) and (n < 1 or x == both[0]) and (n < 2 or y == both[1])
