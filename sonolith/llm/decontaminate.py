"""Operator 7: benchmark decontamination by SimHash of item-sized windows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.llm.textops import U64, SpanHasher, arrow_bytes, lower_ascii, mix64, slices, trimmed, word_spans
from sonolith.session import discard, stash, table

SHINGLE = 5
SIMILARITY = 0.8
#: Differing fingerprint bits that are searched: at similarity 0.8 about 10 are expected, with a deviation of 3.
RADIUS = 20
BITS = 64
#: Bytes of item texts that are shipped at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 16 << 20

MATCH = "item_id long, start int, n_words int, similarity double"


def gap_table() -> np.ndarray:
    """Marks of the bytes between words: ASCII but letters and digits."""
    mark = np.ones(256, bool)
    for a, z in ((48, 58), (65, 91), (97, 123), (128, 256)):
        mark[a:z] = False
    return mark


def word_hashes(hasher: SpanHasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of the rows, and the row of each."""
    low = lower_ascii(data)
    starts, ends = word_spans(low, offsets, gap_table())
    return hasher(low, starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n]
    for i in range(1, k):
        h = mix64(h) + words[i : i + n]
    return mix64(h)


def simhashes(signs: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all windows of n consecutive shingles, from the shingles' sums of +1 and -1 by bit."""
    window = signs[n:] - signs[:-n]
    return np.packbits(window > 0, axis=1, bitorder="little").view(U64).reshape(-1)


def running_signs(shingles: np.ndarray) -> np.ndarray:
    """Cumulative +1 and -1 of each bit, with a row of zeros in front."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    out = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(bits * 2 - 1, axis=0, out=out[1:])
    return out


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater counts of the shingles of two texts."""
    both, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(inverse[: len(a)], minlength=len(both)), np.bincount(inverse[len(a) :], minlength=len(both))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class BlockIndex:
    """Fingerprints of items of one size by each of radius + 1 blocks of bits: two within radius share a block."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        parts = np.array_split(np.arange(BITS), radius + 1)
        self.masks = [U64(sum(1 << int(b) for b in p)) for p in parts]
        self.orders = [np.argsort(fps & m, kind="stable") for m in self.masks]
        self.keys = [(fps & m)[o] for m, o in zip(self.masks, self.orders, strict=True)]

    def near(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, item) within the radius."""
        found = []
        for mask, order, keys in zip(self.masks, self.orders, self.keys, strict=True):
            value = probes & mask
            low, high = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
            n = high - low
            probe = np.repeat(np.arange(len(probes)), n)
            item = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            close = np.bitwise_count(probes[probe] ^ self.fps[item]) <= self.radius
            found.append(probe[close] * len(self.fps) + item[close])
        pair = np.unique(np.concatenate(found))
        return pair // len(self.fps), pair % len(self.fps)


@dataclass
class Items:
    """Items of one shingle width: their shingles, by size an index of their fingerprints, and all their shingles."""

    width: int
    ids: list[int]
    shingles: list[np.ndarray]
    by_size: dict[int, tuple[np.ndarray, BlockIndex]]
    every: np.ndarray
    bloom: np.ndarray
    shortest: int


def index_items(texts: list[tuple[int, str]], radius: int) -> list[Items]:
    """Items with fewer words than the shingle are one shingle of their own width."""
    hasher, by_width = SpanHasher(), defaultdict(list)
    for item, text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        words, _ = word_hashes(hasher, raw, np.array([0, len(raw)]))
        if len(words):
            width = min(SHINGLE, len(words))
            by_width[width].append((item, shingle_hashes(words, width)))
    out = []
    for width, own in sorted(by_width.items()):
        sizes = defaultdict(list)
        for k, (_, s) in enumerate(own):
            sizes[len(s)].append(k)
        fps = lambda k, n: simhashes(running_signs(own[k][1]), n)[0]  # noqa: E731, B023
        by_size = {n: (np.array(ks), BlockIndex(np.array([fps(k, n) for k in ks], U64), radius)) for n, ks in sizes.items()}
        every = np.unique(np.concatenate([s for _, s in own]))
        bloom = np.zeros(1 << 20, bool)
        bloom[(every >> U64(44)).astype(np.int64)] = True
        out.append(Items(width, [i for i, _ in own], [s for _, s in own], by_size, every, bloom, min(sizes)))
    return out


def search_row(shingles: np.ndarray, hits: np.ndarray, items: Items, similarity: float) -> list[tuple[int, int, int, float]]:
    """Best window of each item (the whole text for a longer item) that is similar enough in one text. hits: positions of shingles that some item has."""
    best: dict[int, tuple[float, int, int]] = {}
    reach = max(items.by_size)
    cut = np.flatnonzero(np.diff(hits) > reach) + 1
    for group in np.split(hits, cut):
        first, last = max(0, int(group[0]) - reach + 1), min(len(shingles), int(group[-1]) + reach)
        part = shingles[first:last]
        signs = running_signs(part)
        mark = np.zeros(len(part) + 1, np.int64)
        mark[group - first + 1] = 1
        hit_sums = np.cumsum(mark)
        for n, (ks, index) in items.by_size.items():
            size = min(n, len(part))  # a part is shorter than an item only if it is the whole text, which is one window
            if size < similarity * n - 1e-9:
                continue
            # a window is worth a fingerprint if enough of its shingles are in some item: I / (size + n - I) >= similarity
            least = int(np.ceil((size + n) * similarity / (1 + similarity) - 1e-9))
            live = np.flatnonzero(hit_sums[size:] - hit_sums[:-size] >= least)
            if not len(live):
                continue
            probe, near = index.near(simhashes(signs, size)[live])
            for p, k in zip(live[probe].tolist(), ks[near].tolist(), strict=True):
                if k in best and best[k][0] == 1.0:
                    continue
                s = weighted_similarity(part[p : p + size], items.shingles[k])
                if s >= similarity and (k not in best or s > best[k][0]):
                    best[k] = (s, first + p, size)
    return sorted((items.ids[k], at, size + items.width - 1, s) for k, (s, at, size) in best.items())


def find_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES, name: str = "contamination") -> DataFrame:
    """docs with a column of that name: array of (item_id, start, n_words, similarity), for each item of benchmark (item_id,
    text) its best window in the text, if similar enough; start counts words.

    Words are runs of letters and digits in lower case, shingles are five words (an item of fewer words is one
    shingle), similarity is the weighted Jaccard index of the shingles' counts. At each position a window of each
    item's size is fingerprinted, and a text that is shorter than the item is one window, so n_words is the text's; the
    block index finds all items within the radius; each is verified. Windows that
    hold too few shingles of any item to reach the similarity are passed over, as they cannot match.

    Null or empty text has no match; items with null id, null text or no words are left out; of repeated items each
    matches. All columns of docs stay, but one of that name is replaced; repeated rows stay; an empty table gives
    no rows. Narrow: no shuffle of docs. Items are dealt by hash to blocks of about block_bytes of text; the driver and
    each worker hold one block at a time, and docs are written between two blocks.
    """
    texts = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes)
    out = docs.drop(name).withColumn(name, F.array().cast(f"array<struct<{MATCH}>>".replace(" ", ":").replace(",:", ",")))
    for k in range(parts):
        block = sorted((r["item_id"], r["text"]) for r in texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect())
        read, out = out, _search(out, index_items(block, radius), similarity, name)
        if k < parts - 1:
            out = stash(out, "searched")
            if k:
                discard(read)
    return out


def _search(docs: DataFrame, found: list[Items], similarity: float, name: str) -> DataFrame:
    hasher = SpanHasher()
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(name)
            data, offsets = arrow_bytes(batch.column(batch.schema.get_field_index("text")))
            got: dict[int, list] = defaultdict(list)
            for i, j in slices(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words, row = word_hashes(hasher, part, off)
                for items in found:
                    s = shingle_hashes(words, items.width)
                    if not len(s):
                        continue
                    whole = row[: len(s)] == row[items.width - 1 :]
                    hit = np.flatnonzero(whole & items.bloom[(s >> U64(44)).astype(np.int64)])
                    hit = hit[np.isin(s[hit], items.every)]
                    if not len(hit):
                        continue
                    for group in np.split(hit, np.flatnonzero(np.diff(row[hit])) + 1):
                        r = int(row[group[0]])
                        first, last = np.searchsorted(row, [r, r + 1])
                        own = s[first : last - items.width + 1]
                        got[i + r] += search_row(own, group - first, items, similarity)
            column = batch.column(at).to_pylist()
            for r, matches in got.items():
                column[r] = sorted([*column[r], *({"item_id": a, "start": b, "n_words": c, "similarity": d} for a, b, c, d in matches)], key=lambda m: (m["item_id"], m["start"]))
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(trimmed(run), T.StructType(docs.schema.fields))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's windows that match a benchmark item; cases as in find_matches()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("contamination").alias("m"))
    return found.select("doc_id", "m.item_id", F.col("m.start").alias("start_word"), "m.n_words", "m.similarity")
