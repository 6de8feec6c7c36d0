"""Near-duplicates at a Jaccard similarity of word shingles: sketches find candidates, exact counts decide.

A document's sketch is its LOWEST smallest shingle hashes and one bit for each of BINS bins of its hashes. Two documents
are candidates if they share one of the smallest hashes, their sizes allow the similarity, and their bits differ in few
bins. Candidates are linked only if the Jaccard index of their whole shingle sets reaches the similarity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.llm.components import components, meet
from sonolith.llm.simhash import TILE
from sonolith.llm.textops import U64, SpanHasher, arrow_bytes, fresh_name, lower_ascii, mix64, slices, text_id, trimmed, white_space, word_spans
from sonolith.session import stash

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity s has none of these in common with probability (1 - s)**LOWEST at most: 1e-14 at 0.8.
LOWEST = 20
BINS = 128
#: Probability that a pair at the similarity differs in more bins than are allowed.
LOSS = 1e-9
#: Members of a group that are compared with the others at once.
STRIP = 128
#: Members of a group whose whole sets are compared in one task.
SET_TILE = 1024
#: Bits of the map of candidates whose sets are fetched; where it is full, more are read than needed, none is lost.
MAP_BITS = 22


class Shingles:
    """Shingle sets of the rows of a slice of texts."""

    def __init__(self, width: int) -> None:
        self.width, self.hash, self.space = width, SpanHasher(), white_space()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, sorted by row and value, each once; where each row starts, with the end; the rows' node, a hash of
        the set (0 for none). Fewer words than the width: one shingle."""
        n = len(offsets) - 1
        low = lower_ascii(data)
        starts, ends = word_spans(low, offsets, self.space)
        words, row = self.hash(low, starts, ends), np.searchsorted(offsets, starts, side="right") - 1
        count = np.bincount(row, minlength=n)
        first = np.cumsum(count) - count
        hashes, rows = [], []
        for width in range(1, self.width + 1):
            m = len(words) - width + 1
            if m <= 0 or width < self.width and not (count == width).any():
                continue
            if width < self.width:
                at = first[count == width]
            else:
                at = np.flatnonzero(row[:m] == row[width - 1 :])
            h = words[at]
            for i in range(1, width):
                h = mix64(h) + words[at + i]
            hashes.append(mix64(h + U64(width)))
            rows.append(row[at])
        if not hashes:
            return np.zeros(0, U64), np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
        h, r = np.concatenate(hashes), np.concatenate(rows)
        place = np.lexsort((h, r))
        h, r = h[place], r[place]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[keep], r[keep]
        cut = np.searchsorted(r, np.arange(n + 1))
        node, some = np.zeros(n, U64), np.flatnonzero(np.diff(cut))
        node[some] = mix64(np.add.reduceat(mix64(h + U64(1)), cut[some]))
        return h, cut, node.view(np.int64)


def bins(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """BINS bits of each of n rows, from hashes sorted by row and value: one bit of the least hash in each bin. A
    shingle that is added or taken away changes one bin at most."""
    out = np.zeros(n * BINS, np.uint8)
    cell = row * BINS + (h & U64(BINS - 1)).astype(np.int64)
    out[cell[::-1]] = ((h >> U64(7)) & U64(1)).astype(np.uint8)[::-1]  # of several for a bin the first one stays
    return np.packbits(out.reshape(n, BINS), axis=1, bitorder="little")


def allowed(similarity: float) -> int:
    """Bins that a pair at the similarity may differ in; more have a probability of LOSS at most. Either set alone has
    the least hash of a bin with probability 1 - similarity, and half of those bits differ."""
    p, tail, k = (1 - similarity) / 2, 0.0, BINS
    while k and tail + comb(BINS, k) * p**k * (1 - p) ** (BINS - k) <= LOSS:
        tail += comb(BINS, k) * p**k * (1 - p) ** (BINS - k)
        k -= 1
    return k


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_id, node, n (shingles), sketch (bits, then the smallest hashes) of each row; null text counts as empty."""
    shingles = Shingles(shingle)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            data, offsets = arrow_bytes(batch.column(1))
            for i, j in slices(offsets):
                own = [ids.slice(i, j - i), batch.column(2).slice(i, j - i)]
                h, cut, node = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(cut)
                bits = bins(h, np.repeat(np.arange(j - i), n), j - i)
                low = [bits[k].tobytes() + h[cut[k] : min(cut[k] + LOWEST, cut[k + 1])].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(node), pa.array(n.astype(np.int32)), pa.array(low, pa.binary())], names=["doc_id", "text_id", "node", "n", "sketch"])

    return docs.select("doc_id", "text", text_id().alias("t")).mapInArrow(trimmed(run), "doc_id long, text_id long, node long, n int, sketch binary")


def shingle_sets(docs: DataFrame, shingle: int, wanted: np.ndarray) -> DataFrame:
    """node, tokens (its shingles' hashes) of the nodes that are marked in the map `wanted`."""
    shingles = Shingles(shingle)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(0))
            for i, j in slices(offsets):
                h, cut, node = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                _, once = np.unique(node, return_index=True)
                once = once[wanted[(node[once].view(U64) >> U64(64 - MAP_BITS)).astype(np.int64)]]
                yield pa.RecordBatch.from_arrays([pa.array(node[once]), pa.array([h[cut[k] : cut[k + 1]].tobytes() for k in once], pa.binary())], names=["node", "tokens"])

    return docs.select("text").mapInArrow(trimmed(run), "node long, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))


def runs(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray | list]]:
    """Columns of sorted batches, cut so that rows of one (key, tile) stay together."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch.select(names)])
        now = pa.concat_tables([held, now]) if held is not None else now
        if not now.num_rows:
            continue
        key, tile = (np.asarray(now.column(c), dtype=np.int64) for c in ("key", "tile"))
        same = (key == key[-1]) & (tile == tile[-1])
        start = 0 if same.all() else len(key) - int(np.argmin(same[::-1]))
        held = now.slice(start)
        if start:
            yield now.slice(0, start)
    if held is not None and held.num_rows:
        yield held


def groups_of(block: pa.Table) -> Iterator[tuple[int, int]]:
    """Ranges of rows of equal (key, tile) with at least two rows."""
    key, tile = (np.asarray(block.column(c), dtype=np.int64) for c in ("key", "tile"))
    cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(tile) != 0)) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(key))
    some = ends - starts > 1
    yield from zip(starts[some].tolist(), ends[some].tolist(), strict=True)


def tiled(rows: DataFrame, tile: int) -> DataFrame:
    """rows (key, node, ...) with tile; groups of over `tile` members are cut by hash of node into parts, and each pair
    of parts is a tile."""
    hot = rows.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / F.lit(tile)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, part) * F.col("parts") + F.greatest(j, part))
    return rows.join(hot, "key", "left").withColumn("tile", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others))).drop("parts")


def dealt(rows: DataFrame) -> DataFrame:
    """rows (key, tile, ...) with the groups together."""
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile")


def spanning(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member that is linked, with the first member of its component."""
    n = len(link)
    label = np.arange(n, dtype=np.int32)
    while True:
        low = np.concatenate([np.where(link[i : i + STRIP], label[None, :], np.int32(n)).min(axis=1) for i in range(0, n, STRIP)])
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """First member of the component of each set; two sets of that Jaccard index or more are linked."""
    sizes = np.array([len(s) for s in sets])
    cut = np.append(0, np.cumsum(sizes)[:-1])
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label = np.zeros(len(names), bool), np.full(len(sets), -1)
    for seed in range(len(sets)):
        if label[seed] >= 0:
            continue
        label[seed], queue = seed, [seed]
        while queue and (label < 0).any():
            k = queue.pop()
            own = column[cut[k] : cut[k] + sizes[k]]
            mark[own] = True
            shared = np.add.reduceat(mark[column], cut, dtype=np.int64)
            mark[own] = False
            new = np.flatnonzero((label < 0) & (shared >= similarity * (sizes[k] + sizes - shared) - 1e-9))
            label[new] = seed
            queue.extend(new.tolist())
    return label


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """doc_id, component_id of each row, by grouped_nodes."""
    return grouped_nodes(docs, shingle, similarity, tile).select("doc_id", "component_id")


def grouped_nodes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """doc_id, text_id (the text's hash), node (of its shingle set), root (of its component), component_id of each row:
    documents are linked if the Jaccard index of their sets of word shingles is `similarity` or more; component_id is the
    smallest doc_id reachable.

    Documents of equal sets are one node. Nodes are grouped by each of their smallest hashes, and candidates span
    components; only for nodes that have one, the whole set is fetched, once, and links are counted within the
    component. Both steps go by groups of bounded size and emit at most one row a member and group.

    Null or empty text: no shingles, one node. Fewer words than the shingle: one shingle. Repeated rows stay, one each;
    a null doc_id keeps its row. Other columns are not read; empty tables give no rows.
    """
    most = allowed(similarity)
    own = stash(sketches(docs, shingle), "wide")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))

    def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = BINS // 64
        for batch in batches:
            raw = batch.column(2).to_pylist()
            size = np.array([len(x) // 8 for x in raw], np.int64)
            words, first = np.frombuffer(b"".join(raw), np.int64), np.cumsum(size) - size
            keep = np.ones(len(words), bool)
            for k in range(head):
                keep[first + k] = False
            each = lambda x: pa.array(np.repeat(x, size - head))  # noqa: E731, B023
            node, n = (np.asarray(batch.column(k), dtype=np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(words[keep]), each(node), each(n.astype(np.int32)), each(words[first]), each(words[first + 1])], names=["key", "node", "n", "a", "b"])

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["key", "tile", "node", "n", "a", "b"]):
            node, n, a, b = (np.asarray(block.column(c), dtype=np.int64) for c in ("node", "n", "a", "b"))
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in groups_of(block):
                x, y, size = a[i:j].view(U64), b[i:j].view(U64), n[i:j].astype(np.int32)
                near = np.zeros((j - i, j - i), bool)
                for k in range(0, j - i, STRIP):
                    own = slice(k, k + STRIP)
                    apart = np.bitwise_count(x[own, None] ^ x[None, :])
                    apart += np.bitwise_count(y[own, None] ^ y[None, :])  # BINS at most, which fits a byte
                    # sets of n and m shingles differ in (n + m) (1 - s) / (1 + s) at most
                    near[own] = apart <= np.minimum(most, (size[own, None] + size[None, :]) * ((1 - similarity) / (1 + similarity)) + 1e-6)
                    near[own] &= np.minimum(size[own, None], size[None, :]) >= similarity * np.maximum(size[own, None], size[None, :]) - 1e-6
                u, v = spanning(near)
                us.append(node[i:j][u])
                vs.append(node[i:j][v])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["key", "tile", "node", "tokens"]):
            node = np.asarray(block.column("node"), dtype=np.int64)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in groups_of(block):
                label = linked([np.frombuffer(t, U64) for t in block.column("tokens").slice(a, b - a).to_pylist()], similarity)
                moved = np.flatnonzero(label != np.arange(b - a))
                us.append(node[a:b][moved])
                vs.append(node[a:b][label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    rows = nodes.select("node", "n", "sketch").mapInArrow(trimmed(tables), "key long, node long, n int, a long, b long")
    met = components(dealt(tiled(rows, tile)).mapInArrow(trimmed(candidates), "u long, v long"))
    wanted = np.zeros(1 << MAP_BITS, bool)
    marks = met.select(F.shiftrightunsigned("node", 64 - MAP_BITS).alias("k")).distinct().toArrow()
    wanted[marks.column(0).to_numpy()] = True
    whole = tiled(met.select(F.col("root").alias("key"), "node"), min(tile, SET_TILE)).join(shingle_sets(docs, shingle, wanted), "node")
    member = components(dealt(whole).mapInArrow(trimmed(verified), "u long, v long"))
    total = own.count()
    rooted = nodes.select("node", "least", "copies").join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = meet(rooted, lowest, "root", total).select("node", "root", "component_id", F.col("copies").alias("n"))
    return meet(own.select("doc_id", "text_id", "node"), of, "node", total).select("doc_id", "text_id", "node", "root", "component_id")


def without_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that are near copies of one with a smaller doc_id in their group. Where a doc_id is repeated,
    each of its texts is decided on its own, and one row stays for texts of one group, in each run the same. Rows with a
    null doc_id stay unless text and id are repeated. All columns stay, whatever their names.

    Texts are shuffled once, to meet the ids and hashes of those that stay."""
    found = grouped_nodes(docs, similarity=similarity)
    each = stash(found.groupBy("doc_id", "text_id").agg(F.first("node").alias("node"), F.first("root").alias("root"), F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "groups")
    # with several texts for a doc_id, the least node stands for those of one group
    least = each.where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min(F.struct("node", "text_id", "n")).alias("m"))
    stay = least.select("doc_id", "m.text_id", "m.n").unionByName(each.where("doc_id IS NULL").select("doc_id", "text_id", "n"))
    id_, text, rows = (fresh_name(docs, c) for c in ("id", "text", "rows"))
    stay = stay.select(F.col("doc_id").alias(id_), F.col("text_id").alias(text), F.col("n").alias(rows))
    met = docs.join(stay, docs["doc_id"].eqNullSafe(F.col(id_)) & (text_id() == F.col(text)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    ordered = not any(isinstance(f.dataType, T.MapType | T.VariantType) for f in docs.schema.fields)
    one = met.where(F.col(rows) > 1).groupBy(id_, text).agg((F.min if ordered else F.first)(whole).alias(rows))
    return met.where(F.col(rows) == 1).select(*docs.columns).unionAll(one.select(f"{rows}.*"))
