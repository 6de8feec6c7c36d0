"""Operator 9: line dedup by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm.textops import U64, SpanHasher, arrow_bytes, fresh_name, lower_ascii, mix64, runs, slices, text_id, trimmed
from sonolith.session import stash, table

SIMILARITY = 0.8
#: Tokens are ordered by the counts of 2**BUCKET_BITS hash buckets, on a scale of LEVELS steps an octave: any order gives
#: the same links, a rare-first one gives few candidates.
BUCKET_BITS = 24
LEVELS = 8
SEGMENTS = 256
#: A prefix token in more lines than this is a key only together with the next common token.
HOT = 1024
#: Members of a group that are compared in one task: beyond, the group is cut into parts, and each two of them are one.
TILE = 2048
#: Bytes of text that are tokenised at once: their sums, of eight bytes each, stay in the cache.
SLICE = 1 << 17
#: Prefix rows of a batch that is sorted and compared at once.
BATCH_ROWS = 1 << 17
#: Prefix rows that a worker holds before it deals them out.
HELD_ROWS = 1 << 19
#: Bits of the map of lines whose tokens are fetched; where it is full, more lines are read than needed, none is lost.
MAP_BITS = 26
#: Sets of more tokens than this have the wider signature.
MANY = 200
#: A class of more than 1/COMMON of all lines is joined by broadcast: there are fewer than COMMON of them.
COMMON = 1000
#: Pairs whose common tokens are found at once, members that are verified at once (whole groups), and members of a group
#: of which all pairs of fitting length are verified; larger groups go by products of tiles.
PAIRS, MEMBERS, FEW = 1 << 13, 1 << 13, 32
#: Stands for a doc_id that is null: it comes last.
LAST = (1 << 63) - 1
_CLASS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + size), one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Order:
    """The global order of tokens, by the levels of their buckets, then their hash."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels

    def level(self, h: np.ndarray) -> np.ndarray:
        return self.levels[(h >> U64(64 - BUCKET_BITS)).astype(np.int64)]

    def count(self, h: np.ndarray) -> np.ndarray:
        """About the lines that have the token, from above."""
        return np.exp2(self.level(h) / LEVELS)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.ceil(LEVELS * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


class Lines:
    """Token sets of the lines of a slice of texts."""

    def __init__(self) -> None:
        self.hash = SpanHasher()

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, number, start and end of each line. Lines end at a line feed; a text's last line is a line, also if it
        is empty; an empty text has none."""
        full = np.diff(offsets) > 0
        finals = offsets[1:][full]
        ends = np.concatenate([finals, np.flatnonzero(data == 10)])  # a text's end goes before a line feed that follows
        place = np.argsort(ends, kind="stable")
        ends, final = ends[place], place < len(finals)
        row = np.where(final, np.cumsum(final) - 1, np.cumsum(final))  # of the texts that are not empty
        row = np.flatnonzero(full)[row]
        starts = np.empty_like(ends)
        if len(ends):
            starts[0] = offsets[row[0]]
            starts[1:] = np.where(final[:-1], offsets[row[1:]], ends[:-1] + 1)
        number = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        return row, number, starts, ends

    def coded(self, low: np.ndarray, begins: np.ndarray, stops: np.ndarray, order: Order | None) -> tuple[np.ndarray, ...]:
        """Of lines [begin, stop) of lower-cased bytes, one after the other with at most a line feed between: the index of
        each that has words, where its tokens start and end, and the tokens: each once, as places in the names (hashes)
        that come last, in the order; in any where there is none."""
        edges = begins[begins < len(low)]
        inner = (low != 32) & (low - np.uint8(9) > 4)  # white space: 0x20 and 0x09-0x0D
        first, last = runs(inner, np.append(edges, len(low)))
        low_at, size = np.searchsorted(first, begins), np.searchsorted(first, stops)
        size = size - low_at
        line, inside = np.repeat(np.arange(len(begins)), size), ranges(low_at, size)
        first, last = first[inside], last[inside]
        coded = pa.array(self.hash(low, first, last)).dictionary_encode()
        names, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        if order is not None:
            place = np.argsort(names)
            place = place[np.argsort(order.level(names[place]), kind="stable")]
            rank = np.empty(len(names), np.int32)
            rank[place] = np.arange(len(names))
            names, code = names[place], rank[code]
        both = (line << 32) | code
        both.sort()
        keep = np.ones(len(both), bool)
        keep[1:] = both[1:] != both[:-1]
        both = both[keep]
        line, code = both >> 32, both & 0xFFFFFFFF
        cut = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
        return line[cut], cut, np.append(cut[1:], len(line)) if len(cut) else cut, code, names

    def sets(self, low: np.ndarray, begins: np.ndarray, stops: np.ndarray, order: Order | None) -> tuple[np.ndarray, ...]:
        """As coded(), with the tokens' hashes."""
        own, cut, end, code, names = self.coded(low, begins, stops, order)
        return own, cut, end, names[code]


def class_ids(token: np.ndarray, cut: np.ndarray, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever the order of its tokens, as two longs; with a code, tokens are places in `token`."""
    if not len(cut):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (mix64(token ^ c) for c in _CLASS)
    out = [mix64(np.add.reduceat(m if code is None else m[code], cut)).view(np.int64) for m in mixed]
    return out[0], out[1]


def needed(n: np.ndarray, similarity: float) -> np.ndarray:
    """Least overlap of a set of n with one that is similar enough."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def overlap_needed(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).astype(np.int64)


def suffix_signatures(token: np.ndarray, end: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """256 bits, as four words, of the tokens [at, end) of a line with n tokens: for up to MANY the parities of the
    tokens in 128 classes, else their counts in 64 classes modulo 16. Either changes by one step for each token that is
    added or taken away."""
    out = np.zeros((4, len(at)), U64)
    if not len(at):
        return out
    both = U64(1) << (token & U64(63))
    odd = both * ((token >> U64(6)) & U64(1))
    run = np.zeros(len(token) + 1, U64)
    for w, bit in enumerate((both ^ odd, odd)):
        np.bitwise_xor.accumulate(bit, out=run[1:])
        out[w] = run[end] ^ run[at]
    wide = np.flatnonzero(n > MANY)
    if len(wide):
        lines, own = np.unique(end[wide], return_inverse=True)  # the long lines, by their end
        size = n[wide][np.unique(own, return_index=True)[1]]
        base = np.cumsum(size) - size
        kind = token[ranges(lines - size, size)] & U64(63)
        a, z = at[wide] - (lines - size)[own] + base[own], (base + size)[own]
        out[:, wide] = 0
        most = np.bincount(np.repeat(np.arange(len(size)) * 64, size) + kind.astype(np.int64)).max()
        for w in range(8 if most < 256 else 0):  # eight counts of eight bits at once
            run = np.append(U64(0), np.cumsum(np.where(kind >> U64(3) == U64(w), U64(1) << (kind & U64(7)) * U64(8), U64(0))))
            x = (run[z] - run[a]) & U64(0x0F0F0F0F0F0F0F0F)
            for shift, mask in ((4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
                x = (x | x >> U64(shift)) & U64(mask)
            out[w // 2, wide] |= x << U64(32 * (w % 2))
        for c in range(64 if most >= 256 else 0):
            run = np.append(0, np.cumsum(kind == U64(c)))
            out[c // 16, wide] |= ((run[z] - run[a]) & 15).astype(U64) << U64(4 * (c % 16))
    return out


def least_difference(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Lower bound on the tokens that only one of two sets has, from their signatures; n, m: tokens of their lines."""
    out = np.zeros(len(n), np.int64)
    few, many = np.flatnonzero((n <= MANY) & (m <= MANY)), np.flatnonzero((n > MANY) & (m > MANY))
    out[few] = np.bitwise_count(x[0, few] ^ y[0, few]).astype(np.int64) + np.bitwise_count(x[1, few] ^ y[1, few])
    for w in range(4) if len(many) else ():
        for c in range(16):
            d = ((x[w, many] >> U64(4 * c)) - (y[w, many] >> U64(4 * c))) & U64(15)
            out[many] += np.minimum(d, U64(16) - d).astype(np.int64)
    return out


def single_key(token: np.ndarray) -> np.ndarray:
    return mix64(token + U64(1))


def pair_key(token: np.ndarray, other: np.ndarray) -> np.ndarray:
    return mix64(mix64(token + U64(2)) + other)


def tile_key(key: np.ndarray, split: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Key of the parts p and q of a group that is cut into `split` parts; of the group itself where it is not cut."""
    tile = np.minimum(p, q) * split + np.maximum(p, q)
    return np.where(split > 1, mix64(key + (tile + 1).astype(U64)), key)


def part_of(node: np.ndarray, split: np.ndarray) -> np.ndarray:
    return (mix64(node.view(U64)) % split.astype(U64)).astype(np.int64)


class Keys:
    """The groups in which lines meet."""

    def __init__(self, order: Order, similarity: float, hot: int, tile: int):
        self.order, self.similarity, self.hot, self.tile = order, similarity, hot, tile

    def split(self, count: np.ndarray) -> np.ndarray:
        return np.maximum(1, np.ceil(count / self.tile)).astype(np.int64)

    def rows(self, token: np.ndarray, cut: np.ndarray, end: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
        """group, node, n, pos, signature: one row for each key of each line and, in a group that is cut, each other
        part."""
        n = end - cut
        size = n - needed(n, self.similarity) + 1
        line = np.repeat(np.arange(len(cut)), size)
        at = ranges(cut, size)
        count = self.order.count(token[at])
        hot = count > self.hot
        # a pair that has at least two tokens in common has them in prefixes that are one token longer
        beyond = (cut + size)[line[hot]] - at[hot]
        first, second = np.repeat(at[hot], beyond), ranges(at[hot] + 1, beyond)
        key = np.concatenate([single_key(token[at[~hot]]), pair_key(token[first], token[second])])
        split = self.split(np.concatenate([count[~hot], np.minimum(np.repeat(count[hot], beyond), self.order.count(token[second]))]))
        line = np.concatenate([line[~hot], np.repeat(line[hot], beyond)])
        at, pos = np.concatenate([at[~hot], second]), np.concatenate([at[~hot], second - 1]) - cut[line]
        bits = suffix_signatures(token, end[line], at, n[line])
        if (split > 1).any():
            own = part_of(node[line], split)
            other = ranges(np.zeros(len(split), np.int64), split)
            again = np.repeat(np.arange(len(line)), split)
            key, line, pos, bits = tile_key(key[again], split[again], own[again], other), line[again], pos[again], bits[:, again]
        return key, node[line], n[line], pos, bits

    def of_pair(self, first: np.ndarray, second: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The one group in which a pair counts, from its first two common tokens and the lines' nodes."""
        count = self.order.count(first)
        hot = count > self.hot
        key = np.where(hot, pair_key(first, second), single_key(first))
        split = self.split(np.where(hot, np.minimum(count, self.order.count(second)), count))
        return tile_key(key, split, part_of(u, split), part_of(v, split))


COLUMNS = (("key", U64), ("node", np.int64), ("n", np.uint32), ("pos", np.uint32), ("s0", U64), ("s1", U64), ("s2", U64), ("s3", U64))


def _packed(packer: zstandard.ZstdCompressor, columns: list[np.ndarray]) -> bytes:
    return packer.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpacked(raw: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n, out, at = len(data) // sum(np.dtype(k).itemsize for _, k in COLUMNS), [], 0
    for _, kind in COLUMNS:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _lines_and_counts(docs: DataFrame, similarity: float) -> DataFrame:
    """Rows (doc_id, text_id, line, h, h2, n) of the lines - h, h2 null for a line without words, line -1 for a text
    without lines -, and rows with `counts`: the lines of each token bucket in a scan
    partition, in segments (line; n of the first: prefix rows)."""
    lines = Lines()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(1 << BUCKET_BITS, np.uint32), 0
        names = ["doc_id", "text_id", "line", "h", "h2", "n", "counts"]
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(2)
            data, offsets = arrow_bytes(batch.column(1))
            none = pa.array(np.flatnonzero(np.diff(offsets) == 0))
            if len(none):
                null = pa.nulls(len(none), pa.int64())
                zero = pa.array(np.zeros(len(none), np.int64))
                yield pa.RecordBatch.from_arrays([ids.take(none), texts.take(none), pa.array(np.full(len(none), -1)), null, null, zero, pa.nulls(len(none), pa.binary())], names=names)
            for i, j in slices(offsets, SLICE):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                row, number, begins, stops = lines.spans(part, off)
                own, cut, end, code, token = lines.coded(lower_ascii(part), begins, stops, None)
                h, h2, n = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
                (h[own], h2[own]), n[own] = class_ids(token, cut, code), end - cut
                _, first = np.unique(h[own], return_index=True)  # equal lines of a slice count once
                size = (end - cut)[first]
                rows += int((size - needed(size, similarity) + 1).sum())
                times = np.bincount(code[ranges(cut[first], size)], minlength=len(token))
                np.add.at(counts, (token >> U64(64 - BUCKET_BITS)).astype(np.int64), times.astype(np.uint32))
                at = pa.array(i + row)
                blank = n == 0
                yield pa.RecordBatch.from_arrays([ids.take(at), texts.take(at), pa.array(number), pa.array(h, mask=blank), pa.array(h2, mask=blank), pa.array(n), pa.nulls(len(row), pa.binary())], names=names)
        packer = zstandard.ZstdCompressor(level=1)
        null, total = pa.nulls(SEGMENTS, pa.int64()), np.zeros(SEGMENTS, np.int64)
        total[0] = rows
        packed = [packer.compress(part.tobytes()) for part in counts.reshape(SEGMENTS, -1)]
        yield pa.RecordBatch.from_arrays([null, null, pa.array(np.arange(SEGMENTS)), null, null, pa.array(total), pa.array(packed, pa.binary())], names=names)

    return docs.select("doc_id", "text", text_id().alias("t")).mapInArrow(trimmed(run), "doc_id long, text_id long, line long, h long, h2 long, n long, counts binary")


def _order(parts: DataFrame) -> tuple[Order, int]:
    """The order by the sums of the partitions' counts (line: segment, n, counts), and the prefix rows. A task adds up
    the counts of one segment at a time."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, rows, unpacker = None, None, 0, zstandard.ZstdDecompressor()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([rows]), pa.array([levels_of(total).tobytes()], pa.binary())], names=["line", "n", "counts"])

        for batch in batches:
            for k, n, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if k != at:
                    if at is not None:
                        yield done()
                    at, total, rows = k, np.zeros((1 << BUCKET_BITS) // SEGMENTS, np.int64), 0
                total += np.frombuffer(unpacker.decompress(raw), np.uint32)
                rows += n
        if at is not None:
            yield done()

    out, rows = np.zeros((SEGMENTS, (1 << BUCKET_BITS) // SEGMENTS), np.uint8), 0
    for r in parts.repartition("line").sortWithinPartitions("line").mapInArrow(trimmed(merge), "line long, n long, counts binary").toLocalIterator():
        out[r["line"]] = np.frombuffer(r["counts"], np.uint8)
        rows += r["n"]
    return Order(out.reshape(-1)), rows


def _prefixes(docs: DataFrame, keys: Keys, batches_: int) -> DataFrame:
    """batch, rows: the prefix rows (COLUMNS) of the lines, once a slice, dealt by group to batches_ batches and packed.

    Lines of up to 3 tokens (1 below a similarity of 0.75) are similar to none but their equals."""
    lines, reach = Lines(), 3 if keys.similarity > 0.75 else 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, size = zstandard.ZstdCompressor(level=1), [], 0

        def deal() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            to = (columns[0] % U64(batches_)).astype(np.int64)
            # by batch, key and node, as far as 64 bits show them: a row that stays twice is found where batches meet
            top, rest = U64(64 - batches_.bit_length()), U64(max(0, 32 - batches_.bit_length()))
            place = np.argsort((to.astype(U64) << top) | ((columns[0] >> U64(32)) << rest) | (columns[1].view(U64) >> (U64(64) - rest) if rest else U64(0)))
            key, node = columns[0][place], columns[1][place]
            place = place[np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))]  # once a line
            to, columns = to[place], [c[place] for c in columns]
            cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            packed = [_packed(packer, [c[a:z] for c in columns]) for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(to)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(to[cut]), pa.array(packed, pa.binary())], names=["batch", "rows"])

        for batch in batches:
            data, offsets = arrow_bytes(batch.column(0))
            for i, j in slices(offsets, SLICE):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                _, _, begins, stops = lines.spans(part, off)
                _, cut, end, code, names = lines.coded(lower_ascii(part), begins, stops, keys.order)
                node, _ = class_ids(names, cut, code)
                _, once = np.unique(node, return_index=True)
                once = once[(end - cut)[once] > reach]
                if not len(once):
                    continue
                key, node, n, pos, bits = keys.rows(names[code], cut[once], end[once], node[once])
                held.append((key, node, n.astype(np.uint32), pos.astype(np.uint32), *bits))
                size += len(key)
                if size >= HELD_ROWS:
                    yield deal()
                    held, size = [], 0
        if size:
            yield deal()

    return docs.select("text").mapInArrow(trimmed(run), "batch long, rows binary")


def _live(dealt: DataFrame, similarity: float) -> DataFrame:
    """key, node of the members of groups that some other of their group passes the filters with.

    Length: the smaller set has at least `similarity` of the larger. Position and signature: what two lines have in
    common, if this group's tokens are the first of it, are these and what the rest of both shares, at most half of what
    the rests hold less the tokens that only one of them has. A group is sorted by length, so each member meets only
    those of fitting length."""

    def compared(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, node, n, pos, *bits = (np.concatenate(c) for c in zip(*parts, strict=True))
        # by key, size and node, as far as 64 bits show them
        _, rank = np.unique(key, return_inverse=True)
        a, b = len(key).bit_length(), int(n.max()).bit_length()
        place = np.argsort((rank.astype(U64) << U64(64 - a)) | (n.astype(U64) << U64(64 - a - b)) | (node.view(U64) >> U64(a + b)))
        key, node, n, pos, bits = key[place], node[place], n[place].astype(np.int64), pos[place].astype(np.int64), np.stack(bits)[:, place]
        first = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))  # other slices' rows of a line
        key, node, n, pos, bits = key[first], node[first], n[first], pos[first], bits[:, first]
        keep, i, d = np.zeros(len(key), bool), np.arange(len(key)), 0
        while len(i):
            d += 1
            i = i[i + d < len(key)]
            j = i + d
            go = (key[i] == key[j]) & (n[i] >= needed(n[j], similarity))
            i, j = i[go], j[go]
            least = overlap_needed(n[i], n[j], similarity)
            some = np.flatnonzero(np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least)
            p, q = i[some], j[some]
            good = (n[p] - pos[p] + n[q] - pos[q] - least_difference(bits[:, p], bits[:, q], n[p], n[q])) // 2 >= least[some]
            keep[p[good]] = keep[q[good]] = True
        key, node = key[keep], node[keep]
        place = np.lexsort((node, key))
        key, node = key[place], node[place]
        once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
        return pa.RecordBatch.from_arrays([pa.array(key[once].view(np.int64)), pa.array(node[once])], names=["key", "node"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != at and held:
                    yield compared(held)
                    held = []
                at = k
                held.append(_unpacked(raw.as_buffer()))
        if held:
            yield compared(held)

    return dealt.repartition("batch").sortWithinPartitions("batch").mapInArrow(trimmed(run), "key long, node long")


def _bits(doc: np.ndarray, text: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The bit of a line in the map of _marked()."""
    return ((text.view(U64) >> U64(64 - MAP_BITS)).astype(np.int64) ^ line ^ doc) & ((1 << MAP_BITS) - 1)


def _marked(places: DataFrame) -> np.ndarray:
    """A map, 8 bits a byte, of lines (doc, text_id, line): made by the executors, in parts of 4 KB."""
    k = F.shiftrightunsigned("text_id", 64 - MAP_BITS).bitwiseXOR(F.col("line")).bitwiseXOR(F.col("doc")).bitwiseAND(F.lit((1 << MAP_BITS) - 1)) + 1
    parts = places.groupBy(F.bitmap_bucket_number(k).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits"))
    out = np.zeros((1 << MAP_BITS) // 32768 * 4096, np.uint8)
    for r in parts.toLocalIterator():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _token_sets(docs: DataFrame, order: Order, marked: np.ndarray) -> DataFrame:
    """node, node2, tokens, in order, of the lines that are marked, by their text and number. Other lines' words are not
    looked at."""
    lines = Lines()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            doc, text = np.asarray(batch.column(0).cast(pa.int64()).fill_null(LAST)), np.asarray(batch.column(2))
            for i, j in slices(offsets, SLICE):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                row, number, begins, stops = lines.spans(part, off)
                k = _bits(doc[i + row], text[i + row], number)
                once = np.flatnonzero((marked[k >> 3] >> (k & 7).astype(np.uint8)) & 1)
                if not len(once):
                    continue
                size = stops[once] - begins[once]
                own = lower_ascii(part[ranges(begins[once], size)])
                a = np.cumsum(size) - size
                _, cut, end, token = lines.sets(own, a, a + size, order)
                node, node2 = class_ids(token, cut)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node2), pa.array([token[a:z].tobytes() for a, z in zip(cut.tolist(), end.tolist(), strict=True)], pa.binary())], names=["node", "node2", "tokens"])

    return docs.select("doc_id", "text", text_id().alias("t")).mapInArrow(trimmed(run), "node long, node2 long, tokens binary").groupBy("node", "node2").agg(F.first("tokens").alias("tokens"))


class Sets:
    """Token sets of some members, their tokens coded by the order."""

    def __init__(self, raw: list[bytes], order: Order):
        coded = pa.array(np.frombuffer(b"".join(raw), U64)).dictionary_encode()
        names = coded.dictionary.to_numpy()
        place = np.argsort(names)
        place = place[np.argsort(order.level(names[place]), kind="stable")]
        rank = np.empty(len(names), np.int64)
        rank[place] = np.arange(len(names))
        self.names, self.token = names[place], rank[coded.indices.to_numpy()]
        self.sizes = np.array([len(x) // 8 for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.parity = np.zeros((4, len(raw)), U64)
        mixed = mix64(self.names)  # 256 classes of tokens: whether a set has an odd number of each
        word, bit = (mixed >> U64(6)) & U64(3), U64(1) << (mixed & U64(63))
        some = np.flatnonzero(self.sizes)
        for w in range(4 if len(some) else 0):
            self.parity[w, some] = np.bitwise_xor.reduceat(np.where(word == U64(w), bit, U64(0))[self.token], self.starts[some])

    def near(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Marks of the pairs that may be similar enough: a class of tokens whose parity differs has a token that only one
        of the two sets has."""
        differ = sum(np.bitwise_count(p[i] ^ p[j]).astype(np.int64) for p in self.parity)
        return differ <= self.sizes[i] + self.sizes[j] - 2 * overlap_needed(self.sizes[i], self.sizes[j], similarity)

    def common(self, i: np.ndarray, j: np.ndarray, similarity: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many tokens each pair has in common, and the first two of them (anything where there are fewer); with a
        similarity, in prefixes that hold the first two of any pair that is similar enough and has two."""
        pair = np.arange(len(i))
        sizes = self.sizes if similarity is None else np.minimum(self.sizes, self.sizes - needed(self.sizes, similarity) + 2)
        own = np.concatenate([(np.repeat(pair, sizes[x]) << 32) | self.token[ranges(self.starts[x], sizes[x])] for x in (i, j)])
        own.sort(kind="stable")  # tokens of a set are in order, so these are two runs to merge
        both = np.append(own[:-1][own[1:] == own[:-1]], 0)
        head = np.searchsorted(both[:-1], pair << 32)
        code = both & 0xFFFFFFFF
        return np.diff(np.append(head, len(both) - 1)), self.names[code[head]], self.names[code[np.minimum(head + 1, len(both) - 1)]]

    def candidates(self, a: int, z: int, similarity: float, strip: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the members [a, z) that are similar enough, by products of bounded tiles."""
        names, column = np.unique(self.token[self.starts[a] : self.starts[z - 1] + self.sizes[z - 1]], return_inverse=True)
        sizes = self.sizes[a:z]
        owner = np.repeat(np.arange(z - a), sizes)
        for k in range(0, z - a, strip):
            top = min(k + strip, z - a)
            shared = np.zeros((top - k, z - a - k), np.float32)
            for c in range(0, len(names), 2048):
                on = (column >= c) & (column < c + 2048) & (owner >= k)
                m = np.zeros((z - a - k, min(2048, len(names) - c)), np.float32)
                m[owner[on] - k, column[on] - c] = 1
                shared += m[: top - k] @ m.T
            i, j = np.nonzero(shared >= overlap_needed(sizes[k:top, None], sizes[None, k:], similarity))
            yield i[i < j] + k + a, j[i < j] + k + a


def _verified(rows: DataFrame, keys: Keys) -> DataFrame:
    """node, node2, links, later: for each line and group its links to other lines, and whether one of them comes first.
    A pair counts in the group of its first common tokens only."""
    names = ["key", "node", "node2", "doc", "text_id", "line", "tokens"]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        sets = Sets(t.column("tokens").to_pylist(), keys.order)
        key, node, node2, doc, text, line = (np.asarray(t.column(c), dtype=np.int64) for c in names[:6])
        links, later = np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        place = np.empty(len(node), np.int64)
        place[np.lexsort((line, text, doc))] = np.arange(len(node))

        def count(i: np.ndarray, j: np.ndarray) -> None:
            for k in range(0, len(i), PAIRS):
                p, q = i[k : k + PAIRS], j[k : k + PAIRS]
                # what is cheap comes first: the signatures, then whether the pair counts here, then the whole sets
                own = sets.near(p, q, keys.similarity)
                p, q = p[own], q[own]
                shared, first, second = sets.common(p, q, keys.similarity)
                own = shared > 0
                own[own] = keys.of_pair(first[own], second[own], node[p[own]], node[q[own]]) == key[p[own]].view(U64)
                p, q = p[own], q[own]
                shared, _, _ = sets.common(p, q)
                own = shared >= np.maximum(1, overlap_needed(sets.sizes[p], sets.sizes[q], keys.similarity))
                p, q = p[own], q[own]
                nonlocal links
                links += np.bincount(p, minlength=len(node)) + np.bincount(q, minlength=len(node))
                later[np.where(place[p] > place[q], p, q)] = True

        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        large = np.repeat(size > FEW, size)
        i, d = np.flatnonzero(~large), 0
        while len(i):
            d += 1
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
            low, high = np.minimum(sets.sizes[i], sets.sizes[i + d]), np.maximum(sets.sizes[i], sets.sizes[i + d])
            fit = i[low >= needed(high, keys.similarity)]
            count(fit, fit + d)
        for a, z in zip(cut[size > FEW].tolist(), (cut + size)[size > FEW].tolist(), strict=True):
            for i, j in sets.candidates(a, z, keys.similarity):
                count(i, j)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node2[some]), pa.array(links[some]), pa.array(later[some])], names=["node", "node2", "links", "later"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            batch = batch.select(names)
            key = np.asarray(batch.column(0), dtype=np.int64)
            cut = np.flatnonzero(np.append(False, key[1:] != key[:-1])).tolist() if len(key) else []
            if held and len(key) and np.asarray(held[-1].column(0), dtype=np.int64)[-1] != key[0]:
                cut = [0, *cut]
            a = 0
            for z in [c for k, c in enumerate(cut) if size + c - a >= MEMBERS or k == len(cut) - 1]:
                if z > a:
                    held.append(batch.slice(a, z - a))
                    size += z - a
                if size >= MEMBERS:
                    yield block(held)
                    held, size = [], 0
                a = z
            if a < len(key):
                held.append(batch.slice(a))
                size += len(key) - a
        if held:
            yield block(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(run), "node long, node2 long, links long, later boolean")


def line_decisions(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE, hot: int = HOT, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """doc_id, text_id, line, n (its tokens), removed, links of each line of docs (doc_id, text); line -1 stands for a
    text without lines (null or empty).

    A line's tokens are the set of its lower-case words. Lines with equal sets are one class; classes with a Jaccard
    index of at least `similarity` (over 0.5) are linked. A line is removed if a line of its class or of a linked class
    comes before it, by doc_id (null last), text_id (the text's hash), then line number; links counts the other classes
    that are linked. Lines without words stay. Rows that agree in doc_id and text are the same lines, and each gives its
    rows; texts of one doc_id, or without one, are decided each on its own. Other columns are not read; an empty table
    gives no rows.

    Classes meet in the groups of the tokens of their prefixes, rare tokens first. A token that many lines have is a key
    only with the next token of a prefix that is one longer; groups that may still be large are cut into parts. Length,
    position and signature filters leave few members; for these the token sets are fetched and links verified. Each step
    emits at most one row a member and group.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("the similarity has to be above 0.5")
    both = stash(_lines_and_counts(docs, similarity), "lines")
    order, rows = _order(both.where("counts IS NOT NULL").select("line", "n", "counts"))
    keys = Keys(order, similarity, hot, tile)
    last = F.lit(LAST)
    lines = both.where("counts IS NULL").select("doc_id", "text_id", "line", "h", "h2", "n")
    place = F.struct(F.coalesce("doc_id", last).alias("doc"), "text_id", "line")
    first = lines.where("h IS NOT NULL").groupBy("h", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    first = stash(first.select("h", "h2", "first.*", "times"), "classes")
    live = stash(_live(_prefixes(docs, keys, max(1, -(-rows // batch_rows))), similarity), "live")
    wanted = first.join(live.select(F.col("node").alias("h")).distinct(), "h", "left_semi")
    sets = _token_sets(docs, order, _marked(wanted))
    placed = wanted.select(F.col("h").alias("node"), F.col("h2").alias("node2"), "doc", "text_id", "line")
    members = live.join(placed, "node").join(sets, ["node", "node2"]).select("key", "node", "node2", "doc", "text_id", "line", "tokens")
    found = _verified(members, keys).groupBy("node", "node2").agg(F.sum("links").alias("links"), F.max("later").alias("later"))
    found = stash(found.select(F.col("node").alias("h"), F.col("node2").alias("h2"), "links", "later"), "line-links")
    classes = first.join(found, ["h", "h2"], "left").where("times > 1 OR links > 0").withColumnsRenamed({"text_id": "own_text", "line": "own_line"})
    common = F.broadcast(classes.where(F.col("times") * COMMON > both.count()))
    worded = lines.where("h IS NOT NULL")
    often = worded.join(common, ["h", "h2"])
    seldom = worded.join(common.select("h", "h2"), ["h", "h2"], "left_anti").join(classes, ["h", "h2"], "left")
    blank = lines.where("h IS NULL")
    again = (F.coalesce("doc_id", last) != F.col("doc")) | (F.col("text_id") != F.col("own_text")) | (F.col("line") != F.col("own_line"))
    decided = often.unionByName(seldom).unionByName(blank, allowMissingColumns=True)
    return decided.select("doc_id", "text_id", "line", "n", F.coalesce(again | F.coalesce("later", F.lit(False)), F.lit(False)).alias("removed"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def by_document(decisions: DataFrame) -> DataFrame:
    """doc_id, text_id, n_lines, n_removed, n_links, removed_lines (ascending): one row for rows of one doc_id and text."""
    gone = F.collect_set(F.when(F.col("removed"), F.col("line")))
    rows = decisions.groupBy("doc_id", "text_id").agg((F.max("line") + 1).alias("n_lines"), F.sum("links").alias("links"), F.count_if(F.col("line") <= 0).alias("rows"), F.array_sort(gone).alias("removed_lines"))
    return rows.select("doc_id", "text_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.expr("links div rows").alias("n_links"), "removed_lines")


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the removed lines taken out of text; all columns and rows stay. Null text stays null. Repeated rows lose
    the same lines."""
    id_, text, gone = (fresh_name(docs, c) for c in ("id", "text", "gone"))
    lost = by_document(line_decisions(docs, similarity)).where("n_removed > 0").select(F.col("doc_id").alias(id_), F.col("text_id").alias(text), F.col("removed_lines").alias(gone))
    joined = docs.join(lost, F.col("doc_id").eqNullSafe(F.col(id_)) & (text_id() == F.col(text)), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i.cast("long"))), "\n")
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of documents decided: one row a document, as by_document; cases as in line_decisions."""
    return by_document(line_decisions(table(spark, sf_dir, "documents"))).drop("text_id")


OP9_SQL = r"""WITH d AS MATERIALIZED (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, text, unnest(CASE WHEN text = '' THEN [''] ELSE string_split(text, chr(10)) END) AS said,
    unnest(CASE WHEN text = '' THEN [-1] ELSE range(len(string_split(text, chr(10)))) END) AS line FROM d),
lines AS MATERIALIZED (SELECT doc_id, text, line, list_sort(list_distinct(regexp_extract_all(translate(said, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS words FROM raw),
placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, text, line) AS place FROM lines),
classes AS MATERIALIZED (SELECT row_number() OVER () AS c, words, len(words) AS n, min(place) AS first FROM placed WHERE len(words) > 0 GROUP BY words),
tokens AS MATERIALIZED (SELECT c, n, unnest(words) AS w FROM classes),
counts AS (SELECT w, count(*) AS f FROM tokens GROUP BY w),
ranked AS (SELECT c, n, t.w, row_number() OVER (PARTITION BY c ORDER BY f, t.w) AS k FROM tokens t JOIN counts ON t.w = counts.w),
prefixes AS MATERIALIZED (SELECT c, n, w FROM ranked WHERE k <= n - (4 * n + 4) // 5 + 1),
pairs AS MATERIALIZED (SELECT DISTINCT a.c AS a, b.c AS b FROM prefixes a JOIN prefixes b ON a.w = b.w AND a.c < b.c AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
met AS MATERIALIZED (SELECT a, b FROM pairs JOIN classes x ON x.c = a JOIN classes y ON y.c = b WHERE 9 * len(list_intersect(x.words, y.words)) >= 4 * (x.n + y.n)),
way AS (SELECT a, b FROM met UNION ALL SELECT b, a FROM met),
linked AS (SELECT a, count(*) AS links, min(first) AS before FROM way JOIN classes ON c = b GROUP BY a),
decided AS (SELECT p.doc_id, p.text, line, coalesce(links, 0) AS links, coalesce(least(first, coalesce(before, first)) < place, false) AS removed
  FROM placed p LEFT JOIN classes q ON p.words = q.words LEFT JOIN linked ON a = c)
SELECT doc_id, (max(line) + 1)::BIGINT AS n_lines, count(*) FILTER (removed) AS n_removed, sum(links)::BIGINT AS n_links,
  coalesce(list(line ORDER BY line) FILTER (removed), []) AS removed_lines FROM decided GROUP BY doc_id, text"""
