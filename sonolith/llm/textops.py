"""Vectorised text helpers shared by the corpus operators: Arrow buffers, words, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are handled at once in a worker; a longer document is handled alone.
SLICE_BYTES = 1 << 19
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def parts(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker turns few texts into Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows [i, j) with at most limit bytes each, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that space[byte] does not mark; no run crosses a row."""
    return runs(~space[data], offsets)


def runs(inner: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of marked places; no run crosses an offset."""
    n = len(inner)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inner.copy()
    begins[1:] &= ~inner[:-1] | edge[1:n]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:] | edge[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def white_space() -> np.ndarray:
    """Marks of the bytes 0x20 and 0x09-0x0D."""
    mark = np.zeros(256, bool)
    mark[[9, 10, 11, 12, 13, 32]] = True
    return mark


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    h ^= h >> U64(32)
    return h


#: Spans of more bytes than this have a hash of their own: a polynomial modulo 2**64 has built collisions from about
#: 1000 bytes on.
LONG_SPAN = 64


class SpanHasher:
    """64-bit hashes of byte spans, by prefix sums of a polynomial, of long spans by XXH64; equal spans have equal hashes.
    Not exact: the polynomial for all, for marks that need not tell all spans apart."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool = True) -> np.ndarray:
        n = len(data)
        if n >= len(self.up):
            size = max(n + 1, SLICE_BYTES + 1)
            self.up, self.down = (np.multiply.accumulate(np.concatenate(([U64(1)], np.full(size, r, U64)))) for r in (_R, _R_INV))
        sums = np.zeros(n + 1, U64)
        terms = data.astype(U64)
        terms += U64(1)
        terms *= self.up[:n]
        np.cumsum(terms, out=sums[1:])
        out = mix64((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(U64))
        for k in np.flatnonzero(ends - starts > LONG_SPAN).tolist() if exact else ():
            out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), int(ends[k] - starts[k]))
        return out


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that df has not, in any case."""
    name, taken = f"__{stem}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_id() -> Column:
    """Hash of a row's text, which tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def trimmed(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives free memory back: Spark keeps idle workers, several to an executor."""

    @wraps(run)
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    return whole
