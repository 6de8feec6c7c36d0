"""Operator 2: token ids as fixed-stride binary shards in a keyed training order."""

from __future__ import annotations

import hashlib
import json
from base64 import b64decode
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm.textops import U64, mix64, parts, trimmed
from sonolith.session import discard, fresh_path, qualified, stash, table

#: Where the vocabulary lies, and the id that ends a document and fills the last sequence.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_ID = 50256
SEQUENCE_LENGTH = 2048
SEQUENCES_PER_SHARD = 2048
ROUNDS = 6
#: Bytes of tokens that a task holds before it sends them on.
HOLD_BYTES = 12 << 20
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHUNKS = "shard int, meta binary, payload binary"
MANIFEST = "slot long, seq_index long, shard int, byte_offset long, n_tokens int, doc_ids array<long>, sha256 string"


class Permutation:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the least even number of bits that holds n,
    walked along its cycle until the value is below n."""

    def __init__(self, n: int, key: str):
        self.n, self.half = n, max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.keys = np.frombuffer(hashlib.sha256(key.encode()).digest() * 2, U64)[:ROUNDS]
        self.mask = U64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> U64(self.half), x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mix64(left + k) & self.mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & self.mask)
        return (left << U64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(U64), back)
        while (over := out >= U64(self.n)).any():
            out[over] = self._once(out[over], back)
        return out.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def indexes(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


class Tokenizer:
    """A byte-level vocabulary of ranks. Broadcast, so a worker builds its encoder once."""

    def __init__(self, path: str = VOCABULARY, end_id: int = END_ID):
        with open(path, "rb") as f:
            self.ranks = f.read()
        self.end_id, self.encoder = end_id, None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "end_id": self.end_id, "encoder": None}

    def ready(self) -> tiktoken.Encoding:
        if self.encoder is None:
            ranks = {b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self.encoder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return self.encoder

    def dtype(self) -> str:
        return "<u2" if max(self.ready().n_vocab - 1, self.end_id) < 1 << 16 else "<u4"

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text and the end id; nothing for an empty text."""
        if not text:
            return np.zeros(0, self.dtype())
        return np.array([*self.ready().encode_ordinary(text), self.end_id], self.dtype())


@dataclass(frozen=True)
class Layout:
    """What a reader needs: record k of the order is at (k % per_shard) * stride of shard k // per_shard."""

    n_sequences: int
    length: int
    per_shard: int
    dtype: str
    end_id: int
    key: str

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.dtype).itemsize

    @property
    def n_shards(self) -> int:
        return -(-self.n_sequences // self.per_shard)


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def tokenized(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """pid, at, doc_id, tokens: each row's ids, the scan partition and the place in that partition's token stream."""
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, own = TaskContext.get().partitionId(), 0, shipped.value
        for batch in parts(batches):
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            places = at + np.append(0, np.cumsum([len(x) for x in ids], dtype=np.int64))
            at = int(places[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), pid, np.int32)), pa.array(places[:-1]), batch.column(0).cast(pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["pid", "at", "doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "pid int, at long, doc_id long, tokens binary")


def _chunks(tokens: DataFrame, layout: Layout, base: dict[int, tuple[int, int]]) -> DataFrame:
    """Pieces of documents, cut at the sequences' borders: one row for each shard that a task has pieces for."""
    order, width = Permutation(layout.n_sequences, layout.key), np.dtype(layout.dtype).itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        held: list[tuple[np.ndarray, list[bytes]]] = []
        size = 0

        def send() -> pa.RecordBatch:
            meta = np.concatenate([m for m, _ in held])
            parts = [p for _, ps in held for p in ps]
            meta_shard = meta[:, 0] // layout.per_shard
            by = np.argsort(meta_shard, kind="stable")
            cut = np.flatnonzero(np.diff(meta_shard[by])) + 1
            rows = [(int(meta_shard[g[0]]), packer.compress(meta[g].tobytes()), packer.compress(b"".join(parts[k] for k in g))) for g in np.split(by, cut)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "meta", "payload"])

        for batch in batches:
            pids, ats, ids, raws = (batch.column(i).to_pylist() for i in range(4))
            for pid, at, doc, raw in zip(pids, ats, ids, raws, strict=True):
                n = len(raw) // width
                if not n:
                    continue
                ahead, count = base.get(pid, (0, 0))
                start = ahead + at
                if at + n > count:
                    raise RuntimeError(f"partition {pid} has other rows than when its tokens were counted")
                seq = np.arange(start // layout.length, (start + n - 1) // layout.length + 1)
                low = np.maximum(seq * layout.length, start)
                high = np.minimum((seq + 1) * layout.length, start + n)
                none = doc is None
                meta = np.column_stack([order.slots(seq), seq, low - seq * layout.length, high - low, np.full(len(seq), 0 if none else doc), np.full(len(seq), int(none))]).astype(np.int64)
                held.append((meta, [raw[(a - start) * width : (b - start) * width] for a, b in zip(low.tolist(), high.tolist(), strict=True)]))
                size += len(raw)
                if size >= HOLD_BYTES:
                    yield send()
                    size = 0
        if held:
            yield send()

    return tokens.select("pid", "at", "doc_id", "tokens").mapInArrow(trimmed(run), CHUNKS)


def _write(chunks: DataFrame, layout: Layout, path: str) -> DataFrame:
    """Each task lays out the shards of its range and writes each as one file, put in place by a rename, so a task
    that runs again leaves the same file. One manifest row a sequence."""
    width = np.dtype(layout.dtype).itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        shards: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for batch in batches:
            for shard, meta, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard not in shards:
                    first = shard * layout.per_shard
                    n = min(layout.per_shard, layout.n_sequences - first)
                    shards[shard] = (np.full(n * layout.length, layout.end_id, layout.dtype), [])
                space, metas = shards[shard]
                rows = np.frombuffer(opener.decompress(meta), np.int64).reshape(-1, 6)
                ids, at = np.frombuffer(opener.decompress(payload), layout.dtype), 0
                for slot, _, low, n, _, _ in rows.tolist():
                    to = (slot - shard * layout.per_shard) * layout.length + low
                    space[to : to + n] = ids[at : at + n]
                    at += n
                metas.append(rows)
        for shard, (space, metas) in sorted(shards.items()):
            fs, folder = pafs.FileSystem.from_uri(path)
            fs.create_dir(folder, recursive=True)
            part = f"{folder}/.{shard_name(shard)}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(part) as out:
                out.write(space.tobytes())
            fs.move(part, f"{folder}/{shard_name(shard)}")
            rows = np.concatenate(metas)
            rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
            cut = np.append(0, np.flatnonzero(np.diff(rows[:, 0])) + 1)
            slots = rows[cut, 0]
            data = memoryview(space.view(np.uint8))
            digests = [hashlib.sha256(data[k * layout.stride : (k + 1) * layout.stride]).hexdigest() for k in (slots - shard * layout.per_shard).tolist()]
            docs = pa.ListArray.from_arrays(pa.array(np.append(cut, len(rows)), pa.int32()), pa.array(rows[:, 4], mask=rows[:, 5] == 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(rows[cut, 1]), pa.array(np.full(len(cut), shard, np.int32)), pa.array((slots - shard * layout.per_shard) * layout.stride), pa.array(np.add.reduceat(rows[:, 3], cut).astype(np.int32)), docs, pa.array(digests, pa.string())],
                names=["slot", "seq_index", "shard", "byte_offset", "n_tokens", "doc_ids", "sha256"],
            )

    assert width * layout.length == layout.stride
    return chunks.repartitionById(max(1, layout.n_shards), F.col("shard")).mapInArrow(trimmed(run), MANIFEST)


def token_shards(docs: DataFrame, path: str, tokenizer: Tokenizer | None = None, length: int = SEQUENCE_LENGTH, per_shard: int = SEQUENCES_PER_SHARD, key: str = "order", keep_tokens: bool = True) -> DataFrame:
    """Write docs (doc_id, text) to path as shards of token sequences in training order; returns the manifest, one row
    a sequence: slot, seq_index, shard, byte_offset, n_tokens (without filling), doc_ids (in order), sha256 of its
    record. The files are written when the manifest is computed.

    Documents, each with the end id, form one stream in scan order, cut every `length` ids; the end of the stream is
    filled with the end id. Sequence k goes to slot Permutation(n, key)(k); shard s has the slots from s * per_shard.
    Null or empty text gives no ids. Repeated rows count each; a null doc_id is a null in doc_ids; other columns are
    not read. An empty table gives no shards and no rows.

    With keep_tokens, texts are tokenised once and kept in the shared folder; without, they are tokenised twice, which
    takes less disk; docs must then be a scan of files that reads the same each time, and the second pass fails if a
    partition has other counts than in the first. So that both passes split the files alike whatever executors there
    are, spark.sql.files.minPartitionNum is then set for the session where it is unset. A shuffle moves each token once, in one row for each task and shard.
    The driver gets one count a scan partition.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or Tokenizer()
    layout = Layout(0, length, per_shard, tokenizer.dtype(), tokenizer.end_id, key)
    if not keep_tokens and spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    tokens = tokenized(docs, tokenizer)
    if keep_tokens:
        tokens = stash(tokens, "tokens")
    width = np.dtype(layout.dtype).itemsize
    sizes = tokens.groupBy("pid").agg(F.max(F.col("at") + F.octet_length("tokens") / width).cast("long").alias("n")).orderBy("pid").collect()
    base, total = {}, 0
    for row in sizes:
        base[row["pid"]] = (total, row["n"])
        total += row["n"]
    layout = Layout(-(-total // length), length, per_shard, layout.dtype, layout.end_id, key)
    if not layout.n_sequences:
        if keep_tokens:
            discard(tokens)
        return spark.createDataFrame([], MANIFEST)
    fs, folder = pafs.FileSystem.from_uri(path)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/layout.json") as out:
        out.write(json.dumps(asdict(layout)).encode())
    return _write(_chunks(tokens, layout, base), layout, path)


def read_slots(path: str, start: int, count: int) -> np.ndarray:
    """Records start..start+count of the training order, as (records, length): sequential reads that can resume at
    any slot."""
    fs, folder = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(f"{folder}/layout.json") as f:
        layout = Layout(**json.loads(f.read()))
    out, slot, stop = [], start, min(start + count, layout.n_sequences)
    while slot < stop:
        shard, k = divmod(slot, layout.per_shard)
        n = min(stop - slot, layout.per_shard - k)
        with fs.open_input_file(f"{folder}/{shard_name(shard)}") as f:
            f.seek(k * layout.stride)
            out.append(np.frombuffer(f.read(n * layout.stride), layout.dtype))
        slot += n
    return (np.concatenate(out) if out else np.zeros(0, layout.dtype)).reshape(-1, layout.length)


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of every document in the shared folder; cases as in token_shards()."""
    return token_shards(table(spark, sf_dir, "documents"), qualified(spark, fresh_path(spark, "token-shards")))
