"""Operator 10: near-duplicate embeddings by int8 tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.llm.components import components, meet
from sonolith.llm.textops import trimmed
from sonolith.llm.wide_simhash import runs
from sonolith.session import stash, table

COSINE = 0.95
#: Vectors of a chunk; a task compares two chunks.
CHUNK = 8192
#: Rows of a chunk that are multiplied at once; bounds the pairs held, also where all are linked.
STRIP = 256
#: Allowance for rounding in double precision: pairs so near the threshold are always computed in full.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the norms of the errors: unit = scale * code + error, row by row."""
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(unit - scale[:, None] * code, axis=1)


def close_pairs(a: tuple, b: tuple, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) that may be at or above the threshold, and whether they surely are, strip by strip.
    a, b: codes, scales and errors of unit vectors; same: a is b, and a pair counts once.

    With x = sx*cx + ex and y = sy*cy + ey, |x.y - sx*sy*cx.cy| <= |ex|*|y| + |sx*cx|*|ey| <= |ex| + (1 + |ex|)*|ey|. The
    integer products are exact in single precision (dims * 127**2 < 2**24 up to 1040 dimensions; beyond, in double).
    A pair is out if product and bound stay below the threshold, and in if the product less the bound is above it; the
    pairs between are open.
    """
    ca, sa, ea = a
    cb, sb, eb = b
    kind = np.float32 if ca.shape[1] <= 1040 else np.float64
    right, widest, coarsest = cb.astype(kind).T, float(sb.max()), float(eb.max())
    for i in range(0, len(ca), STRIP):
        product = ca[i : i + STRIP].astype(kind) @ right
        # first by the strip's loosest bound, then by each pair's own
        floor = (cosine - SLACK - ea[i : i + STRIP] - (1 + ea[i : i + STRIP]) * coarsest) / (sa[i : i + STRIP] * widest)
        rows, cols = np.nonzero(product >= (floor[:, None] * (1 - 1e-6 * np.sign(floor[:, None]))).astype(kind))
        approx = product[rows, cols].astype(np.float64) * sa[i + rows] * sb[cols]
        rows = rows + i
        error = ea[rows] + (1 + ea[rows]) * eb[cols] + SLACK
        keep = approx + error >= cosine
        if same:
            keep &= rows < cols
        yield rows[keep], cols[keep], approx[keep] - error[keep] >= cosine


def at_least(xa: np.ndarray, xb: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Whether pairs of unit vectors are at or above the threshold, in double precision."""
    good = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        good[part] = np.einsum("ij,ij->i", xa[i[part]], xb[j[part]]) >= cosine
    return good


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the first member of each one's component) after the links i - j are added."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for x in (i, j):
            np.minimum.at(new, x, low)
            np.minimum.at(new, label[x], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def usable(vector: np.ndarray) -> bool:
    return len(vector) > 0 and bool(np.isfinite(vector).all()) and bool((vector != 0).any())


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def prepared(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id, dims, raw, node of each row: raw are the vector's bytes, null if it links with nothing; node is a hash
    of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lists = column.to_pylist() if column.null_count or column.flatten().null_count else None
            if lists is None:
                flat = column.flatten().to_numpy(zero_copy_only=False)
                cut = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).tolist()
                vectors = [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            else:
                vectors = [np.array([np.nan if x is None else x for x in v or ()], kind) for v in lists]
            raw = [(v + 0.0).astype(kind).tobytes() if usable(v) else None for v in vectors]  # + 0.0: no negative zero
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(v) for v in vectors], pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "dims", "raw"])

    return rows.select("vec_id", "embedding").mapInArrow(trimmed(run), "vec_id long, dims int, raw binary").withColumn("node", F.xxhash64("raw"))


def coded(nodes: DataFrame, kind: str) -> DataFrame:
    """nodes (node, dims, copies, raw) with code, scale and error of their unit vectors, without raw."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = batch.column(3).to_pylist(), np.asarray(batch.column(1))
            code, scale, error = [b""] * len(raw), np.zeros(len(raw)), np.zeros(len(raw))
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                c, scale[own], error[own] = quantise(unit_rows(np.frombuffer(b"".join(raw[k] for k in own), kind).reshape(len(own), d)))
                for k, row in zip(own.tolist(), c, strict=True):
                    code[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(code, pa.binary()), pa.array(scale), pa.array(error)], names=["node", "dims", "copies", "code", "scale", "error"])

    return nodes.select("node", "dims", "copies", "raw").mapInArrow(trimmed(run), "node long, dims int, copies long, code binary, scale double, error double")


_TILE = "key long, tile long, own int, twin int, node long, copies long, code binary, scale double, error double"
_FOUND = ["links_of", "n", "u", "v"]


class Found:
    """What a group's links add up to: by member its linked rows, and edges with the links' components."""

    def __init__(self, node: np.ndarray, copies: np.ndarray):
        self.node, self.copies = node, copies
        self.n, self.label = np.zeros(len(node)), np.arange(len(node))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.n += np.bincount(i, self.copies[j], len(self.n)) + np.bincount(j, self.copies[i], len(self.n))
        self.label = joined(self.label, i, j)

    def rows(self) -> list[pa.Array]:
        """The columns of _FOUND: rows (links_of, n, null, null), then rows (null, null, u, v)."""
        counted, moved = np.flatnonzero(self.n), np.flatnonzero(self.label != np.arange(len(self.n)))
        none, void = pa.nulls(len(moved), pa.int64()), pa.nulls(len(counted), pa.int64())
        pairs = (self.node[counted], none), (self.n[counted].astype(np.int64), none), (void, self.node[moved]), (void, self.node[self.label[moved]])
        return [pa.concat_arrays([pa.array(a), pa.array(z)]) for a, z in pairs]


def _groups(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, dict[str, np.ndarray], tuple, tuple, int, bool]]:
    """For each group of two chunks: its rows, its numbers by column, the codes of both sides, where the second begins,
    and whether both are one. Groups with a chunk that is empty are left out."""
    ints = ["key", "tile", "own", "twin", "node", "copies"]
    for block in runs(batches, names):
        cols = {c: np.asarray(block.column(c), dtype=np.int64) for c in ints}
        cut = np.flatnonzero((np.diff(cols["key"]) != 0) | (np.diff(cols["tile"]) != 0)) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(cols["key"])).tolist(), strict=True):
            rows, own = block.slice(a, b - a), {c: x[a:b] for c, x in cols.items()}
            same, split = bool(own["twin"][0]), int((own["own"] == own["own"][0]).sum())
            if not same and split == b - a:
                continue
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(b - a, -1)
            all_ = (code, np.asarray(rows.column("scale")), np.asarray(rows.column("error")))
            left, right = (all_, all_) if same else (tuple(v[:split] for v in all_), tuple(v[split:] for v in all_))
            yield rows, own, left, right, 0 if same else split, same


def links(nodes: DataFrame, kind: str, cosine: float, chunk: int = CHUNK) -> DataFrame:
    """Of nodes (node, dims, raw, copies): rows (links_of, n, null, null) - copies of other nodes linked to a node, in
    parts to sum up - and rows (null, null, u, v) - edges with the links' components.

    Vectors of each dimension are dealt by hash to chunks of about `chunk`; each pair of chunks is one group, to which
    only codes go. Members of pairs that the bounds leave open are met again in their group, with their full vectors. A
    group emits at most one count, one edge and one open member a vector, however many pairs are linked.
    """
    parts = nodes.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, part) * F.col("parts").cast("long") + F.greatest(j, part))
    placed = coded(nodes, kind).join(F.broadcast(parts), "dims").withColumn("own", part).withColumn("tile", F.explode(others))
    twin = (F.col("tile") == F.col("own") * F.col("parts").cast("long") + F.col("own")).cast("int")
    names = [c.split()[0] for c in _TILE.split(", ")]
    tiled = placed.withColumns({"key": F.col("dims").cast("long"), "twin": twin}).select(*names)

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own, left, right, shift, same in _groups(batches, names):
            found, opened = Found(own["node"], own["copies"]), np.zeros(len(own["node"]), bool)
            for i, j, sure in close_pairs(left, right, same, cosine):
                j = j + shift
                found.add(i[sure], j[sure])
                opened[i[~sure]] = opened[j[~sure]] = True
            said, again = found.rows(), rows.filter(pa.array(opened)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*said, *(pa.nulls(len(said[0]), f.type) for f in again.schema)], names=[*_FOUND, *names])
            if again.num_rows:
                none = pa.nulls(again.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none] * 4 + [again.column(c).combine_chunks() for c in names], names=[*_FOUND, *names])

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own, left, right, shift, same in _groups(batches, [*names, "raw"]):
            found = Found(own["node"], own["copies"])
            x = unit_rows(np.frombuffer(b"".join(rows.column("raw").to_pylist()), kind).reshape(len(own["node"]), -1))
            for i, j, sure in close_pairs(left, right, same, cosine):
                i, j = i[~sure], j[~sure] + shift
                good = at_least(x, x, i, j, cosine)
                found.add(i[good], j[good])
            yield pa.RecordBatch.from_arrays(found.rows(), names=_FOUND)

    met = tiled.repartition("key", "tile").sortWithinPartitions("key", "tile", "own", "node").mapInArrow(trimmed(bounded), f"links_of long, n long, u long, v long, {_TILE}")
    met = stash(met, "tiles")
    again = met.where("key IS NOT NULL").select(*names).join(nodes.select("node", "raw"), "node")
    again = again.repartition("key", "tile").sortWithinPartitions("key", "tile", "own", "node").mapInArrow(trimmed(exact), "links_of long, n long, u long, v long")
    return met.where("key IS NULL").select(*_FOUND).unionAll(again)


def near_duplicate_vectors(rows: DataFrame, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of rows (vec_id, embedding: array of float or double).

    Vectors are linked at a cosine of at least `cosine`, computed in double precision; n_links counts the other rows
    linked directly, component_id is the smallest vec_id reachable, itself included. Null or empty vectors, zero
    vectors and those with null or non-finite components link with nothing; vectors of different lengths do not link.
    Equal vectors are one node with a number of copies, so they never become pairs. Repeated vec_ids stay, one row
    each; a null vec_id keeps its row, with the component of the others (null if it has no other). Other columns are
    not read. An empty table gives no rows.
    """
    kind = "<f8" if isinstance(rows.schema["embedding"].dataType.elementType, T.DoubleType) else "<f4"
    own = stash(prepared(rows, kind), "vectors")
    total = own.count()
    nodes = own.where("raw IS NOT NULL").groupBy("node").agg(F.first("dims").alias("dims"), F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = stash(nodes, "vector-nodes")
    found = stash(links(nodes.drop("least"), kind, cosine, chunk), "vector-links")
    counts = found.where("links_of IS NOT NULL").groupBy(F.col("links_of").alias("node")).agg(F.sum("n").alias("others"))
    member = components(found.where("u IS NOT NULL").select("u", "v"))
    rooted = nodes.select("node", "copies", "least").join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = meet(rooted, lowest, "root", total).join(counts, "node", "left")
    of = of.select("node", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n"))
    usable_ = own.where("raw IS NOT NULL").select("vec_id", "node")
    unusable = own.where("raw IS NULL").select("vec_id", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("n_links"))
    out = meet(usable_, of, "node", total).select("vec_id", "node", "component_id", "n_links").unionByName(unusable)
    single = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return single.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; cases as in near_duplicate_vectors()."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = """WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS MATERIALIZED (SELECT r, vec_id, v FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a, u b WHERE a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95::DOUBLE),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a, min(e.vec_id) AS least FROM reach JOIN e ON reach.b = e.r GROUP BY reach.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
o AS (SELECT vec_id, coalesce(n, 0) AS n_links, CASE WHEN least < vec_id OR vec_id IS NULL THEN least ELSE vec_id END AS component_id
  FROM e LEFT JOIN c ON e.r = c.a LEFT JOIN n ON e.r = n.a)
SELECT *, coalesce(vec_id = component_id, false) AS kept FROM o"""
