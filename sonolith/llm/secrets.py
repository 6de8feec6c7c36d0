"""Operator 1: secret scan with one combined deterministic automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sonolith.llm.automaton import BASE_RULES, EXTRA_RULES, Rule, compile_rules, matches
from sonolith.llm.textops import arrow_bytes, slices, trimmed
from sonolith.session import table

SCHEMA = "doc_id long, kinds array<string>, starts array<long>, ends array<long>"


def _listed(rows: list[list], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for r in rows for x in r], kind))


def spans_in(auto, column: pa.Array) -> list[list[tuple[int, str, int]]]:
    """For each row of a string column its (start, kind, end) in code points, by start, then by the rules' order."""
    data, offsets = arrow_bytes(column)
    out: list[list[tuple[int, str, int]]] = [[] for _ in range(len(offsets) - 1)]
    for i, j in slices(offsets, 32 << 20):  # wide, so that many rows advance at once
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        for row, found in matches(auto, part, off).items():
            text = part[off[row] : off[row + 1]]
            # a code point starts at each byte that is no continuation byte
            before = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            out[i + row] = [(int(before[s]), auto.rules[k].kind, int(before[e])) for s, k, e in found]
    return out


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES) -> DataFrame:
    """Secrets of each document: one row a document with parallel arrays of kind, start and end (code points, end
    exclusive), by start, then by the rules' order.

    Null or empty text: empty arrays. A null doc_id and repeated rows stay as they are, one row each; other columns
    are not read. An empty table gives no rows. Narrow: no shuffle; the automaton (a few MB, fixed by the rules) is
    shipped with the task.
    """
    auto = compile_rules(rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = spans_in(auto, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(_listed([[x[i] for x in s] for s in spans], t) for i, t in ((1, pa.string()), (0, pa.int64()), (2, pa.int64())))],
                names=["doc_id", "kinds", "starts", "ends"],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan_secrets(): counts of the base kinds, sha256 of the base spans, all spans."""
    base = [r.kind for r in BASE_RULES]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, starts, ends = (batch.column(i).to_pylist() for i in (1, 2, 3))
            each = [[(k, f"{k}:{s}:{e}") for k, s, e in zip(*x, strict=True)] for x in zip(kinds, starts, ends, strict=True)]
            counts = [pa.array([sum(k == b for k, _ in x) for x in each], pa.int64()) for b in base]
            own = [",".join(s for k, s in x if k in base) for x in each]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own], pa.string()), pa.array([",".join(s for _, s in x) for x in each], pa.string())],
                names=["doc_id", *(f"n_{b}" for b in base), "base_sha256", "spans"],
            )

    return found.mapInArrow(trimmed(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; cases as in scan_secrets()."""
    return digest(scan_secrets(table(spark, sf_dir, "documents")))


OP1_SQL = r"""WITH kinds(kind, place, pattern, part, least) AS (VALUES
  ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 18), ('hex', 2, '[0-9a-f]+', 0, 16),
  ('github', 3, 'gh[pousr]_[A-Za-z0-9]+', 0, 40), ('slack', 4, 'xox[abprs]-[A-Za-z0-9-]+', 0, 15)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, kind, place, least, unnest(regexp_extract_all(text, pattern, 0)) AS whole,
    unnest(CASE WHEN part = 2 THEN regexp_extract_all(text, pattern, 2) ELSE regexp_extract_all(text, pattern, 0) END) AS run,
    unnest(list_slice(regexp_split_to_array(text, pattern), 1, len(regexp_extract_all(text, pattern, 0)))) AS gap,
    unnest(range(len(regexp_extract_all(text, pattern, 0)))) AS k FROM d, kinds),
s AS (SELECT *, (sum(length(gap) + length(whole)) OVER (PARTITION BY r, kind ORDER BY k))::BIGINT AS stop FROM m),
f AS (SELECT r, kind, place, stop - length(whole) AS start, kind || ':' || (stop - length(whole)) || ':' || stop AS span FROM s WHERE length(run) >= least),
g AS (SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.r = g.r"""
