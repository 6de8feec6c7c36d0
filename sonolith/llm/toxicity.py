"""Operator 8: toxicity by two class-conditional Kneser-Ney models of character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.llm.langid import fold
from sonolith.llm.textops import arrow_bytes, fresh_name, slices, trimmed
from sonolith.session import table

#: Symbols: 0 between words, 1-26 letters without accents, 27 digits, 28 other letters. Models are of 4-grams.
SYMBOLS, ORDER = 29, 4
CELLS = SYMBOLS**ORDER
DISCOUNT = 0.75
#: Bound of the labelled rows that the two calibration parameters are fitted on.
CALIBRATION_ROWS = 20_000
#: Labels are joined by broadcast up to so many rows (about 20 bytes each), else by shuffling.
BROADCAST_ROWS = 1_000_000


def symbol_table() -> np.ndarray:
    """Symbol of each code point up to 0xFFFF; what is above counts as another letter."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        s = chr(c)
        base = unicodedata.normalize("NFD", s.lower())[:1]
        out[c] = 1 + ord(base) - 97 if "a" <= base <= "z" else 27 if s.isdigit() else 28 if s.isalpha() else 0
    return out


class Grams:
    """n-grams of the rows of a slice of texts; makes its table in the worker."""

    def __init__(self) -> None:
        self.table: np.ndarray | None = None

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and the row of each: every row reads as three word marks, its symbols with runs of marks as one, and
        a mark; an n-gram ends at each of these but the first three."""
        if self.table is None:
            self.table = symbol_table()
        cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        first = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        n, length = len(offsets) - 1, np.diff(first)
        code = np.where(cp > 0xFFFF, 28, self.table[np.minimum(cp, 0xFFFF)]).astype(np.int32)
        row = np.repeat(np.arange(n), length + ORDER)
        begin = first[:-1] + ORDER * np.arange(n)
        line = np.zeros(len(row), np.int32)
        line[np.arange(len(cp)) + np.repeat(ORDER * np.arange(n) + ORDER - 1, length)] = code
        lead = np.zeros(len(row), bool)
        for k in range(ORDER - 1):
            lead[begin + k] = True
        keep = lead.copy()
        keep[1:] |= (line[1:] != 0) | (line[:-1] != 0)
        line, row, lead = line[keep], row[keep], lead[keep]
        cell = line.copy()
        for k in range(1, ORDER):
            cell[k:] += line[:-k] * SYMBOLS**k
        return cell[~lead], row[~lead]


def kneser_ney(top: np.ndarray, shared: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """Interpolated log-probabilities of each cell's last symbol. top: the class's counts; lower orders use the
    class's continuation counts, and at the two lowest orders the continuation counts that both classes share."""

    def orders(counts: np.ndarray) -> list[np.ndarray]:
        out = [counts.astype(np.float64)]
        while len(out) < ORDER:
            out.append((out[-1].reshape(SYMBOLS, -1) > 0).sum(axis=0).astype(np.float64))
        return out[::-1]

    own, pooled, p = orders(top), orders(shared), np.full((1, SYMBOLS), 1 / SYMBOLS)
    for k in range(ORDER):
        counts = (pooled if k < 2 else own)[k].reshape(-1, SYMBOLS)
        total, types = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        lower = np.tile(p, (len(counts) // len(p), 1))
        some = np.maximum(total, 1)
        p = np.where(total > 0, (np.maximum(counts - discount, 0) + discount * types * lower) / some, lower)
    return np.log(np.maximum(p.reshape(-1), 1e-12))


@dataclass
class ToxicityModel:
    """ratio: log-likelihood of toxic less ordinary for each cell; score is the logistic of slope * mean + offset."""

    ratio: np.ndarray
    slope: float
    offset: float


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps, with a weak penalty on the slope."""
    scale = float(x.std()) or 1.0
    u, a, b = x / scale, 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - y) * u).sum() + 1e-2 * a, (p - y).sum()])
        hess = np.array([[(w * u * u).sum() + 1e-2, (w * u).sum()], [(w * u).sum(), w.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a / scale), float(b)


def means(docs: DataFrame, ratio: np.ndarray | None, name: str) -> DataFrame:
    """docs with a column of that name: the mean of ratio over the text's n-grams (0 if the text is null or empty)."""
    grams = Grams()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(batch.schema.get_field_index("text")))
            mean = np.zeros(len(offsets) - 1)
            for i, j in slices(offsets) if ratio is not None else ():
                if offsets[j] > offsets[i]:
                    cell, row = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    total, n = np.bincount(row, ratio[cell], j - i), np.bincount(row, minlength=j - i)
                    mean[i:j] = np.where(np.diff(offsets[i : j + 1]) > 0, total / np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean)], names=[*batch.schema.names, name])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, calibration: int = CALIBRATION_ROWS) -> ToxicityModel | None:
    """A model from the rows of docs (doc_id, text) that labels (doc_id, toxic) marks 0 or 1; None if a class is
    missing. Rows of labels with a null are left out; of several for a document the largest counts.

    About `calibration` rows, a quarter of the labelled ones at most, chosen by hash, set the logistic's two parameters;
    the n-gram counts cover all others. The driver gets one count for each cell and class at most.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n_labels = labels.count()
    if n_labels <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    share = min(1.0, calibration / max(1, n_labels / 4))
    apart = (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0) & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))
    known = docs.select("doc_id", "text").join(marks, "doc_id").withColumn("apart", apart)
    grams = Grams()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(0))
            toxic = np.asarray(batch.column(1), dtype=np.int64)
            for i, j in slices(offsets):
                cell, row = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held += np.bincount(cell + toxic[i:j][row] * CELLS, minlength=2 * CELLS)
        some = np.flatnonzero(held)
        for k in range(0, max(1, len(some)), 1 << 18):
            part = some[k : k + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part])], names=["cell", "n"])

    sums = known.where("NOT apart").select("text", "toxic").mapInArrow(trimmed(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(2 * CELLS)
    got = sums.toArrow()
    both[got.column(0).to_numpy()] = got.column(1).to_numpy()
    ordinary, toxic = both[:CELLS], both[CELLS:]
    if not ordinary.any() or not toxic.any():
        return None
    ratio = (kneser_ney(toxic, both[:CELLS] + toxic) - kneser_ney(ordinary, ordinary + toxic)).astype(np.float32)
    rows = means(known.where("apart").select("text", "toxic"), ratio, "mean").select("mean", "toxic").collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    slope, offset = fit_logistic(x, y) if 0 < y.sum() < len(y) else (50.0, -1.0)
    return ToxicityModel(ratio, slope, offset)


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """docs with toxic_score (0 to 1) of each whole text: the length-normalised log-likelihood ratio, calibrated. Null
    or empty text has ratio 0; without a model every score is 0. All columns of docs stay, but one named toxic_score is
    replaced; nothing but text is read.
    Narrow: no shuffle; the model has a fixed size (CELLS floats)."""
    mean = fresh_name(docs, "mean")
    scored = means(docs.drop("toxic_score"), model.ratio if model else None, mean)
    s = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col(mean) + F.lit(model.offset)))) if model else F.lit(0.0)
    return scored.withColumn("toxic_score", s).drop(mean)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; cases as in train() and score()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 5) == 0)
    model = train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = score(docs, model).select("doc_id", "held_out", F.col("toxic_score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
