"""Operator 6: language identification by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.llm.textops import parts, trimmed
from sonolith.session import table

#: Features: hashed 1- to 3-grams of lower-case letters, words marked by a space.
DIM = 1 << 15
ORDERS = 3
#: Bound of the labelled rows that the classifier is fitted on, over all languages together.
SAMPLE_ROWS = 6000
UNKNOWN = "und"


def letters_table() -> np.ndarray:
    """Lower-case code point of each code point up to 0xFFFF, or 32 if it is no letter."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Featurizer:
    """Counts of hashed n-grams of a text; makes its table in the worker."""

    def __init__(self) -> None:
        self.table: np.ndarray | None = None

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and counts; both empty if the text has no letters."""
        if self.table is None:
            self.table = letters_table()
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = cp > 0xFFFF
        c = self.table[np.where(wide, 0, cp)]
        if wide.any():
            c = np.where(wide & np.array([chr(x).isalpha() if x > 0xFFFF else False for x in cp]), cp, c)
        c = np.concatenate(([32], c, [32])).astype(np.uint64)
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
        if len(c) <= 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams, h = [], c
        for k in range(ORDERS):
            if k:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[k:]
            grams.append(((h + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49))
        counts = np.bincount(np.concatenate(grams).astype(np.int64), minlength=DIM)
        index = np.flatnonzero(counts)
        return index, counts[index]


def weigh(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic term frequency, of length 1."""
    x = (1 + np.log(counts)) * idf[index]
    return (x / max(1e-12, float(np.sqrt(x @ x)))).astype(np.float32)


@dataclass
class LanguageModel:
    """classes: learned languages; weights: (DIM + 1, classes), the last row is the bias; idf; temperature."""

    classes: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weigh(index, counts, self.idf) @ self.weights[index] + self.weights[-1]


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-5, epochs: int = 3) -> np.ndarray:
    """Weights (DIM + 1, classes) by follow-the-regularised-leader with elastic-net penalties (McMahan et al., 2013);
    the bias has no l1. rows: indexes, values, class; they are used in their order."""
    z, n = np.zeros((DIM + 1, n_classes)), np.zeros((DIM + 1, n_classes))

    def weights(zi: np.ndarray, ni: np.ndarray, bias: bool) -> np.ndarray:
        return -np.sign(zi) * np.maximum(np.abs(zi) - (0 if bias else l1), 0) / ((beta + np.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for index, x, y in rows:
            zi, ni = z[index], n[index]
            w, wb = weights(zi, ni, False), weights(z[-1], n[-1], True)
            s = x @ w + wb
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            new = ni + g * g
            z[index] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / alpha * w
            n[index] = new
            nb = n[-1] + p * p
            z[-1] += p - (np.sqrt(nb) - np.sqrt(n[-1])) / alpha * wb
            n[-1] = nb
    out = weights(z, n, False)
    out[-1] = weights(z[-1], n[-1], True)
    return out.astype(np.float32)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fold(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """A model from the rows of docs with text and lang; None if there are none.

    Document frequencies cover all rows. The classifier is fitted on at most about sample_rows rows, the same number
    of each language as far as it has them, chosen by a hash of doc_id; a fifth of them sets the temperature. What the
    driver gets is bounded: DIM frequencies, and the sample's n-gram counts.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per:
        return None
    classes = sorted(per)
    featurize = Featurizer()

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                index, _ = featurize(text)
                df[index] += 1
                n += len(index) > 0
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, DIM)), pa.array(np.append(df[some], n))], names=["feature", "n"])

    df = np.zeros(DIM + 1)
    for feature, n in known.select("text").mapInArrow(trimmed(frequencies), "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        df[feature] = n
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1
    # The sample: a share of each language's rows, by hash.
    share = F.lit(0.0)
    for lang, n in per.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample_rows / len(classes) / n)).otherwise(share)
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(unit < share).select("doc_id", F.xxhash64("doc_id", "text").alias("order"), "text", "lang")

    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            pairs = [featurize(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.uint16).tobytes() for i, _ in pairs]), pa.array([c.astype(np.uint32).tobytes() for _, c in pairs]), batch.column(2)], names=["order", "i", "c", "lang"])

    got = chosen.select("order", "text", "lang").mapInArrow(trimmed(sparse), "order long, i binary, c binary, lang string").collect()
    rows = [(index, weigh(index, np.frombuffer(r["c"], np.uint32), idf), classes.index(r["lang"])) for r in sorted(got, key=lambda r: (r["order"], r["lang"])) if len(index := np.frombuffer(r["i"], np.uint16).astype(np.int64))]
    apart, fit = rows[::5], [r for k, r in enumerate(rows) if k % 5]
    if not fit:
        apart, fit = [], rows
    weights = train_ftrl(fit, len(classes))
    temperature = fit_temperature(np.array([x @ weights[i] + weights[-1] for i, x, _ in apart]), np.array([y for *_, y in apart])) if apart else 1.0
    return LanguageModel(classes, weights, idf.astype(np.float32), temperature)


def identify(docs: DataFrame, model: LanguageModel | None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """docs with columns of these names: the likeliest learned language of each whole text and its calibrated
    probability. Null text, text without letters, or no model: "und", 0.0. All columns of docs stay, but those of these
    names are replaced; nothing but text is read. Narrow: no shuffle; the model has a fixed size."""
    featurize = Featurizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            said, scores = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                index, counts = featurize(text or "")
                if model is None or not len(index):
                    said.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                s = model.logits(index, counts).astype(float) / model.temperature
                best = int(s.argmax())
                said.append(model.classes[best])
                scores.append(float(1 / np.exp(s - s[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names])

    clear = docs.drop(*names)
    return clear.mapInArrow(trimmed(run), T.StructType([*clear.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; cases as in train() and identify()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 4) == 2)
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
