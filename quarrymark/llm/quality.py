"""Quality grading by ordinal cumulative-link regression on hashed text.

A document's score z is one linear function of hashed words and word shapes (shares of all words)
and a few whole-text measures; ordered thresholds t_1 < t_2 < ... turn it into
P(grade >= k) = sigmoid(z - t_k) for every grade at once, so expected grade and tail
probabilities come from the same weights. The fit sees at most ``most_rows`` rated documents,
those with the smallest hash of doc_id; scoring reads every whole text.

Defined results: null and empty texts are scored from the whole-text measures alone; ratings of
unknown documents and null ratings are ignored; a document rated more than once counts with its
highest rating; of rows that repeat a rated doc_id the greatest text is learned from, and each is
graded by its own text; with no ratings, or a single grade, every document has that grade (null if
none) and is selected; an empty table gives no rows. A column of the name ``into`` is replaced,
other columns pass unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SLOTS = 1 << 16
SMOOTH, SCALE = 4.0, 20.0
STEPS, RATE, DECAY = 160, 0.05, 1e-5
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)))


def word_slots(word: bytes) -> tuple[int, int]:
    """The slots of a word and of its shape (runs of one character class count once)."""
    shape = word.translate(_SHAPE)
    runs = bytes(c for k, c in enumerate(shape) if not k or c != shape[k - 1])
    return zlib.crc32(word.lower()) % SLOTS, zlib.crc32(runs, 7) % SLOTS


def measures(words: list[bytes], size: int) -> list[float]:
    """Whole-text measures: a constant, length, repeats of the word before, distinct share, word length."""
    n = len(words)
    if not n:
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    again = sum(map(bytes.__eq__, words[1:], words)) / n
    return [1.0, float(np.log1p(n)) / 10, again, len(set(words)) / n, min(size / n, 40.0) / 10]


class Remembered(dict):
    """A bounded table of a word's value, filled on first sight; very long words are not kept."""

    def __init__(self, compute, most: int = 200_000):
        self.compute, self.most = compute, most

    def __missing__(self, word: bytes):
        value = self.compute(word)
        if len(word) <= 256:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


@dataclass
class OrdinalModel:
    grades: list[float]
    thresholds: np.ndarray
    weights: np.ndarray
    dense: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for every grade but the lowest."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -40, 40)))

    def expected(self, z: np.ndarray) -> np.ndarray:
        gaps = np.diff(np.array(self.grades))
        return self.grades[0] + (self.tails(z) * gaps).sum(axis=1)


def _features(rated: DataFrame):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Remembered(word_slots, 100_000)
        for batch in slices(batches):
            rows: list[tuple] = []
            for t in batch.column(0).to_pylist():
                data = (t or "").encode()
                words = data.split()
                found = np.array([slots[w] for w in words], np.int64).ravel()
                ids, counts = np.unique(found, return_counts=True)
                rows.append((ids.astype(np.uint16).tobytes(), counts.astype(np.uint32).tobytes(), len(words), measures(words, len(data))))
            ids, counts, n, dense = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.array(n, pa.int64()), pa.array(dense, pa.list_(pa.float64())), batch.column(1)], names=["ids", "counts", "n", "dense", "grade"])

    return rated.mapInArrow(run, "ids binary, counts binary, n long, dense array<double>, grade double")


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "quality", most_rows: int = 8000) -> OrdinalModel:
    """The model of the ratings (doc_id, grade); ``most_rows`` bounds what reaches the driver."""
    rated = ratings.select(F.col("doc_id").cast("long").alias("rated_id"), F.col(grade).cast("double").alias("grade")).where("grade is not null and rated_id is not null")
    chosen = rated.groupBy("rated_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("rated_id"), "rated_id").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("rated_id"), "text").join(F.broadcast(chosen), "rated_id")
    texts = texts.groupBy("rated_id").agg(F.max("text").alias("text"), F.max("grade").alias("grade")).select("text", "grade")
    rows = _features(texts).toPandas()
    grades = sorted(rows["grade"].unique().tolist())
    if len(grades) < 2:
        return OrdinalModel(grades, np.empty(0), np.zeros(SLOTS), np.zeros(5))
    ids = [np.frombuffer(x, np.uint16) for x in rows["ids"]]
    row_of = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    columns = np.concatenate(ids).astype(np.int64)
    values = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["counts"]]) * (SCALE / (rows["n"].to_numpy() + SMOOTH))[row_of]
    dense = np.array(rows["dense"].tolist())
    y = np.searchsorted(grades, rows["grade"].to_numpy())
    return OrdinalModel(grades, *_solve(row_of, columns, values, dense, y, len(grades)))


def _solve(row_of: np.ndarray, columns: np.ndarray, values: np.ndarray, dense: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thresholds, hashed weights and dense weights, by Adam on the whole likelihood."""
    n = len(y)
    shares = np.array([(y >= g).mean() for g in range(1, k)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(shares / (1 - shares))
    sizes = [SLOTS, dense.shape[1], 1, k - 2]
    x = np.zeros(sum(sizes))
    x[SLOTS + sizes[1]] = start[0]
    x[SLOTS + sizes[1] + 1 :] = np.log(np.diff(start).clip(1e-2))
    m, v = np.zeros_like(x), np.zeros_like(x)
    cut = np.cumsum(sizes)[:-1]
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, STEPS + 1):
        w, d, first, logs = np.split(x, cut)
        t = first[0] + np.concatenate(([0.0], np.cumsum(np.exp(logs))))
        z = np.bincount(row_of, w[columns] * values, n) + dense @ d
        low = np.where(y > 0, sigmoid(z - t[np.maximum(y - 1, 0)]), 1.0)
        high = np.where(y < k - 1, sigmoid(z - t[np.minimum(y, k - 2)]), 0.0)
        p = np.maximum(low - high, 1e-9)
        at_low, at_high = low * (1 - low) / p, high * (1 - high) / p
        dz = -(at_low - at_high) / n
        dt = np.bincount(np.maximum(y - 1, 0), np.where(y > 0, at_low, 0), k - 1) / n - np.bincount(np.minimum(y, k - 2), np.where(y < k - 1, at_high, 0), k - 1) / n
        after = dt[::-1].cumsum()[::-1]
        grad = np.concatenate((np.bincount(columns, values * dz[row_of], SLOTS) + DECAY * w, dense.T @ dz, [dt.sum()], after[1:] * np.exp(logs)))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, d, first, logs = np.split(x, cut)
    return first[0] + np.concatenate(([0.0], np.cumsum(np.exp(logs)))), w, d


def grade(docs: DataFrame, model: OrdinalModel, text: str = "text", into: str = "quality_grade") -> DataFrame:
    """Adds a struct: expected grade and tails, P(grade >= each grade but the lowest)."""
    if len(model.grades) < 2:
        known = F.lit(float(model.grades[0])) if model.grades else F.lit(None).cast("double")
        return docs.withColumn(into, F.struct(known.alias("expected"), F.array().cast("array<double>").alias("tails")))

    @F.pandas_udf("expected double, tails array<double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = model.weights
        values = Remembered(lambda w: float(weights[list(word_slots(w))].sum()))
        for part in parts:
            z = np.zeros(len(part))
            for i, t in enumerate(part):
                data = (t or "").encode()
                words = data.split()
                z[i] = SCALE * sum(map(values.__getitem__, words)) / (len(words) + SMOOTH) + model.dense @ measures(words, len(data))
            yield pd.DataFrame({"expected": model.expected(z), "tails": list(model.tails(z))})

    return docs.withColumn(into, score(F.col(text)))


def selected(column: str = "quality_grade", least: float = 0.5):
    """Condition: the probability of more than the lowest grade reaches ``least``."""
    tails = F.col(f"{column}.tails")
    return (F.size(tails) == 0) | (F.get(tails, F.lit(0)) >= least)
