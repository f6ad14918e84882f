"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance that is shrunk towards the pooled covariance and that towards its diagonal.  Scores
are the logistic of the difference of the two classes' Mahalanobis log densities plus the log prior odds; the Cholesky
factors are computed once and sent to the tasks.  Counts, sums and cross products of the labelled rows are added up over the
whole table, so nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import kept, raw, text_slices
from panelyard.llm.words import words

FEATURES = ("bytes", "words", "word_length", "distinct", "upper", "digit", "symbol", "bar", "stop", "blank", "line", "wide", "repeated")
#: Shares of the pooled covariance in a class's, and of the diagonal in the pooled one.
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05
_CLASS = np.zeros(256, np.int64)  # 0: letters and anything else
for _k, _own in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"*$%&#!@^~_=+<>{}[]\\", b"|", b".,;:?", b" \t\r", b"\n", bytes(range(128, 256))), 1):
    _CLASS[list(_own)] = _k


def statistics(texts: pa.StringArray) -> np.ndarray:
    """A row of FEATURES for each text: logarithms of counts, log odds of shares (smoothed, so empty texts have values too)."""
    data, begins = raw(texts)
    n, size = len(texts), np.diff(begins).astype(float)
    doc = np.repeat(np.arange(n), np.diff(begins))
    count = np.bincount(doc * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9).astype(float)
    found = words(texts)
    n_words = np.diff(found.first).astype(float)
    pairs = np.unique(found.doc_of() * (len(found.spellings) + 1) + found.ids)
    distinct = np.bincount(pairs // (len(found.spellings) + 1), minlength=n).astype(float)
    same = np.zeros(len(found.ids) + 1)
    if len(found.ids) > 8:  # a word that stands eight words before too
        same[9:] = np.cumsum(found.ids[8:] == found.ids[:-8])
    repeated = same[found.first[1:]] - same[found.first[:-1]]
    odds = lambda part, whole: np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))
    letters = np.maximum(size - count[:, 6] - count[:, 7], 0)
    share = [odds(count[:, k], letters) for k in (1, 2, 3, 4, 5)]
    return np.column_stack([np.log1p(size), np.log1p(n_words), np.log1p(letters / np.maximum(n_words, 1)), odds(distinct, n_words), *share, odds(count[:, 6], size), odds(count[:, 7], size), odds(count[:, 8], size), odds(repeated, n_words)])


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log determinants for class 0 and 1; log prior odds of class 1."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(1) - 0.5 * self.log_dets[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -500, 500)))


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL) -> Discriminant:
    """From each class's count, sums and cross products.  A class without rows takes the other's shape, and its prior says so."""
    d = sums.shape[1]
    safe = np.maximum(n, 1)[:, None]
    means = np.where(n[:, None] > 0, sums / safe, sums.sum(0) / max(n.sum(), 1))
    scatter = products - n[:, None, None] * np.einsum("ci,cj->cij", means, means) * (n > 0)[:, None, None]
    whole = scatter.sum(0) / max(n.sum() - 2, 1)
    whole = (1 - diagonal) * whole + diagonal * np.diag(np.diag(whole)) + 1e-6 * np.eye(d)
    factors, log_dets = [], []
    for c in (0, 1):
        own = scatter[c] / max(n[c] - 1, 1) if n[c] > 1 else whole
        chol = np.linalg.cholesky((1 - pooled) * own + pooled * whole)
        factors.append(np.linalg.inv(chol))
        log_dets.append(2 * np.log(np.diag(chol)).sum())
    return Discriminant(means, np.array(factors), np.array(log_dets), float(np.log((n[1] + 1) / (n[0] + 1))))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches):
        x = statistics(texts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


def learn(features: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """labels: doc_id and the label 0 or 1 (other values and nulls are left out, repeated rows count once)."""
    d = len(FEATURES)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").distinct()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y, x = batch.column("y").to_numpy(zero_copy_only=False), batch.column("x").flatten().to_numpy().reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["y", "parts"])

    parts = features.join(known, "doc_id").select("y", "x").mapInArrow(sums, "y int, parts array<double>")
    total = np.zeros((2, 1 + d + d * d))
    for row in parts.select("y", F.posexplode("parts").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + d + d * d) rows
        total[row.y, row.k] = row.v
    return fit(total[:, 0], total[:, 1 : d + 1], total[:, d + 1 :].reshape(2, d, d))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted; learnt from labelled rows that aren't held out (crc32 of the id, mod 3, is 1).

    Only the text is an input of the score.  Null text counts as empty and gets the score of its statistics; repeated rows
    score alike; without labels the classes are alike and every score is 0.5.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = kept(base.mapInArrow(_features, "doc_id long, x array<double>"), "quality-features")
    model = learn(features.where(remainder(F.col("doc_id"), 3) != 1), labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = features.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
