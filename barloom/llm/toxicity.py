"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams (LEAST to MOST, lower case) that a text has. The
log-count ratio of a feature is the log of its smoothed share among the features of toxic
texts over that among the others. Features that few texts have, or whose ratio is small,
are left out; the others enter a logistic regression with their ratio as value. The fit is
one executor task on at most SAMPLE labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from barloom.llm.grams import blocks, char_grams, code_points, fitted, held_out, labelled_sample
from barloom.session import ship_package

#: Bound on the labelled rows that the fit reads.
SAMPLE = 6000
LEAST, MOST, BITS = 3, 6, 20
#: Texts that must have a feature, and least absolute log-count ratio.
SUPPORT, RATIO = 5, 1.2
RIDGE, ROUNDS, RATE = 1e-4, 600, 0.5
THRESHOLD = 0.5


@dataclass
class NbLinear:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of each text, 0 to 1; a text with no known feature gets the bias's."""
        out = np.empty(len(texts))
        some = self.weights != 0
        for block in blocks(texts):
            doc, feature = features([texts[i] for i in block], some)
            z = np.bincount(doc, self.weights[feature], len(block)) + self.bias
            out[block] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def features(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs of each n, of the buckets that ``keep`` marks."""
    chars, ends = code_points([t.lower() for t in texts])
    found = []
    for n, bucket in char_grams(chars, LEAST, MOST, BITS):
        at = np.arange(len(bucket)) if keep is None else np.flatnonzero(keep[bucket])
        doc = np.searchsorted(ends, at, "right")
        whole = at + n <= ends[doc]
        found.append(np.unique(doc[whole] << BITS | bucket[at[whole]]))
    pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(sample: list[tuple[str, int]]) -> NbLinear:
    """Fit on (text, label) pairs; with one class only, every text gets that class's smoothed share."""
    y = np.array([label for _, label in sample], float)
    size = 1 << BITS
    if len(sample) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return NbLinear(np.zeros(size), float(np.log(share / (1 - share))))
    docs, buckets = [], []
    counts = np.zeros((2, size), np.int32)
    texts = [t for t, _ in sample]
    for block in blocks(texts):
        doc, bucket = features([texts[i] for i in block])
        doc = np.asarray(block)[doc]
        for c in (0, 1):
            counts[c] += np.bincount(bucket[y[doc] == c], minlength=size).astype(np.int32)
    shares = (counts + 1.0) / (counts + 1.0).sum(axis=1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    keep = (counts.sum(axis=0) >= SUPPORT) & (np.abs(ratio) >= RATIO)
    place = np.cumsum(keep) - 1  # kept buckets, numbered
    for block in blocks(texts):
        doc, bucket = features([texts[i] for i in block], keep)
        docs.append(np.asarray(block)[doc].astype(np.int32))
        buckets.append(place[bucket].astype(np.int32))
    scale = ratio[keep]
    power = np.zeros(len(y))
    for doc, bucket in zip(docs, buckets):
        power += np.bincount(doc, scale[bucket] ** 2, len(y))
    norm = power.mean() + 1
    w, b = np.zeros(len(scale)), 0.0
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes weigh the same
    speed_w, speed_b = np.zeros(len(scale)), 0.0
    for _ in range(ROUNDS):
        z, slope, scaled = np.full(len(y), b), np.zeros(len(scale)), scale * w
        for doc, bucket in zip(docs, buckets):
            z += np.bincount(doc, scaled[bucket], len(y))
        gap = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        for doc, bucket in zip(docs, buckets):
            slope += np.bincount(bucket, gap[doc], len(scale))
        speed_w = 0.9 * speed_w - RATE * 4 / norm * (scale * slope / len(y) + RIDGE * w)
        speed_b = 0.9 * speed_b - RATE * 0.4 * gap.mean()
        w += speed_w
        b += speed_b
    weights = np.zeros(size)
    weights[keep] = w * scale
    return NbLinear(weights, float(b))


def scored(docs: DataFrame, model: NbLinear, column: str = "score") -> DataFrame:
    """Add the score of ``text`` to every row; null counts as empty."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(sent.value.scores([t or "" for t in part]))

    return docs.withColumn(column, score("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> NbLinear:
    return fitted(labelled_sample(docs, labels, "toxic", sample), fit)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for every row of ``docs``.

    Fits on labelled rows that are not held out. No labels at all: every score is 0.5.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns. Null texts stay."""
    return scored(docs, train(docs, labels), "__score").where(F.col("__score") < THRESHOLD).drop("__score")
