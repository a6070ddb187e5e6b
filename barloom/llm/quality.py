"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, of its hashed word
bigrams and of its hashed character n-grams (LEAST to MOST, case kept); a softmax over the
two classes follows. Of a word said again at once the repeats are one token of their own. The
vectors and the output layer are trained by stochastic gradient descent in numpy in one
executor task, on at most SAMPLE labelled rows. With the model fixed, the difference of the two
outputs is the average of one number a bucket, so scoring needs that table only.
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
SAMPLE = 5000
LEAST, MOST, BITS, SIZE = 2, 4, 18, 16
EPOCHS, RATE, SEED = 8, 0.5, 11
THRESHOLD = 0.3
#: Hash of the token that stands for a word equal to the one before it.
AGAIN = np.uint64(0x5851F42D4C957F2D)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram, one n after the other, of every word, and of every two words in a row; a word that is said again at once is the token AGAIN."""
    chars, ends = code_points(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    for n, bucket in char_grams(chars, LEAST, MOST, BITS):
        doc = owner[: len(bucket)]
        whole = doc == owner[n - 1 :]
        yield doc[whole], bucket[whole]
    space = np.flatnonzero(chars == 32)
    if len(space) > 1:
        # the hash of a word is the difference of a running polynomial at its two spaces, scaled to its start
        step = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.full(len(chars) + 1, step, np.uint64))
        total = np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * power[:-1])
        start, end = space[:-1], space[1:]
        word = end > start + 1
        start, end = start[word], end[word]
        inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        back = np.cumprod(np.full(len(chars) + 1, inverse, np.uint64))
        h = (total[end - 1] - total[start]) * back[start]
        doc = owner[start]
        same = doc[1:] == doc[:-1]
        h[1:][same & (h[1:] == h[:-1])] = AGAIN
        yield doc, ((h * step) >> np.uint64(64 - BITS)).astype(np.uint32)
        yield doc[1:][same], (((h[:-1] * np.uint64(0xBF58476D1CE4E5B9) + h[1:]) * step) >> np.uint64(64 - BITS)).astype(np.uint32)[same]


@dataclass
class SubwordModel:
    #: Difference of the outputs for class 1 and class 0 that one occurrence of a bucket stands for.
    table: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of class 1 for each text; a text without n-grams gets the bias's."""
        out = np.empty(len(texts))
        for block in blocks(texts):
            total, count = np.zeros(len(block)), np.zeros(len(block))
            for doc, bucket in grams([texts[i] for i in block]):
                total += np.bincount(doc, self.table[bucket], len(block))
                count += np.bincount(doc, minlength=len(block))
            z = total / np.maximum(count, 1) + self.bias
            out[block] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def fit(sample: list[tuple[str, int]]) -> SubwordModel:
    """Train on (text, label) pairs; with one class only, every text gets that class's smoothed share."""
    y = np.array([label for _, label in sample], np.int64)
    if len(sample) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return SubwordModel(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    texts = [t for t, _ in sample]
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for block in blocks(texts):
        found = list(grams([texts[i] for i in block]))
        doc, bucket = np.concatenate([d for d, _ in found]), np.concatenate([b for _, b in found]).astype(np.int64)
        pairs, counts = np.unique(doc << BITS | bucket, return_counts=True)
        owner = pairs >> BITS
        cuts = np.searchsorted(owner, np.arange(len(block) + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            bags.append(((pairs[a:b] & ((1 << BITS) - 1)).astype(np.int32), (counts[a:b] / max(1, counts[a:b].sum())).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (1 << BITS, SIZE)).astype(np.float32)
    out, bias = np.zeros((2, SIZE), np.float32), np.zeros(2, np.float32)
    steps, total = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            bucket, share = bags[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            mean = share @ vectors[bucket] if len(bucket) else np.zeros(SIZE, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            gap = p / p.sum()
            gap[y[i]] -= 1
            back = gap @ out
            out -= rate * np.outer(gap, mean)
            bias -= rate * 0.1 * gap
            # the gradient of an average is thin over many buckets; each moves by its share of the largest
            vectors[bucket] -= (rate / share.max() * share[:, None] if len(bucket) else 0) * back
    return SubwordModel((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def scored(docs: DataFrame, model: SubwordModel, column: str = "score") -> DataFrame:
    """Add the score of ``text`` to every row; null counts as empty."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(sent.value.scores([t or "" for t in part]))

    return docs.withColumn(column, score("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> SubwordModel:
    return fitted(labelled_sample(docs, labels, "quality", sample), fit)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for every row of ``docs``.

    Fits on labelled rows that are not held out. No labels at all: every score is 0.5.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
